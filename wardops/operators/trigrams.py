"""Many substring searches at once, through the letters the keywords hold.

A gram is a stretch of up to four letters of a pattern, lower-cased; letters left open
inside it (``_``, or an escaped character) stand as ``_``.  A keyword looks up one gram
only, the rarest of those with most letters, and what it finds is verified with ``ilike``.
Texts post the same stretches, only of the shapes that keywords have, and only grams some
keyword may choose, so the postings that move are those that are asked for.  A keyword of
wildcards alone, or an empty one, matches every text and looks up the empty gram.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby, product

from pyspark.sql import Column, DataFrame, functions as F

from wardops.session import Stage, stager

GRAM = 4
# Which letters of a stretch count: "x" does, "_" is left open.
SHAPES = ["x", *("x" + "".join(inner) + "x" for n in range(GRAM - 1) for inner in product("x_", repeat=n))]


def _stretches(text: Column, shape: str) -> Column:
    """All stretches of a text as long as the shape, with its open letters."""
    def cut(start: Column) -> Column:
        parts, at = [], 0
        for kind, run in groupby(shape):
            n = len(list(run))
            parts.append(F.substring(text, start + at, F.lit(n)) if kind == "x" else F.lit("_" * n))
            at += n
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    starts = F.when(F.length(text) >= len(shape), F.sequence(F.lit(1), F.length(text) - len(shape) + 1))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), cut)


def _text_grams(text: Column, shapes: Column) -> Column:
    """What a text posts of the given shapes; the empty gram is a shape too."""
    none = F.array().cast("array<string>")
    asked = [F.when(F.array_contains(shapes, F.lit("")), F.array(F.lit(""))).otherwise(none)]
    asked += [F.when(F.array_contains(shapes, F.lit(s)), _stretches(text, s)).otherwise(none) for s in SHAPES]
    return F.when(text.isNotNull(), F.concat(*asked)).otherwise(none)


def keyword_grams(keywords: DataFrame) -> DataFrame:
    """(keyword, gram): the grams with most letters a keyword has."""
    fixed = F.split(F.regexp_replace(F.lower("keyword"), r"(?s)\\.", "_"), r"[%\\]")
    plain = F.flatten(F.transform(fixed, lambda p: F.concat(*[_stretches(p, "x" * n) for n in range(1, GRAM + 1)])))
    closed = F.filter(plain, lambda g: ~g.startswith("_") & ~g.endswith("_"))

    def letters(gram: Column) -> Column:
        return F.length(F.replace(gram, F.lit("_"), F.lit("")))

    own = keywords.select("keyword").filter(F.col("keyword").isNotNull()).distinct().withColumn(
        "_own", F.array_distinct(F.concat(F.array(F.lit("")), closed))
    )
    most = own.withColumn("_most", F.array_max(F.transform("_own", letters)))
    return most.select("keyword", F.explode(F.filter("_own", lambda g: letters(g) == F.col("_most"))).alias("gram"))


def search_many(rows: DataFrame, key: str, fields: list[str], keywords: DataFrame, stage: Stage | None = None) -> DataFrame:
    """(keyword, *rows): every row per distinct keyword that one of its ``fields`` holds, ``%`` and ``_`` being wildcards.

    ``key`` identifies a row.  NULL fields hold nothing, NULL keywords find nothing.
    Grams and postings are staged: they are used twice, and only written frames tell
    Spark which side of a join is small, as texts post many times their own size.
    """
    stage = stage or stager(rows.sparkSession, "searches")
    asked = stage(keyword_grams(keywords))
    shapes = asked.agg(F.collect_set(F.regexp_replace("gram", "[^_]", "x"))).scalar()
    # A small file is one task, but a byte of text makes many grams: spread texts before cutting them.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.filter(F.col(key).isNotNull()).select(key, *fields).repartition(tasks, key)
    grams = F.array_distinct(F.concat(*[_text_grams(F.lower(c), shapes) for c in fields]))
    posted = stage(
        texts.select(key, F.explode(grams).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    )
    held = posted.groupBy("gram").agg(F.count("*").alias("_held"))
    rarest = stage(
        asked.join(held, "gram")
        .groupBy("keyword")
        .agg(F.min(F.struct("_held", "gram")).alias("_choice"))
        .select("keyword", F.col("_choice.gram").alias("gram"))
    )
    candidates = posted.join(rarest, "gram").select("keyword", key)
    pattern = F.concat(F.lit("%"), F.col("keyword"), F.lit("%"))
    hit = reduce(lambda a, b: a | b, [F.expr(f"`{c}` ILIKE _pattern") for c in fields])
    return (
        candidates.join(rows, key).withColumn("_pattern", pattern).filter(hit).select("keyword", *rows.columns)
    )
