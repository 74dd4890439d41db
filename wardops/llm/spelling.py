"""Spelling variants: words that differ by one code point, grouped under their commonest form.

Method (pivotal grams).  Bigrams are ordered by how many words hold them, rarest first.  A
word's prefix is its three first bigrams in that order; dynamic programming picks from it
the two disjoint bigrams, the pivots, that occur least.  One edit spoils at most one of
two disjoint bigrams, so of two near words the one whose prefix ends earlier keeps a pivot
that the other holds in its prefix.  Pivots are indexed and prefixes probe them.

Position limits.  The edit lies to one side of a surviving pivot.  What is on the other
side stays as it is, and so does the pivot's distance from that end: pivot and word end
form the key.  If that is less than half of the word, the far side is halved: the edit
leaves its near or its far half alone, and the key takes that half in too, so that even a
common bigram at a word's start meets few words.  Candidates are verified by edit distance
inside the join; wrong ones make no row.

Probes.  A bigram that ties with the prefix's last one is probed as well, up to five
places in all: at most two places come before a pivot in its own word and one edit makes
at most two new bigrams, so the pivot is among the first five places of the other word.

Forms are followed to their root by pointer doubling: counts at least double with each
step, so a chain has at most 63 steps and needs seven rounds.

Odd rows.  Null, empty and wordless texts give no words; a null doc_id is hashed as empty
text.  Repeated rows count again.  Words of any length are kept whole.  Extra columns are
ignored.  Empty documents give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import crc_sql, staged, table

RUN = r"[A-Za-zÀ-ÿ]+"
CAPITAL, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP_EVERY = 97
SHORTEST = 5
LEAST = 3
RATIO = 2
EDITS = 1
#: Bigrams in a prefix (one edit touches two), and places probed when bigrams tie.
PREFIX = 2 * EDITS + 1
PROBED = PREFIX + 2 * EDITS


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of all whole texts, after the contract's deletions."""
    if shortest <= PREFIX:
        raise ValueError(f"words need more than {PREFIX} letters to hold a prefix")
    low = F.translate("run", CAPITAL, SMALL)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", low.alias("run")).where(F.length("run") >= shortest)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    place = F.pmod(h, F.length("run")).cast("int")
    run = F.col("run")
    cut = F.concat(run.substr(F.lit(1), place), run.substr(place + 2, F.length("run")))
    words = runs.select(F.when(h % DROP_EVERY == 0, cut).otherwise(run).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def gram_order(words: DataFrame) -> dict[str, int]:
    """Bigrams, rarest first.  They are pairs of 90 letters: at most 8,100."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                total.update({word[i : i + 2] for i in range(len(word) - 1)})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

    found = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r.gram: i for i, r in enumerate(sorted(found, key=lambda r: (r.n, r.gram)))}


def pivots(places: list[int], costs: list[int], count: int = EDITS + 1) -> list[int]:
    """``count`` places (ascending input), each at least two apart, of least total cost."""
    endless = float("inf")
    # best[k] and chosen[k]: cheapest k disjoint bigrams among the places seen so far.
    steps = [[(0, ())] + [(endless, ())] * count]
    for at, (place, cost) in enumerate(zip(places, costs)):
        before = next((j for j in range(at, 0, -1) if places[j - 1] <= place - 2), 0)
        row = list(steps[at])
        for k in range(1, count + 1):
            total, chosen = steps[before][k - 1]
            if total + cost < row[k][0]:
                row[k] = (total + cost, (*chosen, place))
        steps.append(row)
    return list(steps[-1][count][1])


def _key(side: int, kind: str, size: int, *parts: str) -> int:
    h = xxhash.xxh64(f"{kind}{size}:", side)
    for part in parts:
        h.update(part.encode("utf-8", "surrogatepass"))
    return h.intdigest() - (1 << 63)


def index_keys(side: int, word: str, at: int) -> Iterator[int]:
    """Keys of a pivot whose word is edited behind it."""
    n, upto = len(word), at + 2
    if 2 * upto >= n:
        yield _key(side, "whole", 0, word[:upto])
    else:
        half = upto + (n - upto) // 2
        yield _key(side, "near", n, word[:half])
        yield _key(side, "far", n, word[:upto], word[half:])


def probe_keys(side: int, word: str, at: int) -> Iterator[int]:
    """Keys that ``index_keys`` may have given to a word one edit away."""
    upto, whole = at + 2, False
    for n in (len(word) - 1, len(word), len(word) + 1):
        if upto > n:
            continue
        if 2 * upto >= n:
            whole = True
            continue
        half = upto + (n - upto) // 2
        if half <= len(word):
            yield _key(side, "near", n, word[:half])
        if len(word) - (n - half) >= upto:
            yield _key(side, "far", n, word[:upto], word[len(word) - (n - half) :])
    if whole:
        yield _key(side, "whole", 0, word[:upto])


def signatures(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """(key, probe, last, word, n): two pivots and up to five probed places of every word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, probes, lasts, rows = [], [], [], []
            for row, word in enumerate(batch.column("word").to_pylist()):
                ranks = [order[word[i : i + 2]] for i in range(len(word) - 1)]
                places = sorted(range(len(ranks)), key=lambda i: (ranks[i], i))
                last = ranks[places[PREFIX - 1]]
                chosen = pivots(sorted(places[:PREFIX]), [ranks[i] for i in sorted(places[:PREFIX])])
                probed = [i for i in places[:PROBED] if ranks[i] <= last]
                turned, end = word[::-1], len(word) - 2
                for probe, picked, make in ((False, chosen, index_keys), (True, probed, probe_keys)):
                    own = {k for i in picked for k in (*make(0, word, i), *make(1, turned, end - i))}
                    keys += own
                    probes += [probe] * len(own)
                    lasts += [last] * len(own)
                    rows += [row] * len(own)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(probes, pa.bool_()), pa.array(lasts, pa.int32()), batch.column("word").take(at), batch.column("n").take(at)],
                ["key", "probe", "last", "word", "n"],
            )

    return words.select("word", "n").mapInArrow(sign, "key long, probe boolean, last int, word string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): both directions of every pair exactly one edit apart."""
    signed = staged(signatures(words, gram_order(words)), "spelling-signatures")
    index = signed.where(~F.col("probe")).select("key", "last", "word", "n")
    probe = signed.where("probe").select("key", *(F.col(c).alias(f"other_{c}") for c in ("last", "word", "n")))
    one_edit = (
        (F.col("last") <= F.col("other_last"))
        & (F.col("word") != F.col("other_word"))
        & (F.abs(F.length("word") - F.length("other_word")) <= EDITS)
        & (F.levenshtein("word", "other_word", EDITS) == EDITS)
    )
    found = index.join(probe, (index["key"] == probe["key"]) & one_edit)
    both = F.array(
        F.struct(F.col("word"), F.col("other_word").alias("other"), F.col("other_n")),
        F.struct(F.col("other_word").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )
    return found.select(F.inline(both)).distinct()


def followed(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form), where counts rise along every chain."""
    roots = staged(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = staged(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        roots = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return roots


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = staged(vocabulary(docs), "spelling-words")
    best = F.min(F.struct(-F.col("other_n"), F.col("other")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    common = -F.col("best")["col1"] >= ratio * F.col("n")
    found = staged(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common, F.col("best")["other"]).alias("form"), F.when(common, -F.col("best")["col1"]).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = followed(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op11_sql() -> str:
    return f"""
    WITH RECURSIVE runs AS (
      SELECT doc_id, translate(run, '{CAPITAL}', '{SMALL}') AS w
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)),
    hashed AS (SELECT w, {crc_sql("code")} AS h FROM (
      SELECT w, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS code FROM runs WHERE length(w) >= {SHORTEST})),
    words AS MATERIALIZED (
      SELECT word, count(*) AS n
      FROM (SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
      WHERE length(word) >= {SHORTEST} GROUP BY word HAVING count(*) >= {LEAST}),
    cut AS MATERIALIZED (
      SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
    near AS (
      SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
    best AS (
      SELECT word, n, count(other) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
      FROM words LEFT JOIN near USING (word) GROUP BY word, n),
    forms AS MATERIALIZED (
      SELECT word, n, n_near, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n FROM best),
    chain AS (
      SELECT word, word AS root, 0 AS step FROM forms
      UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n
    FROM forms JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) USING (word)"""
