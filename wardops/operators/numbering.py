"""Exact running numbers without one big window.

``row_number`` over a whole table, or over a key that holds a third of it,
sorts all those rows in one task.  Here rows are numbered inside small buckets
that follow the sort order, and each bucket starts where the one before ended.
Only bucket counts meet in one place.  The result depends on the data alone,
not on partition ids, so recomputed tasks give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from wardops.functions import clock
from wardops.operators.spread import skew_join
from wardops.schemas import KEYS
from wardops.tables import Tables

LEVEL_BITS = 16
RANGES = 256
RANGE_ROWS = 1 << 16
_MIN_BIGINT = -(2**63)


def _starts(counts: DataFrame, keys: list, *bucket: str) -> DataFrame:
    """Rows of the same ``keys`` before each bucket, from (keys, bucket, n)."""
    before = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _cut(rows: DataFrame, keys: list[str], value: Column, name: str, range_rows: int) -> DataFrame:
    """``name``: the range of its ``keys`` that a row's ``value`` falls in, in order of the value.

    Quantiles come from a mergeable sketch, so a hot key is summed up where its
    rows lie.  A key gets a range for every ``range_rows`` rows, ``RANGES`` at
    most.  Split values are ranges of their own (odd numbers), with the open
    intervals between them (even numbers): a value that many rows share is a
    split value, and nothing else is in its range.
    """
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    found = rows.groupBy(*keys).agg(
        F.count(value).alias("_n"), F.percentile_approx(value, shares, 10 * RANGES).alias("_quantiles")
    )
    used = F.least(F.ceil(F.col("_n") / range_rows), F.lit(RANGES))
    every = F.transform(F.sequence(F.lit(1), F.greatest(used - 1, F.lit(1))), lambda i: F.col("_quantiles")[F.floor(i * RANGES / used).cast("int") - 1])
    splits = F.when(used > 1, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))
    cut = skew_join(rows, found.select(*keys, splits.alias("_splits")), keys)
    below = F.size(F.filter("_splits", lambda s: s < value))
    at = F.when(F.array_contains("_splits", value), 1).otherwise(0)
    return cut.withColumn(name, F.coalesce(2 * below + at, F.lit(0))).drop("_splits")


def running_number(
    rows: DataFrame, key: str, stamp: str, ties: list[str], name: str, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Number the rows of each ``key`` by ``stamp`` then ``ties``, from 1.

    A key's rows are cut into ranges of time of about equal size, and an instant
    that is a range of its own into ranges of the first tie (a bigint).  A range
    is numbered for itself and starts where the one before it ended.  So one
    user, one instant, or both may hold any number of rows.  ``key`` must not
    be NULL.
    """
    when = F.coalesce(clock.microseconds(F.col(stamp)), F.lit(_MIN_BIGINT))
    cut = _cut(rows, [key], when, "_time", range_rows)
    crowded = F.when(F.col("_time") % 2 == 1, F.col(ties[0]).cast("bigint"))
    cut = _cut(cut, [key, "_time"], crowded, "_tie", range_rows)
    at = [key, "_time", "_tie"]
    starts = _starts(cut.groupBy(*at).agg(F.count("*").alias("n")), [key], "_time", "_tie").drop("n")
    place = F.row_number().over(Window.partitionBy(*at).orderBy(stamp, *ties))
    numbered = skew_join(cut, starts, at).withColumn(name, place + F.col("start"))
    return numbered.select(*rows.columns, name)


def dense_number(rows: DataFrame, sequence: str, name: str) -> DataFrame:
    """Number all rows 1, 2, 3 … in the order of a unique bigint ``sequence``.

    Counts are summed up level by level, 16 bits each, and each level starts
    where the one before ended.  As values are unique, no task sorts more than
    2**16 rows or adds up more than 2**16 counts, however sparse the sequence.
    """
    value = F.col(sequence).cast("bigint")
    levels = [f"_level{i}" for i in range(1, 64 // LEVEL_BITS)]
    leveled = rows.withColumn(levels[0], F.shiftright(value, LEVEL_BITS))
    counts = leveled.groupBy(levels[0]).agg(F.count("*").alias("n"))
    starts = counts.select(levels[0], F.lit(0).cast("bigint").alias("total"))
    for own, above in zip(levels, [*levels[1:], None]):
        if above is None:  # 2**16 values at most are left
            ranked = _starts(counts, [F.lit(0)], own)
        else:
            counts = counts.withColumn(above, F.shiftright(own, LEVEL_BITS))
            ranked = _starts(counts, [above], own)
            starts = starts.withColumn(above, F.shiftright(levels[0], LEVEL_BITS * levels.index(above)))
            counts = counts.groupBy(above).agg(F.sum("n").alias("n"))
        starts = starts.join(ranked.select(own, F.col("start").alias("_start")), own).withColumn("total", F.col("total") + F.col("_start")).drop("_start")
    within = Window.partitionBy(levels[0]).orderBy(sequence)
    return (
        leveled.withColumn("_place", F.row_number().over(within))
        .join(starts.select(levels[0], "total"), levels[0])
        .withColumn(name, F.col("_place") + F.col("total"))
        .drop(levels[0], "_place", "total")
    )


def allocate_ids(
    rows: DataFrame, sequence: str, existing: DataFrame, key: str
) -> DataFrame:
    """Give each new row the next free ``key`` of ``existing``, in sequence order."""
    last: Column = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).scalar()
    return dense_number(rows, sequence, "_number").withColumn(key, F.col("_number") + last).drop("_number")


def gives_ids(name: str, table: DataFrame) -> bool:
    """True if the table has its key as a number."""
    return KEYS[name] in table.columns and isinstance(table.schema[KEYS[name]].dataType, T.IntegralType)


def highest_id(name: str, table: DataFrame) -> DataFrame:
    return table.agg(F.max(KEYS[name]).cast("bigint").alias("last_id"))


def id_mark(t: Tables, name: str) -> DataFrame:
    """(last_id): the highest id ever given in a table; without a mark, the highest that is left."""
    return t.id_marks[name] if name in t.id_marks else highest_id(name, t[name])


def last_id(t: Tables, name: str) -> Column:
    """The same as a scalar, 0 for a table that never had a row."""
    return id_mark(t, name).agg(F.coalesce(F.max("last_id"), F.lit(0))).scalar()


def new_ids(rows: DataFrame, sequence: str, t: Tables, name: str) -> DataFrame:
    """Give each new row of a table the next id that was never used, in sequence order."""
    return (
        dense_number(rows, sequence, "_number")
        .withColumn(KEYS[name], F.col("_number") + last_id(t, name))
        .drop("_number")
    )
