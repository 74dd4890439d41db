"""As-of lookups: the next row of a key, and running counts of all rows, at many instants.

Time is cut into levels: hours or days, seconds, microseconds.  A window only ever
orders the distinct instants of one second, the seconds of one hour or day, or the
days of one key, so its size is bounded by the clock and not by the rows, however
many of them share a key or an hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardops.functions import clock

_SECONDS = 86_400


def _cut(rows: DataFrame, at: str, per: int) -> DataFrame:
    """Add the coarse cell of ``per`` seconds, the second within it and the microsecond within that."""
    micros = clock.microseconds(F.col(at))
    return (
        rows.withColumn("_us", micros)
        .withColumn("_cell", F.floor(F.col("_us") / (per * clock.MICROS)))
        .withColumn("_second", F.floor(F.pmod(F.col("_us"), F.lit(per * clock.MICROS)) / clock.MICROS))
        .withColumn("_us", F.pmod(F.col("_us"), F.lit(clock.MICROS)))
    )


def _later(keys: list[str], order: str):
    """Rows of the same keys that lie strictly later; ordered backwards, so that the frame only grows."""
    return Window.partitionBy(*keys).orderBy(-F.col(order)).rangeBetween(Window.unboundedPreceding, -1)


def next_after(asked: DataFrame, events: DataFrame, keys: list[str], at: str, value: Column) -> DataFrame:
    """``asked`` (keys, at) with ``next``: the value of the first event of the same keys strictly after ``at``.

    ``value`` must be a struct that starts with the event's instant and may only
    hold columns of ``events``; of events at one instant the smallest value counts.
    NULL if there is no later event.  Rows of ``asked`` are distinct in the result.
    """
    firsts = events.groupBy(*keys, at).agg(F.min(value).alias("_value"))
    empty = F.lit(None).cast(firsts.schema["_value"].dataType)
    points = _cut(
        firsts.withColumn("_asks", F.lit(False)).unionByName(
            asked.select(*keys, at).distinct().withColumns({"_value": empty, "_asks": F.lit(True)})
        ),
        at, _SECONDS,
    )
    second = points.groupBy(*keys, "_cell", "_second").agg(F.min("_value").alias("_first"))
    second = second.withColumn("_second_next", F.min("_first").over(_later([*keys, "_cell"], "_second")))
    cell = second.groupBy(*keys, "_cell").agg(F.min("_first").alias("_first"))
    cell = cell.withColumn("_cell_next", F.min("_first").over(_later(keys, "_cell")))
    near = points.withColumn("_next", F.min("_value").over(_later([*keys, "_cell", "_second"], "_us")))
    return (
        near.filter("_asks")
        .join(second.drop("_first"), [*keys, "_cell", "_second"])
        .join(cell.drop("_first"), [*keys, "_cell"])
        .select(*keys, at, F.coalesce("_next", "_second_next", "_cell_next").alias("next"))
    )


def running_within(points: DataFrame, at: str, n: str) -> DataFrame:
    """``points`` with ``hour`` and ``so_far``: the sum of ``n`` in the same hour up to and including ``at``."""
    cut = _cut(points, at, 3600)
    earlier = Window.partitionBy("_cell").orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)
    second = cut.groupBy("_cell", "_second").agg(F.sum(n).alias("_n"))
    second = second.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    upto = Window.partitionBy("_cell", "_second").orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("_upto", F.sum(n).over(upto))
        .join(second, ["_cell", "_second"])
        .withColumn("so_far", F.col("_before") + F.col("_upto"))
        .withColumn("hour", F.col("_cell"))
        .drop("_cell", "_second", "_us", "_upto", "_before")
    )


def trailing_counts(instants: DataFrame, hours: int = 24) -> DataFrame:
    """(at, n) per distinct instant to (at, n, trailing): rows in the ``hours`` up to ``at``, their start excluded.

    Whole hours in between are added up from hourly counts; the two cut hours at
    the ends from running counts within them.
    """
    back = F.expr(f"INTERVAL '{int(hours)}' HOUR")
    ends = instants.select("at", "n", F.col("at").alias("_of"), F.lit(1).alias("_sign"))
    starts = instants.select((F.col("at") - back).alias("at"), F.lit(0).cast("bigint").alias("n"), F.col("at").alias("_of"), F.lit(-1).alias("_sign"))
    points = running_within(ends.unionByName(starts), "at", "n")
    edge = points.groupBy(F.col("_of").alias("at")).agg(
        F.sum(F.col("so_far") * F.col("_sign")).alias("_edges"), F.sum("n").alias("n"), F.max("hour").alias("hour")
    )
    hourly = instants.groupBy(clock.hours(F.col("at")).alias("_h")).agg(F.sum("n").alias("_n"))
    whole = (
        hourly.select(F.explode(F.sequence(F.col("_h") + 1, F.col("_h") + hours)).alias("hour"), "_n")
        .groupBy("hour").agg(F.sum("_n").alias("_whole"))
    )
    return edge.join(whole, "hour", "left").select(
        "at", "n", (F.col("_edges") + F.coalesce("_whole", F.lit(0))).cast("bigint").alias("trailing")
    )
