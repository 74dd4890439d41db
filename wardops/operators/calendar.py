"""Days without data still count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardops.functions import clock


def days_of_month(spark: SparkSession, year: int, month: int) -> DataFrame:
    """One row per day number of the month (at most 31)."""
    last = clock.month_last(year, month).day
    return spark.range(1, last + 1, numPartitions=1).select(F.col("id").cast("int").alias("day"))
