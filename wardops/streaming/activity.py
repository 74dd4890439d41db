"""Actions in the last 24 hours, every hour, over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardops.operators.asof import trailing_counts
from wardops.session import shared_folder
from wardops.streaming.rules import stored_table

LATENESS = "1 hour"
_HOURS = "hour timestamp, n bigint, newest timestamp"


def hourly_counts(events: DataFrame, stamp: str, lateness: str = LATENESS) -> DataFrame:
    """(hour, n, newest) per clock hour, for a stream in update mode.

    An event is counted if its hour ends after the newest event of the earlier
    micro-batches less ``lateness``; that is how long state is kept.
    """
    return (
        events.withWatermark(stamp, lateness)
        .groupBy(F.window(stamp, "1 hour").alias("hour"))
        .agg(F.count("*").alias("n"), F.max(stamp).alias("newest"))
        .select(F.col("hour.start").alias("hour"), "n", "newest")
    )


def counts_24h(hours: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(window_start, window_end, action_count, is_open) for windows of 24 hours, every hour.

    Events are counted once, per hour; windows add up 24 hour counts instead of
    copying every event into 24 windows.  ``is_open``: events may still arrive.
    """
    hour = F.expr("INTERVAL 1 HOUR")
    day = F.expr("INTERVAL 24 HOURS")
    closed = hours.agg(F.max("newest")).scalar() - F.expr(f"INTERVAL {lateness}")
    ends = F.sequence(F.col("hour") + hour, F.col("hour") + day, hour)
    return (
        hours.select(F.explode(ends).alias("window_end"), "n")
        .groupBy("window_end")
        .agg(F.sum("n").alias("action_count"))
        .select(
            (F.col("window_end") - day).alias("window_start"), "window_end", "action_count",
            (F.col("window_end") > closed).alias("is_open"),
        )
    )


def write_hours(events: DataFrame, stamp: str, folder: str, lateness: str = LATENESS) -> StreamingQuery:
    """Write every hour a micro-batch touched to the folder of its epoch; a repeated epoch replaces itself."""
    spark = events.sparkSession
    spark.createDataFrame([], _HOURS).write.mode("overwrite").parquet(f"{folder}/hours/epoch=-1")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/hours/epoch={epoch}")

    return (
        hourly_counts(events, stamp, lateness)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def latest_hours(spark: SparkSession, folder: str) -> DataFrame:
    """The last count of every hour."""
    written = spark.read.schema(f"{_HOURS}, epoch bigint").parquet(f"{folder}/hours")
    last = written.groupBy("hour").agg(F.max_by(F.struct("n", "newest"), "epoch").alias("last"))
    return last.select("hour", "last.*")


def actions_24h_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the stream over what is stored; open windows come out too."""
    folder = shared_folder(spark, "actions-24h")
    path = stored_table(sf_dir, "events")
    events = (
        spark.readStream.schema(spark.read.parquet(path).schema)
        .parquet(path)
        .select(F.col("ts").cast("timestamp").alias("ts"))
    )
    write_hours(events, "ts", folder).awaitTermination()
    return counts_24h(latest_hours(spark, folder)).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "action_count", "is_open",
    )


def write_instants(events: DataFrame, stamp: str, folder: str) -> StreamingQuery:
    """Count every micro-batch's events per instant into the folder of its epoch; no state, no lateness."""
    spark = events.sparkSession
    spark.createDataFrame([], "at timestamp_ntz, n bigint").write.mode("overwrite").parquet(f"{folder}/instants/epoch=-1")

    def write(batch: DataFrame, epoch: int) -> None:
        at = F.col(stamp).cast("timestamp_ntz").alias("at")
        counted = batch.filter(F.col(stamp).isNotNull()).groupBy(at).agg(F.count("*").alias("n"))
        counted.write.mode("overwrite").parquet(f"{folder}/instants/epoch={epoch}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/instants-checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def trailing_24h(spark: SparkSession, folder: str) -> DataFrame:
    """(timestamp, action_count) at every instant seen so far, however late or split its events came."""
    seen = spark.read.schema("at timestamp_ntz, n bigint").parquet(f"{folder}/instants")
    counted = trailing_counts(seen.groupBy("at").agg(F.sum("n").alias("n")))
    return counted.select(F.col("at").alias("timestamp"), F.col("trailing").alias("action_count"))


def actions_trailing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "actions-trailing")
    path = stored_table(sf_dir, "events")
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).select("ts")
    write_instants(events, "ts", folder).awaitTermination()
    return trailing_24h(spark, folder)
