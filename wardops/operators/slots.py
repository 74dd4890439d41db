"""Appointments that clash with a requested time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from wardops.functions import clock
from wardops.operators.spread import skew_join
from wardops.session import Stage
from wardops.tables import Tables

#: Parts of a half hour that are looked through one by one.
PARTS = 1024
LIVE_STATES = ["Scheduled", "CheckedIn", "In-Progress"]  # fixed values


def busy_doctors(t: Tables, slot: datetime) -> DataFrame:
    """doctor_id of every live appointment strictly within 30 minutes of ``slot``."""
    margin = timedelta(minutes=clock.VISIT_MINUTES)
    when = F.col("appt_date")
    return (
        t.appointments.filter(F.col("status").isin(LIVE_STATES))
        .filter((when > clock.instant(slot - margin)) & (when < clock.instant(slot + margin)))
        .select("doctor_id")
    )


def clashing_requests(requests: DataFrame, t: Tables, key: str) -> DataFrame:
    """Distinct ``key`` of requests (key, doctor_id, appt_date) that clash.

    Time is cut into half-hour cells and each (doctor, cell) keeps only its
    first and last live visit: a visit in the request's own cell always
    clashes, of the cell before only the last can, of the cell after only the
    first.  So a request meets at most three rows, however busy the doctor is.
    Only visits between the first and the last request are read.
    """
    width = clock.VISIT_MINUTES * 60 * clock.MICROS
    taken_at = clock.microseconds(F.col("appt_date"))
    margin = F.expr(f"INTERVAL {clock.VISIT_MINUTES} MINUTES")
    earliest = requests.agg(F.min("appt_date")).scalar() - margin
    latest = requests.agg(F.max("appt_date")).scalar() + margin
    live = (
        t.appointments.filter(F.col("status").isin(LIVE_STATES))
        .filter(F.col("doctor_id").isNotNull() & (F.col("appt_date") > earliest) & (F.col("appt_date") < latest))
        .groupBy("doctor_id", F.floor(taken_at / width).alias("cell"))
        .agg(F.min(taken_at).alias("first_at"), F.max(taken_at).alias("last_at"))
    )
    cell = F.floor(F.col("asked_at") / width)
    asked = (
        requests.select(key, "doctor_id", clock.microseconds(F.col("appt_date")).alias("asked_at"))
        .withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    )
    return (
        skew_join(asked, live, ["doctor_id", "cell"])
        .filter((F.col("last_at") > F.col("asked_at") - width) & (F.col("first_at") < F.col("asked_at") + width))
        .select(key)
        .distinct()
    )


def granted_requests(requests: DataFrame, key: str, stage: Stage) -> DataFrame:
    """``key`` of the requests (key, doctor_id, appt_date) that get their time, if taken in order of ``key``.

    A request is granted unless it lies within 30 minutes of an earlier granted
    one of the doctor: the greedy independent set of the requests' clashes.  Of
    requests for one instant only the first can be granted.  The rest is decided
    in rounds: a request that comes first among the undecided ones near it is
    granted, whatever lies near a granted one is refused.  Every round decides
    each doctor's first request at least and, as clashes reach only an hour far,
    most others with it.  ``stage`` must write its frame, so that rounds do not
    pile up in one plan.
    """
    width = clock.VISIT_MINUTES * 60 * clock.MICROS
    undecided = (
        requests.filter(F.col("doctor_id").isNotNull() & F.col("appt_date").isNotNull())
        .groupBy("doctor_id", clock.microseconds(F.col("appt_date")).alias("asked_at"))
        .agg(F.min(key).alias(key))
    )
    granted = None
    while True:
        marked = stage(_first_nearby(undecided, key, width))
        first = marked.filter("is_first").drop("is_first")
        granted = first.select(key) if granted is None else granted.unionByName(first.select(key))
        if marked.filter("NOT is_first").isEmpty():
            return granted
        undecided = _far_from(marked.drop("is_first"), first, width)


def _first_nearby(rows: DataFrame, key: str, width: int) -> DataFrame:
    """Rows (doctor_id, asked_at, key) and ``is_first``: no smaller key of the doctor is less than ``width`` away.

    Time is cut into cells of ``width``.  What is near a row is its own cell, the
    next cell up to the row's offset in the cell, and the cell before from that
    offset on.  So each row asks two questions, in the cells beside its own, that
    running minimums answer: over whole parts of the cell, and within the part of
    the same offset.  A part is 1/``PARTS`` of a cell, 1.8 million instants at
    most, so no task holds a doctor, or a crowded half hour, as a whole.
    """
    offset = F.pmod("asked_at", F.lit(width))
    asks = F.array(*[F.struct(F.lit(step).alias("step"), point.alias("point")) for step, point in (
        (0, F.col(key)), (1, F.lit(None).cast("bigint")), (-1, F.lit(None).cast("bigint")))])
    roles = (
        rows.select("doctor_id", "asked_at", key, offset.alias("offset"), F.inline(asks))
        .withColumn("part", F.floor(F.col("offset") * PARTS / width))
        .withColumn("cell", F.floor(F.col("asked_at") / width) + F.col("step"))
    )
    part = ["doctor_id", "cell", "part"]
    # Questions sort before the requests of their own instant: only what is nearer than the width counts.
    asked_first = F.col("point").isNotNull()
    up = Window.partitionBy(*part).orderBy("offset", asked_first).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*part).orderBy(F.desc("offset"), asked_first).rowsBetween(Window.unboundedPreceding, 0)
    cell = Window.partitionBy("doctor_id", "cell")
    before = cell.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = cell.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = roles.groupBy(*part).agg(F.min("point").alias("least")).select(
        *part, F.min("least").over(before).alias("before"), F.min("least").over(after).alias("after"), F.min("least").over(cell).alias("whole")
    )
    answer = (
        F.when(F.col("step") == 0, F.col("whole"))
        .when(F.col("step") == 1, F.least("lower", "before"))
        .otherwise(F.least("higher", "after"))
    )
    return (
        roles.withColumns({"lower": F.min("point").over(up), "higher": F.min("point").over(down)})
        .join(parts, part)
        .groupBy("doctor_id", "asked_at", key)
        .agg(F.min(answer).alias("least"))
        .select("doctor_id", "asked_at", key, (F.col("least") == F.col(key)).alias("is_first"))
    )


def _far_from(rows: DataFrame, granted: DataFrame, width: int) -> DataFrame:
    """Rows at least ``width`` away from every granted one of the doctor (three of them near a cell at most)."""
    cell = F.floor(F.col("asked_at") / width)
    near = (
        granted.select("doctor_id", F.col("asked_at").alias("taken_at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
        .groupBy("doctor_id", "cell")
        .agg(F.collect_list("taken_at").alias("taken"))
    )
    close = F.exists("taken", lambda other: F.abs(other - F.col("asked_at")) < width)
    return (
        skew_join(rows.withColumn("cell", cell), near, ["doctor_id", "cell"], "left")
        .filter(~F.coalesce(close, F.lit(False)))
        .select(*rows.columns)
    )
