"""Beds and who lies in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardops.functions import text
from wardops.operators.spread import left_spread
from wardops.tables import Tables


def _placed_beds(t: Tables, dept_name: str | None, status: str | None) -> DataFrame:
    departments = t.departments
    if dept_name is not None:
        departments = departments.filter(F.col("dept_name") == dept_name)
    beds = t.beds if status is None else t.beds.filter(F.col("status") == status)
    return (
        beds.join(t.rooms, "room_id")
        .join(departments, "dept_id")
        .select("bed_id", "bed_code", "room_name", "dept_name", F.col("status").alias("bed_status"))
    )


def _open_admissions(t: Tables) -> DataFrame:
    return t.admissions.filter(F.col("discharge_date").isNull() & F.col("bed_id").isNotNull())


def bed_status(t: Tables, dept_name: str | None = None, status: str | None = None) -> DataFrame:
    """A bed with several open admissions gives several rows."""
    patients = t.patients.select("patient_id", "full_name")
    inside = _open_admissions(t).select("bed_id", "patient_id").join(patients, "patient_id", "left")
    listed = left_spread(
        _placed_beds(t, dept_name, status), inside, ["bed_id"], right_keys=_open_admissions(t)
    )
    return (
        listed.select(
            "bed_code", "room_name", "dept_name", "bed_status",
            F.coalesce("full_name", F.lit("Empty")).alias("current_patient"),
        )
        .orderBy("dept_name", "room_name", "bed_code", "current_patient")
    )


def bed_board(t: Tables, dept_name: str | None = None, status: str | None = None) -> DataFrame:
    return bed_status(t, dept_name, status).withColumn("colour", text.bed_colour(F.col("bed_status")))


def bed_availability_counts(
    t: Tables, dept_name: str | None = None, status: str | None = None
) -> DataFrame:
    """Rows of the bed list, and Available ones, per department.

    Counts list rows: a bed with two open admissions is listed twice.  Only the
    number of open admissions is needed, so no patient is looked up.
    """
    listed = _open_admissions(t).groupBy("bed_id").agg(F.count("*").alias("admitted"))
    times = F.coalesce("admitted", F.lit(1))
    return (
        _placed_beds(t, dept_name, status)
        .join(listed, "bed_id", "left")
        .groupBy("dept_name")
        .agg(
            F.sum(times).cast("bigint").alias("beds_shown"),
            F.sum(F.when(F.col("bed_status") == "Available", times).otherwise(0))
            .cast("bigint").alias("beds_available"),
        )
        .orderBy("dept_name")
    )
