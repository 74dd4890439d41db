"""The one insurance rate that counts for a patient on a day."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from wardops.functions import clock
from wardops.operators.spread import skew_join
from wardops.tables import Tables

NO_RATE = "0.00"


def active_policy(t: Tables, as_of: datetime) -> DataFrame:
    """(patient_id, coverage_rate) for patients with an unexpired policy.

    Of several, the one that expires last counts, then the highest policy id.
    A ``max`` of a struct is combined before the shuffle, so a patient with very
    many policies does not pile up in one task as a ranking window would.
    """
    best = F.max(F.struct("expiry_date", "insurance_id", "coverage_rate"))
    return (
        t.insurance.filter(F.col("expiry_date") >= clock.day(as_of))
        .filter(F.col("patient_id").isNotNull())
        .groupBy("patient_id")
        .agg(best.alias("best"))
        .select("patient_id", rate_or_zero(F.col("best.coverage_rate")).alias("coverage_rate"))
    )


def rate_or_zero(rate):
    return F.coalesce(rate, F.lit(NO_RATE).cast("decimal(3,2)"))


def with_active_rate(rows: DataFrame, t: Tables, as_of: datetime) -> DataFrame:
    """Add ``coverage_rate`` by ``patient_id``; 0 without an active policy."""
    return skew_join(rows, active_policy(t, as_of), ["patient_id"], "left").withColumn(
        "coverage_rate", rate_or_zero(F.col("coverage_rate"))
    )
