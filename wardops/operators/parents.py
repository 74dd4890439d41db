"""Rows that hang off an appointment *or* an admission.

Invoices and medical records carry ``appt_id`` and ``admission_id``; normally
exactly one is set.  A left join per parent would send every row whose key is
NULL (most of them) to one partition, and joining on ``a = x OR b = y`` would
force a nested loop.  Instead both keys are folded into one pair
``(visit_kind, visit_id)``: one hash join, no NULL pile-up.  Rows with both
keys set are rare but allowed; they take a separate exact path that looks the
same keyed tables up again, so their shuffles are reused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardops.tables import Tables

OUTPATIENT, INPATIENT, NO_VISIT = 0, 1, 2
VISIT_KEY = ["visit_kind", "visit_id"]


def visits(t: Tables) -> DataFrame:
    """Appointments and admissions as one table keyed by kind and id."""
    appointments = t.appointments.select(
        F.lit(OUTPATIENT).alias("visit_kind"),
        F.col("appt_id").alias("visit_id"),
        "patient_id",
        F.col("appt_date").alias("visit_date"),
    )
    admissions = t.admissions.select(
        F.lit(INPATIENT).alias("visit_kind"),
        F.col("admission_id").alias("visit_id"),
        "patient_id",
        F.col("admission_date").alias("visit_date"),
    )
    return appointments.unionByName(admissions)


def records_of(rows: DataFrame, t: Tables, patient_id: int, key: str) -> DataFrame:
    """The rows that hang off a visit of one patient; the patient's visits are filtered at their scan."""
    own = visits(t).filter(F.col("patient_id") == patient_id).select(*VISIT_KEY)
    return per_parent(rows).join(own, VISIT_KEY, "left_semi").drop(*VISIT_KEY).dropDuplicates([key])


def _both_set():
    return F.col("appt_id").isNotNull() & F.col("admission_id").isNotNull()


def two_parents(rows: DataFrame) -> DataFrame:
    return rows.filter(_both_set())


def single_parent(rows: DataFrame, key: str) -> DataFrame:
    """Rows with at most one parent, plus their visit key.

    Rows without any parent get a key that matches nothing and differs per row,
    so they stay spread out.
    """
    kind = (
        F.when(F.col("appt_id").isNotNull(), OUTPATIENT)
        .when(F.col("admission_id").isNotNull(), INPATIENT)
        .otherwise(NO_VISIT)
    )
    return (
        rows.filter(~_both_set())
        .withColumn("visit_kind", kind)
        .withColumn("visit_id", F.coalesce("appt_id", "admission_id", key))
    )


def per_parent(rows: DataFrame) -> DataFrame:
    """One row per set parent: (visit_kind, visit_id) next to the row."""
    keys = F.array(
        F.struct(F.lit(OUTPATIENT).alias("kind"), F.col("appt_id").alias("id")),
        F.struct(F.lit(INPATIENT).alias("kind"), F.col("admission_id").alias("id")),
    )
    return (
        rows.withColumn("_visit", F.explode(keys))
        .filter(F.col("_visit.id").isNotNull())
        .withColumn("visit_kind", F.col("_visit.kind"))
        .withColumn("visit_id", F.col("_visit.id"))
        .drop("_visit")
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """The looked-up side of a parent match."""
    return per_parent(rows).select(
        F.col("visit_kind").alias("right_kind"),
        F.col("visit_id").alias("right_id"),
        F.col("appt_id").alias("right_appt_id"),
        *[c for c in rows.columns if c not in ("appt_id", "admission_id")],
    )


def _same_parent():
    """Equal on one key; a pair equal on both counts once, as outpatient."""
    counted = F.coalesce(F.col("appt_id") == F.col("right_appt_id"), F.lit(False))
    return (
        (F.col("visit_kind") == F.col("right_kind"))
        & (F.col("visit_id") == F.col("right_id"))
        & ((F.col("visit_kind") == OUTPATIENT) | ~counted)
    )


_LOOKUP = ["right_kind", "right_id", "right_appt_id"]


def linked_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on ``appt_id`` equal OR ``admission_id`` equal."""
    return (
        per_parent(left)
        .join(_keyed(right), _same_parent())
        .drop(*VISIT_KEY, *_LOOKUP)
    )


def linked_max(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Left rows with the largest ``value`` of each parent's right rows, one per parent that has any.

    Equal on either key, as in ``linked_pairs``, where only the largest counts: one
    row per visit is paired, and grouping and join share one shuffle and one sort.
    The id leads, because few rows are told apart by their kind.
    """
    by_visit = ["visit_id", "visit_kind"]
    largest = per_parent(right).groupBy(*by_visit).agg(F.max(value).alias(value))
    return per_parent(left).join(largest, by_visit).drop(*by_visit)


def _double_parent(rows: DataFrame, t: Tables, key: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    outpatient = F.col("visit_kind") == OUTPATIENT
    found = (
        per_parent(rows.filter(_both_set()))
        .join(visits(t), VISIT_KEY, "left")
        .groupBy(key)
        .agg(
            F.any_value(F.struct(*rest)).alias("_row"),
            F.max(F.when(outpatient, F.col("patient_id"))).alias("_first"),
            F.max(F.when(~outpatient, F.col("patient_id"))).alias("_second"),
            F.max(F.when(outpatient, F.col("visit_date"))).alias("_appt_date"),
            F.max(F.when(~outpatient, F.col("visit_date"))).alias("_admission_date"),
        )
    )
    first, second = F.col("_first"), F.col("_second")
    return found.select(
        key,
        "_row.*",
        F.coalesce(first, second).alias("patient_id"),
        F.when(first != second, second).alias("other_patient_id"),
        F.coalesce("_appt_date", "_admission_date").alias("visit_date"),
    )


def with_visit(rows: DataFrame, t: Tables, key: str) -> DataFrame:
    """Add ``patient_id``, ``other_patient_id`` and ``visit_date``.

    ``patient_id`` comes from the appointment, else from the admission;
    ``other_patient_id`` is set only where both parents exist and disagree.
    """
    single = single_parent(rows, key).join(visits(t), VISIT_KEY, "left").withColumn(
        "other_patient_id", F.lit(None).cast("bigint")
    )
    return single.drop(*VISIT_KEY).unionByName(_double_parent(rows, t, key))


def left_linked(left: DataFrame, right: DataFrame, key: str, right_parents: DataFrame) -> DataFrame:
    """Left join on ``appt_id`` equal OR ``admission_id`` equal.

    ``right_parents`` lists the right side's (appt_id, admission_id).  The right
    side may hold a hot parent, so matched and unmatched rows are joined apart
    (see ``left_spread``); ``key`` identifies left rows.
    """
    # Both single-parent joins read one shuffle of ``left``, so filter it alike.
    single = single_parent(left, key).filter(F.col("visit_id").isNotNull())
    same_visit = (F.col("visit_kind") == F.col("right_kind")) & (F.col("visit_id") == F.col("right_id"))
    parents = (
        per_parent(right_parents.select("appt_id", "admission_id"))
        .select(F.col("visit_kind").alias("right_kind"), F.col("visit_id").alias("right_id"))
        .distinct()
    )
    matched = single.join(_keyed(right), same_visit).drop(*VISIT_KEY, *_LOOKUP)
    unmatched = single.join(parents, same_visit, "left_anti").drop(*VISIT_KEY)
    both = left.filter(_both_set())
    both_matched = linked_pairs(both, right)
    found = linked_pairs(both.select(key, "appt_id", "admission_id"), right_parents).select(key).distinct()
    both_unmatched = both.join(found, key, "left_anti")
    missing = [
        F.lit(None).cast(f.dataType).alias(f.name)
        for f in right.schema.fields if f.name not in ("appt_id", "admission_id")
    ]
    alone = unmatched.unionByName(both_unmatched).select("*", *missing)
    return matched.unionByName(both_matched).unionByName(alone)
