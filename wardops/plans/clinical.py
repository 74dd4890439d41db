"""Patients, records and prescriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardops.functions import clock, money, text
from wardops.operators.parents import records_of, with_visit
from wardops.operators.spread import skew_join
from wardops.operators.trigrams import search_many
from wardops.tables import Tables

WAITING = ["Scheduled", "CheckedIn", "In-Progress"]  # fixed values


def patient_search(t: Tables, keyword: str, ignore_accents: bool = False) -> DataFrame:
    """Keyword anywhere in name or phone; letter case does not matter.

    By default ``%`` and ``_`` act as wildcards; ``ignore_accents`` compares
    plain text without regard to accents instead.
    """
    if ignore_accents:
        wanted = F.lit(keyword)
        hit = F.contains(F.collate("full_name", "UNICODE_CI_AI"), F.collate(wanted, "UNICODE_CI_AI")) | F.contains(
            F.collate("phone", "UNICODE_CI_AI"), F.collate(wanted, "UNICODE_CI_AI")
        )
    else:
        hit = text.contains_text(F.col("full_name"), keyword) | text.contains_text(F.col("phone"), keyword)
    return t.patients.filter(hit).select("patient_id", "full_name", "dob", "gender", "phone", "email")


def patient_search_many(t: Tables, keywords: DataFrame) -> DataFrame:
    """``patient_search`` for many keywords (keyword): one row per keyword and patient found."""
    people = t.patients.select("patient_id", "full_name", "dob", "gender", "phone", "email")
    return search_many(people, "patient_id", ["full_name", "phone"], keywords)


def patient_profile(t: Tables, patient_id: int | None = None) -> DataFrame:
    profiles = t.patient_health_profile
    if patient_id is not None:
        profiles = profiles.filter(F.col("patient_id") == patient_id)
    return profiles.select(
        F.lit("Profile").alias("data_type"), "patient_id", "allergies", "chronic_diseases", "blood_type"
    )


def patient_history(t: Tables, patient_id: int | None = None) -> DataFrame:
    """Records reached through either parent, newest first.

    A record whose two parents belong to different patients is history of both.
    """
    records = t.medical_records
    if patient_id is not None:
        records = records_of(records, t, patient_id, "record_id")
    seen = with_visit(records, t, "record_id")
    owners = F.filter(F.array("patient_id", "other_patient_id"), lambda p: p.isNotNull())
    rows = seen.withColumn("patient_id", F.explode(owners))
    if patient_id is not None:
        rows = rows.filter(F.col("patient_id") == patient_id)
    return rows.select(
        "patient_id", "record_id", "diagnosis", "symptoms", "doctor_notes",
        F.col("visit_date").alias("event_date"),
        F.when(F.col("appt_id").isNotNull(), "Outpatient").otherwise("Inpatient").alias("visit_type"),
    ).orderBy(F.desc("event_date"), "record_id", "patient_id")


def exam_queue(t: Tables, doctor_id: int | None = None) -> DataFrame:
    """Visits still to be examined, of any date, with the health profile."""
    waiting = t.appointments.filter(F.col("status").isin(WAITING))
    if doctor_id is not None:
        waiting = waiting.filter(F.col("doctor_id") == doctor_id)
    patients = t.patients.select("patient_id", F.col("full_name").alias("patient_name")).join(
        t.patient_health_profile.select("patient_id", "blood_type", "allergies", "chronic_diseases"),
        "patient_id", "left",
    )
    label = F.concat(
        "patient_name", F.lit(" — "), clock.clock_text(F.col("appt_date")),
        F.lit(" ("), text.status_label(F.col("status")), F.lit(")"),
    )
    return (
        skew_join(waiting, patients, ["patient_id"])
        .select(
            "doctor_id", "appt_id", "patient_id", "patient_name", "appt_date", "status",
            "blood_type", "allergies", "chronic_diseases", label.alias("queue_label"),
        )
        .orderBy("appt_date", "appt_id")
    )


def exam_profile_cards(t: Tables, doctor_id: int | None = None) -> DataFrame:
    """The queue's health profiles as display texts, gaps shown as a dash."""
    def shown(name: str):
        return F.when(text.filled(F.col(name)), F.col(name)).otherwise("—").alias(name)

    return exam_queue(t, doctor_id).select(
        "appt_id", shown("blood_type"), shown("allergies"), shown("chronic_diseases")
    )


def medicine_catalogue(t: Tables) -> DataFrame:
    label = F.concat(
        "med_name", F.lit(" (stock: "), F.col("stock").cast("string"), F.lit(", price: "),
        money.dollars(F.col("price")), F.lit(")"),
    )
    return t.medicines.select("med_id", "med_name", "price", "stock", label.alias("label")).orderBy(
        "med_name", "med_id"
    )


def prescription_items(t: Tables, presc_id: int | None = None) -> DataFrame:
    lines = t.presc_details
    if presc_id is not None:
        lines = lines.filter(F.col("presc_id") == presc_id)
    return lines.select("presc_id", "med_id", "dosage", "quantity").join(
        t.medicines.select("med_id", "med_name"), "med_id"
    ).select("presc_id", "med_name", "dosage", "quantity")
