"""New patients and prescriptions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F

from wardops.changes.billing import reprice_invoices
from wardops.changes.core import UNKNOWN_USER, Changes, audit_of, mark_known, mark_known_or_none, mark_user, reject, split
from wardops.functions import clock, text
from wardops.operators.numbering import dense_number, last_id, new_ids
from wardops.session import Stage, keep
from wardops.tables import Tables

OLDEST_BIRTH = date(1900, 1, 1)  # fixed value


def register_patients(
    commands: DataFrame, t: Tables, as_of: datetime, stage: Stage = keep
) -> Changes:
    """New patients with a health profile and, if a provider is named, a policy.

    Commands (seq, executor_id, full_name, dob, gender, phone, email,
    blood_type, allergies, chronic_diseases, provider, rate_percent,
    expiry_date).  An address may be registered once: existing patients first,
    then the earliest command.
    """
    insured = text.filled(F.col("provider"))
    form = [
        (
            text.filled(F.col("full_name")) & text.filled(F.col("phone")) & text.filled(F.col("email")),
            "Please fill in all required fields",
        ),
        (F.col("dob").between(F.lit(OLDEST_BIRTH), clock.day(as_of)), "Birth date out of range"),
        (F.col("rate_percent").between(0, 100), "Coverage must be between 0 and 100 percent"),
        (~insured | (F.col("expiry_date") >= clock.day(as_of)), "Policy has expired"),
        (F.col("has_user"), UNKNOWN_USER),
    ]
    valid, incomplete = split(mark_user(commands, t), form)
    firsts = valid.groupBy("email").agg(F.min("seq").alias("seq"))
    free = firsts.join(t.patients.select("email"), "email", "left_anti").select(
        "seq", F.lit(True).alias("is_free")
    )
    accepted, repeated = split(
        valid.join(free, "seq", "left"), [(F.col("is_free"), "Email address is already registered")]
    )
    numbered = stage(dense_number(accepted, "seq", "number"))
    patient_id = (F.col("number") + last_id(t, "patients")).alias("patient_id")
    profile_id = (F.col("number") + last_id(t, "patient_health_profile")).alias("profile_id")
    rate = (F.col("rate_percent").cast("decimal(5,2)") / 100).cast("decimal(3,2)")
    policies = numbered.filter(insured).select(patient_id, rate.alias("coverage_rate"), "expiry_date", "provider")
    action = F.concat(F.lit("Registered new patient: "), "full_name")
    return Changes(
        inserts={
            "patients": numbered.select(patient_id, "full_name", "dob", "gender", "phone", "email"),
            "patient_health_profile": numbered.select(
                profile_id, patient_id, "allergies", "chronic_diseases", "blood_type"
            ),
            "insurance": policies.select(
                text.padded_policy_id(as_of.year, F.col("patient_id")).alias("insurance_id"),
                "patient_id", "coverage_rate", "expiry_date", "provider",
            ),
        },
        audit=audit_of(numbered, "executor_id", action, as_of),
        rejected=reject(incomplete).unionByName(reject(repeated)),
    )


def prescribe(commands: DataFrame, t: Tables, stage: Stage = keep) -> Changes:
    """Lines (seq, record_id, doctor_id, med_id, quantity, dosage).

    The lines of one record in one batch share a new prescription, written by
    the doctor of the first line.
    """
    marked = mark_known(commands, "record_id", t.medical_records, "record_id", "has_record")
    marked = mark_known(marked, "med_id", t.medicines, "med_id", "has_medicine")
    marked = mark_known_or_none(marked, "doctor_id", t.doctors, "doctor_id", "has_doctor")
    accepted, refused = split(
        marked,
        [
            (F.col("quantity") >= 1, "Quantity must be at least 1"),
            (F.col("has_record"), "Unknown medical record"),
            (F.col("has_medicine"), "Unknown medicine"),
            (F.col("has_doctor"), "Unknown doctor"),
        ],
    )
    accepted = stage(accepted)
    headers = (
        accepted.groupBy("record_id")
        .agg(F.min(F.struct("seq", "doctor_id")).alias("first"))
        .select("record_id", "first.seq", "first.doctor_id")
    )
    numbered = stage(new_ids(headers, "seq", t, "prescriptions"))
    lines = accepted.join(numbered.select("record_id", "presc_id"), "record_id")
    if "detail_id" in t.presc_details.columns:
        lines = new_ids(lines, "seq", t, "presc_details")
    kept = [c for c in ("detail_id", "presc_id", "med_id", "quantity", "dosage") if c in lines.columns]
    return Changes(
        inserts={
            "prescriptions": numbered.select("presc_id", "record_id", "doctor_id"),
            "presc_details": lines.select("seq", *kept),
        },
        rejected=reject(refused),
    )


def prescribe_and_price(
    commands: DataFrame, t: Tables, as_of: datetime, stage: Stage = keep
) -> Changes:
    """New lines, and in turn the invoices they reprice and the beds that frees."""
    written = prescribe(commands, t, stage)
    after = written.apply(t)
    return written.then(reprice_invoices(line_changes(written), after, as_of, stage=stage))


def line_changes(changes: Changes) -> DataFrame:
    """(presc_id, change_seq) of inserted lines, as the repricing rule wants them."""
    return changes.inserts["presc_details"].select("presc_id", F.col("seq").alias("change_seq"))
