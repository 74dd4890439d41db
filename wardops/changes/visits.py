"""Bookings, visit states, records, discharges and removed appointments."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from wardops.changes.core import (
    UNKNOWN_USER, Changes, audit_of, first_per, mark_known, mark_known_or_none, mark_user, reject, split,
)
from wardops.functions import clock, text
from wardops.operators.access import gate
from wardops.operators.numbering import dense_number, last_id, new_ids
from wardops.operators.references import delete_closure
from wardops.operators.rewrite import last_per_key
from wardops.operators.sequence import LATE, marks_of, newest_only, with_marks
from wardops.operators.slots import clashing_requests, granted_requests
from wardops.operators.spread import skew_join
from wardops.schemas import ADMIN, DOMAINS, RECEPTIONIST
from wardops.session import Stage, keep, stager
from wardops.tables import Tables

# Messages on refused commands.
SLOT_TAKEN = "Doctor is not available at that time"
DELETE_DENIED = "Permission Denied: Only Admin or Receptionist can delete appointments"


def book_appointments(
    commands: DataFrame, t: Tables, as_of: datetime, check_slots: bool = False, stage: Stage = keep
) -> Changes:
    """Commands (seq, executor_id, patient_id, doctor_id, appt_date).

    Each booking makes a Scheduled appointment, an empty Unpaid invoice dated
    now and an audit entry.  ``check_slots`` also refuses times that clash with
    a live appointment of the doctor or with an accepted command of a smaller
    ``seq``, so a batch gives what its commands would give one by one.
    """
    marked = mark_known(commands, "patient_id", t.patients, "patient_id", "has_patient")
    marked = mark_known(marked, "doctor_id", t.doctors, "doctor_id", "has_doctor")
    marked = mark_user(marked, t)
    checks = [
        (F.col("has_patient"), "Unknown patient"),
        (F.col("has_doctor"), "Unknown doctor"),
        (F.col("has_user"), UNKNOWN_USER),
    ]
    if check_slots:
        taken = clashing_requests(commands, t, "seq").withColumn("clash", F.lit(True))
        marked = marked.join(taken, "seq", "left")
        checks.append((F.col("clash").isNull(), SLOT_TAKEN))
    accepted, refused = split(marked, checks)
    refused = reject(refused)
    if check_slots:
        # Rounds need written frames, asked for or not.
        stage = stager(commands.sparkSession, "bookings") if stage is keep else stage
        accepted = stage(accepted)
        granted = granted_requests(accepted, "seq", stage).withColumn("granted", F.lit(True))
        free = F.col("granted") | F.col("appt_date").isNull()
        accepted, late = split(accepted.join(granted, "seq", "left"), [(free, SLOT_TAKEN)])
        refused = refused.unionByName(reject(late))
    numbered = stage(dense_number(accepted, "seq", "number"))

    def next_id(table: str, key: str):
        return (F.col("number") + last_id(t, table)).alias(key)

    booked = numbered.select(
        next_id("appointments", "appt_id"), "patient_id", "doctor_id", "appt_date",
        F.lit(None).cast("timestamp_ntz").alias("completed_at"),
        F.lit("Scheduled").alias("status"),
    )
    bills = numbered.select(
        next_id("invoices", "invoice_id"),
        next_id("appointments", "appt_id"),
        F.lit(None).cast("bigint").alias("admission_id"),
        clock.instant(as_of).alias("invoice_date"),
        F.lit(0).cast("decimal(10,2)").alias("total_amount"),
        F.lit("Unpaid").alias("payment_status"),
        F.lit(None).cast("decimal(10,2)").alias("net_amount"),
    )
    action = F.concat(F.lit("New appointment created for patient_id: "), F.col("patient_id").cast("string"))
    return Changes(
        inserts={"appointments": booked, "invoices": bills},
        audit=audit_of(numbered, "executor_id", action, as_of),
        rejected=refused,
    )


def booking_slips(changes: Changes, t: Tables) -> DataFrame:
    """The confirmation text of every new appointment."""
    patients = t.patients.select(
        "patient_id", F.concat("full_name", F.lit(" ("), "phone", F.lit(")")).alias("patient")
    )
    doctors = t.doctors.select("doctor_id", "staff_id").join(
        t.staff.select("staff_id", F.col("full_name").alias("doctor")), "staff_id"
    )
    slip = F.concat(
        F.lit("Appointment booked for "), "patient", F.lit(" with "), "doctor", F.lit(" at "),
        clock.day_clock_text(F.col("appt_date")),
        F.lit(" (Appointment ID: "), F.col("appt_id").cast("string"), F.lit(")"),
    )
    return (
        changes.inserts["appointments"]
        .join(patients, "patient_id")
        .join(doctors, "doctor_id")
        .select("appt_id", slip.alias("slip"))
    )


def set_visit_state(commands: DataFrame, t: Tables, as_of: datetime, stage: Stage = keep) -> Changes:
    """Commands (seq, appt_id, status); the last wins.

    A Completed command stamps the completion time, even if a later command
    moves the visit on, and even if it arrives after that later one.
    """
    known = F.col("status").isin(DOMAINS["appointments", "status"])
    accepted, refused = split(commands, [(known, "Unknown appointment state")])
    chosen = accepted.groupBy("appt_id").agg(
        F.max(F.struct("seq", "status")).alias("last"),
        F.max(F.col("status") == "Completed").alias("ended"),
    )
    chosen = stage(with_marks(chosen, t, "visit-state", "appt_id", F.col("last.seq")))
    current = t.appointments.select("appt_id", "status", "completed_at")
    return Changes(
        inserts=marks_of(chosen.filter(~F.col(LATE)), t, "visit-state", "appt_id", F.col("last.seq")),
        updates={
            "appointments": current.join(chosen, "appt_id").select(
                "appt_id",
                F.when(F.col(LATE), F.col("status")).otherwise(F.col("last.status")).alias("status"),
                F.when(F.col("ended"), clock.instant(as_of))
                .otherwise(F.col("completed_at")).alias("completed_at"),
            )
        },
        rejected=reject(refused),
    )


def add_records(
    commands: DataFrame, t: Tables, as_of: datetime, stage: Stage = keep
) -> Changes:
    """Commands (seq, executor_id, appt_id, admission_id, symptoms, diagnosis, doctor_notes).

    A record on an appointment completes that appointment.
    """
    complete = text.filled(F.col("symptoms")) & text.filled(F.col("diagnosis"))
    marked = mark_known_or_none(mark_user(commands, t), "appt_id", t.appointments, "appt_id", "has_appt")
    marked = mark_known_or_none(marked, "admission_id", t.admissions, "admission_id", "has_admission")
    accepted, refused = split(
        marked,
        [
            (complete, "Please fill in symptoms and diagnosis"),
            (F.col("has_user"), UNKNOWN_USER),
            (F.col("has_appt"), "Unknown appointment"),
            (F.col("has_admission"), "Unknown admission"),
        ],
    )
    rows = stage(new_ids(accepted, "seq", t, "medical_records"))
    done = rows.filter(F.col("appt_id").isNotNull()).select("appt_id").distinct()
    parent = F.coalesce("appt_id", "admission_id").cast("string")
    action = F.concat(F.lit("Created medical record for appt/adm: "), parent)
    return Changes(
        inserts={
            "medical_records": rows.select(
                "record_id", "appt_id", "admission_id", "symptoms", "diagnosis", "doctor_notes"
            )
        },
        updates={
            "appointments": done.select(
                "appt_id", F.lit("Completed").alias("status"),
                clock.instant(as_of).alias("completed_at"),
            )
        },
        audit=audit_of(rows, "executor_id", action, as_of),
        rejected=reject(refused),
    )


def discharge(commands: DataFrame, t: Tables, as_of: datetime) -> Changes:
    """Commands (seq, admission_id, status); the bed is left as it is."""
    chosen = last_per_key(commands.select("admission_id", "seq", "status"), "admission_id", "seq")
    chosen, marks = newest_only(chosen, t, "discharge", "admission_id")
    return Changes(
        inserts=marks,
        updates={
            "admissions": chosen.select(
                "admission_id", clock.instant(as_of).alias("discharge_date"),
                F.col("status").alias("discharge_status"),
            )
        }
    )


def delete_appointments(
    commands: DataFrame, t: Tables, as_of: datetime, stage: Stage = keep
) -> Changes:
    """Commands (seq, appt_id, executor_id): invoices go first, then the appointment.

    An appointment that has a medical record cannot be removed.
    """
    allowed, refused = gate(commands, t, [ADMIN, RECEPTIONIST], DELETE_DENIED)
    asked = allowed.select(F.col("appt_id").alias("root")).distinct()
    closure = delete_closure(t, "appointments", asked, {"invoices"})
    in_use = closure.blocked.select(F.col("root").alias("appt_id"), F.lit(True).alias("in_use"))
    accepted, blocked = split(
        skew_join(allowed, in_use, ["appt_id"], "left"),
        [(F.col("in_use").isNull(), "Appointment has medical records")],
    )
    accepted = stage(accepted)
    gone = accepted.select("appt_id").distinct()
    patients = t.patients.select("patient_id", "full_name")
    names = t.appointments.select("appt_id", "patient_id").join(gone, "appt_id").join(patients, "patient_id")
    logged = (
        accepted.join(first_per(accepted, "appt_id"), "seq", "left")
        .join(names.select("appt_id", "full_name"), "appt_id", "left")
    )
    # Only the first command finds the row; a repeated one logs no name.
    action = F.when(F.col("is_first"), F.concat(F.lit("Deleted appointment for patient: "), "full_name"))
    return Changes(
        deletes=closure.keys(gone.select(F.col("appt_id").alias("root"))),
        audit=audit_of(logged, "executor_id", action, as_of),
        rejected=reject(refused).unionByName(reject(blocked)),
    )
