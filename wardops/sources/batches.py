"""Command batches derived from the tables themselves.

Used by the registered change queries, the benchmark and the tests: one or more
commands per row of a whole table, some of them deliberately wrong so that the
refusing paths are exercised too.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from wardops.functions import clock
from wardops.tables import Tables

EXECUTORS = 16


def _executor(key):
    return (key % EXECUTORS + 1).alias("executor_id")


def payments(t: Tables) -> DataFrame:
    """Every unpaid invoice, by executors of all roles."""
    key = F.col("invoice_id")
    return t.invoices.filter(F.col("payment_status") == "Unpaid").select(
        key.alias("seq"), "invoice_id", _executor(key)
    )


def payment_states(t: Tables) -> DataFrame:
    """Cancel every unpaid invoice, refund every paid one."""
    target = (
        F.when(F.col("payment_status") == "Unpaid", "Cancelled")
        .when(F.col("payment_status") == "Paid", "Refunded")
        .otherwise("Lost")
    )
    return t.invoices.select(F.col("invoice_id").alias("seq"), "invoice_id", target.alias("payment_status"))


def bookings(t: Tables, as_of: datetime) -> DataFrame:
    """One booking per patient over the coming month; some name no real doctor."""
    key = F.col("patient_id")
    pick = key % 8
    doctor = F.when(key % 50 == 0, 1).otherwise(1_000_000 + pick - F.when(pick % 4 == 3, 1).otherwise(0))
    minutes = ((key % 30) * 1440 + (key % 96) * 15).cast("int")
    start = clock.instant(datetime(as_of.year, as_of.month, as_of.day, 8))
    return t.patients.select(
        key.alias("seq"), _executor(key), "patient_id", doctor.cast("bigint").alias("doctor_id"),
        F.timestamp_add("MINUTE", minutes, start).alias("appt_date"),
    )


def visit_states(t: Tables) -> DataFrame:
    """Two commands per waiting visit; the second is sometimes not a state."""
    waiting = t.appointments.filter(F.col("status").isin("Scheduled", "CheckedIn"))
    second = F.element_at(
        F.array(F.lit("In-Progress"), F.lit("Completed"), F.lit("Done")), (F.col("appt_id") % 3 + 1).cast("int")
    )
    return waiting.select("appt_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"), second.alias("second")).select(
        (F.col("appt_id") * 2 + F.col("step")).alias("seq"),
        "appt_id",
        F.when(F.col("step") == 0, "CheckedIn").otherwise(F.col("second")).alias("status"),
    )


def records(t: Tables) -> DataFrame:
    """A record for every running visit; of ten, one lacks a diagnosis and two name a visit or stay that is not there."""
    key = F.col("appt_id")
    return t.appointments.filter(F.col("status") == "In-Progress").select(
        key.alias("seq"), _executor(key),
        F.when(key % 10 == 4, -key).otherwise(key).alias("appt_id"),
        F.when(key % 10 == 6, -key).alias("admission_id"),
        F.lit("fever").alias("symptoms"),
        F.when(key % 10 == 0, "").otherwise("influenza").alias("diagnosis"),
        F.lit("rest").alias("doctor_notes"),
    )


def prescription_lines(t: Tables) -> DataFrame:
    """Two lines per medical record; each fifth record asks for quantity 0, a quarter names nobody's doctor id, some none."""
    step = F.col("step")
    record = F.col("record_id")
    medicines = t.medicines.agg(F.count("*")).scalar()
    return t.medical_records.select("record_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("step")).select(
        (record * 2 + step).alias("seq"), "record_id",
        F.when(record % 8 != 5, record % 8 + 1_000_000).alias("doctor_id"),
        ((record * 3 + step) % medicines + 1).alias("med_id"),
        (record % 5).cast("int").alias("quantity"),
        F.lit("1 daily").alias("dosage"),
    )


def registrations(t: Tables, as_of: datetime) -> DataFrame:
    """A relative of every patient; known, shared and missing details occur."""
    key = F.col("patient_id")
    email = (
        F.when(key % 20 == 0, F.col("email"))
        .when(key % 20 == 2, "shared@example.com")
        .otherwise(F.concat(F.lit("jr."), "email"))
    )
    return t.patients.select(
        key.alias("seq"), _executor(key),
        F.concat("full_name", F.lit(" Jr")).alias("full_name"),
        "dob", "gender",
        F.when(key % 20 == 1, "").otherwise(F.col("phone")).alias("phone"),
        email.alias("email"),
        F.lit("O+").alias("blood_type"),
        F.lit("None").alias("allergies"),
        F.lit("None").alias("chronic_diseases"),
        F.when(key % 3 == 0, "Provider X").otherwise("").alias("provider"),
        (key % 104).cast("int").alias("rate_percent"),
        F.date_add(clock.day(as_of), (key % 100 - 5).cast("int")).alias("expiry_date"),
    )


def policy_changes(t: Tables) -> DataFrame:
    """Every policy prolonged by a year; some rates are out of range."""
    nth = F.substring("insurance_id", -1, 1).cast("bigint")
    return t.insurance.select(
        (F.col("patient_id") * 10 + nth).alias("seq"), "insurance_id",
        ((F.col("patient_id") * 7) % 120).cast("int").alias("rate_percent"),
        F.date_add("expiry_date", 365).alias("expiry_date"),
    )


def discharges(t: Tables) -> DataFrame:
    """Every open stay ends by transfer."""
    return t.admissions.filter(F.col("discharge_date").isNull()).select(
        F.col("admission_id").alias("seq"), "admission_id", F.lit("Transferred").alias("status")
    )


def appointment_removals(t: Tables) -> DataFrame:
    key = F.col("appt_id")
    return t.appointments.select(key.alias("seq"), "appt_id", _executor(key))


def new_staff(t: Tables) -> DataFrame:
    """A new colleague for everyone on the staff."""
    key = F.col("staff_id")
    role = F.element_at(
        F.array(*[F.lit(r) for r in ("Admin", "Doctor", "Receptionist", "Accountant", "Janitor")]),
        (key % 5 + 1).cast("int"),
    )
    return t.staff.join(t.departments, "dept_id").select(
        key.alias("seq"), _executor(key),
        F.concat("full_name", F.lit(" II")).alias("full_name"),
        F.lit("1980-01-01").cast("date").alias("dob"),
        F.lit("Female").alias("gender"),
        F.col("phone_number").alias("phone"),
        F.concat(F.lit("ii."), "email").alias("email"),
        "dept_name", role.alias("role_name"),
        F.concat(F.lit("new_"), key.cast("string")).alias("username"),
        F.lit("first password").alias("password"),
        F.lit("Pediatrics").alias("specialty"),
    )


def transfers(t: Tables) -> DataFrame:
    """Everyone moves to the next department; the last one has no next."""
    key = F.col("staff_id")
    following = t.departments.select((F.col("dept_id") - 1).alias("dept_id"), "dept_name")
    return t.staff.join(following, "dept_id", "left").select(
        key.alias("seq"), _executor(key), F.col("full_name").alias("staff_name"), "dept_name"
    )


def staff_removals(t: Tables) -> DataFrame:
    key = F.col("staff_id")
    return t.staff.select(key.alias("seq"), "staff_id", _executor(key))


def logins(t: Tables) -> DataFrame:
    return t.users.select(F.col("user_id").alias("seq"), "user_id")


def schedule_questions(t: Tables) -> DataFrame:
    """Every doctor asks ten minutes before and after each of their visits."""
    minutes = F.explode(F.array(F.expr("INTERVAL '-10' MINUTE"), F.expr("INTERVAL '10' MINUTE")))
    return t.appointments.select("doctor_id", "appt_date", minutes.alias("apart")).select(
        "doctor_id", (F.col("appt_date") + F.col("apart")).alias("as_of")
    )


def search_keywords(t: Tables) -> DataFrame:
    """For every member of staff the end of a phone number, the same with a wildcard, and two letters of the department."""
    digits = F.substring("phone_number", 7, 4)
    wild = F.concat(F.substring("phone_number", 7, 2), F.lit("_"), F.substring("phone_number", 10, 1))
    return t.staff.select(F.explode(F.array(digits, wild, F.concat(F.lit("R#%"), F.substring("phone_number", 9, 2)))).alias("keyword"))
