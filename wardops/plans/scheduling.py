"""Appointments and doctors' time."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from wardops.functions import clock, text
from wardops.operators.asof import next_after
from wardops.operators.exclusion import not_in
from wardops.operators.slots import busy_doctors
from wardops.tables import Tables

# States of each kind of list, and its lengths.
STARTED = ["CheckedIn", "In-Progress"]
EXPECTED = ["Scheduled", "CheckedIn"]
SEEN = ["CheckedIn", "In-Progress", "Completed"]
SCHEDULE_DAYS = 7
REFERRAL_MINUTES = 5
REFERRAL_CHOICES = 10


def _doctor_names(t: Tables) -> DataFrame:
    return t.doctors.join(t.staff.select("staff_id", "full_name"), "staff_id").select(
        "doctor_id", "specialty", F.col("full_name").alias("doctor_name")
    )


def _placed_doctors(t: Tables) -> DataFrame:
    """Doctors with name and department."""
    return (
        t.doctors.join(t.staff.select("staff_id", "full_name", "dept_id"), "staff_id")
        .join(t.departments, "dept_id")
        .select("doctor_id", "staff_id", "full_name", "specialty", "dept_name")
    )


def _patient_names(t: Tables) -> DataFrame:
    return t.patients.select("patient_id", F.col("full_name").alias("patient_name"))


def _booked(t: Tables, appointments: DataFrame) -> DataFrame:
    patients = t.patients.select(
        "patient_id", F.col("full_name").alias("patient_name"), F.col("phone").alias("patient_phone")
    )
    return (
        appointments.join(patients, "patient_id")
        .join(_doctor_names(t), "doctor_id")
        .select(
            "appt_id", "patient_name", "patient_phone", "doctor_name", "appt_date",
            F.col("status").alias("appt_status"),
        )
    )


def receptionist_appointments(t: Tables) -> DataFrame:
    return _booked(t, t.appointments).orderBy("appt_date", "appt_id")


def today_appointments(t: Tables, as_of: datetime, status: str | None = None) -> DataFrame:
    today = t.appointments.filter(clock.on_day(F.col("appt_date"), as_of))
    if status is not None:
        today = today.filter(F.col("status") == status)
    return (
        _booked(t, today)
        .select(
            "appt_id", "patient_name", F.col("patient_phone").alias("phone"), "doctor_name",
            "appt_date", F.col("appt_status").alias("status"),
            clock.clock_text(F.col("appt_date")).alias("clock"),
            text.status_badge(F.col("appt_status")).alias("badge"),
        )
        .orderBy("appt_date", "appt_id")
    )


def today_appointment_count(t: Tables, as_of: datetime, status: str | None = None) -> DataFrame:
    return today_appointments(t, as_of, status).agg(F.count("*").alias("appointments"))


def doctor_work_schedule(t: Tables, as_of: datetime, doctor_name: str | None = None) -> DataFrame:
    """From a week before today onward, future included."""
    since = clock.instant(datetime.combine(as_of.date() - timedelta(days=SCHEDULE_DAYS), datetime.min.time()))
    doctors = _doctor_names(t)
    if doctor_name is not None:
        doctors = doctors.filter(F.col("doctor_name") == doctor_name)
    at = F.col("appt_date")
    return (
        t.appointments.filter(at >= since)
        .join(doctors, "doctor_id")
        .join(_patient_names(t), "patient_id")
        .orderBy("appt_date", "appt_id")
        .select(
            "appt_id", "doctor_name", "specialty",
            F.to_date(at).alias("schedule_date"),
            clock.time_text(at).alias("schedule_time"),
            "patient_name",
            clock.visit_end_text(at).alias("end_time"),
            text.schedule_label(F.col("status")).alias("display_status"),
        )
    )


def doctor_day_sheet(t: Tables, as_of: datetime, doctor_name: str | None = None) -> DataFrame:
    """The schedule as the doctor sees it, with a badge per visit."""
    return (
        doctor_work_schedule(t, as_of, doctor_name)
        .select(
            "doctor_name", "appt_id", "patient_name",
            F.col("schedule_date").alias("appt_day"), F.col("schedule_time").alias("appt_time"),
            text.status_badge(F.col("display_status")).alias("badge"),
        )
        .orderBy("appt_day", "appt_time", "appt_id")
    )


def doctors_free_on_date(t: Tables, on: date | datetime) -> DataFrame:
    """Doctors without any appointment that day; a cancelled one counts as busy."""
    taken = t.appointments.filter(clock.on_day(F.col("appt_date"), on)).select("doctor_id")
    return not_in(_placed_doctors(t), "doctor_id", taken).select(
        "staff_id", "full_name", "dept_name", "specialty"
    )


def doctor_schedule_flow(t: Tables, as_of: datetime, doctor_id: int | None = None) -> DataFrame:
    """Per doctor: the visits running now, and the next one."""
    appointments = t.appointments.filter(F.col("patient_id").isNotNull())
    if doctor_id is not None:
        appointments = appointments.filter(F.col("doctor_id") == doctor_id)
    at, now = F.col("appt_date"), clock.instant(as_of)
    earliest = clock.instant(as_of - timedelta(minutes=clock.VISIT_MINUTES))
    active = (
        appointments.filter(F.col("status").isin(STARTED))
        .filter((at <= now) & (at >= earliest))
        .select(F.lit("Active").alias("flow_type"), "doctor_id", "appt_date", "patient_id")
    )
    following = (
        appointments.filter(F.col("status").isin(EXPECTED))
        .filter(at > now)
        .filter(F.col("doctor_id").isNotNull())
        .groupBy("doctor_id")
        .agg(F.min(F.struct("appt_date", "appt_id", "patient_id")).alias("visit"))
        .select(F.lit("Next").alias("flow_type"), "doctor_id", "visit.appt_date", "visit.patient_id")
    )
    names = t.patients.select("patient_id", "full_name")
    return active.unionByName(following).join(names, "patient_id").select(
        "doctor_id", "flow_type", "full_name", "appt_date",
        clock.clock_text(at).alias("clock"),
    )


def doctor_schedule_flow_at(t: Tables, asked: DataFrame) -> DataFrame:
    """``doctor_schedule_flow`` for many questions (doctor_id, as_of), each answered once.

    Running visits lie in the question's half hour or the one before; the next
    visit is an as-of lookup.
    """
    asked = asked.select("doctor_id", "as_of").dropna().distinct()
    appointments = t.appointments.filter(F.col("patient_id").isNotNull() & F.col("doctor_id").isNotNull())
    at, length = F.col("appt_date"), clock.VISIT_MINUTES * 60 * clock.MICROS

    def cell(stamp):
        return F.floor(clock.microseconds(stamp) / length)

    started = appointments.filter(F.col("status").isin(STARTED)).select(
        "doctor_id", "appt_date", "patient_id", cell(at).alias("_cell")
    )
    halves = F.explode(F.array(cell(F.col("as_of")) - 1, cell(F.col("as_of"))))
    earliest = clock.minutes_from(F.col("as_of"), -clock.VISIT_MINUTES)
    active = (
        asked.withColumn("_cell", halves)
        .join(started, ["doctor_id", "_cell"])
        .filter((at <= F.col("as_of")) & (at >= earliest))
        .select(F.lit("Active").alias("flow_type"), "doctor_id", "as_of", "appt_date", "patient_id")
    )
    expected = appointments.filter(F.col("status").isin(EXPECTED)).withColumn("as_of", at)
    visit = F.struct("appt_date", "appt_id", "patient_id")
    following = (
        next_after(asked, expected, ["doctor_id"], "as_of", visit)
        .filter(F.col("next").isNotNull())
        .select(F.lit("Next").alias("flow_type"), "doctor_id", "as_of", "next.appt_date", "next.patient_id")
    )
    names = t.patients.select("patient_id", "full_name")
    return active.unionByName(following).join(names, "patient_id").select(
        "as_of", "doctor_id", "flow_type", "full_name", "appt_date", clock.clock_text(at).alias("clock")
    )


def _available(t: Tables, slot: datetime, other_than: int | None = None) -> DataFrame:
    doctors = _placed_doctors(t).select(
        "doctor_id", F.col("full_name").alias("doctor_name"), "specialty", "dept_name"
    )
    if other_than is not None:
        doctors = doctors.filter(F.col("doctor_id") != other_than)
    completions = (
        t.appointments.filter(F.col("status") == "Completed")
        .filter(F.col("doctor_id").isNotNull())
        .groupBy("doctor_id")
        .agg(F.max("completed_at").alias("last_free_at"))
    )
    apart = F.abs(clock.microseconds(F.col("last_free_at")) - clock.microseconds(clock.instant(slot)))
    away = F.floor(apart / (60 * clock.MICROS))
    return (
        not_in(doctors, "doctor_id", busy_doctors(t, slot))
        .join(completions, "doctor_id", "left")
        .withColumn("minutes_from_slot", F.coalesce(away, F.lit(0)).cast("bigint"))
        .select("doctor_id", "doctor_name", "specialty", "dept_name", "last_free_at", "minutes_from_slot")
    )


def slot_available_doctors(t: Tables, slot: datetime) -> DataFrame:
    """Doctors without a live visit strictly within 30 minutes of ``slot``.

    Nearest last completion first; doctors who never completed a visit lead.
    """
    return _available(t, slot).orderBy("minutes_from_slot", "doctor_id")


def referral_candidates(t: Tables, doctor_id: int, as_of: datetime) -> DataFrame:
    """The ten nearest other doctors, five minutes from now."""
    slot = as_of + timedelta(minutes=REFERRAL_MINUTES)
    return (
        _available(t, slot, other_than=doctor_id)
        .orderBy("minutes_from_slot", "doctor_id")
        .limit(REFERRAL_CHOICES)
    )


def doctor_patients_today(t: Tables, as_of: datetime, doctor_id: int | None = None) -> DataFrame:
    seen = t.appointments.filter(F.col("status").isin(SEEN)).filter(
        clock.on_day(F.col("appt_date"), as_of)
    )
    if doctor_id is not None:
        seen = seen.filter(F.col("doctor_id") == doctor_id)
    return seen.join(_patient_names(t), "patient_id").select(
        "doctor_id", "appt_id", "patient_id", "patient_name"
    )


def patient_today_appointments(t: Tables, as_of: datetime, patient_id: int | None = None) -> DataFrame:
    today = t.appointments.filter(clock.on_day(F.col("appt_date"), as_of))
    if patient_id is not None:
        today = today.filter(F.col("patient_id") == patient_id)
    return (
        today.join(_doctor_names(t), "doctor_id")
        .select(
            "patient_id", "appt_id", "doctor_name", "specialty", "appt_date", "status",
            clock.clock_text(F.col("appt_date")).alias("clock"),
            text.status_badge(F.col("status")).alias("badge"),
        )
        .orderBy("appt_date", "appt_id")
    )
