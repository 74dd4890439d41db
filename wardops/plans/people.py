"""Staff, doctors, users and reference lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardops.operators.access import permitted, with_role
from wardops.operators.spread import skew_join
from wardops.schemas import ACCOUNTANT, ADMIN, DOCTOR, HR, RECEPTIONIST
from wardops.tables import Tables


def staff_directory(t: Tables, dept_name: str | None = None, role_name: str | None = None) -> DataFrame:
    departments, roles = t.departments, t.roles
    if dept_name is not None:
        departments = departments.filter(F.col("dept_name") == dept_name)
    if role_name is not None:
        roles = roles.filter(F.col("role_name") == role_name)
    accounts = t.users.select("user_id", "role_id").join(roles, "role_id")
    return (
        t.staff.join(departments, "dept_id")
        .join(accounts, "user_id")
        .select("staff_id", "full_name", "role_name", "dept_name", "phone_number", "email")
    )


def staff_by_department(t: Tables, dept_id: int | None = None) -> DataFrame:
    staff = t.staff if dept_id is None else t.staff.filter(F.col("dept_id") == dept_id)
    return staff.join(t.departments, "dept_id").select(
        "staff_id", "full_name", "phone_number", "dept_name"
    )


def doctor_appointment_counts(t: Tables) -> DataFrame:
    """Every doctor, those without appointments too.

    Appointments are counted per doctor before any name is joined, so only one
    row per doctor reaches the joins.
    """
    booked = (
        t.appointments.filter(F.col("doctor_id").isNotNull())
        .groupBy("doctor_id")
        .agg(F.count("appt_id").alias("booked"))
    )
    staff = t.staff.select("staff_id", "full_name", "dept_id", "phone_number", "email")
    return (
        t.doctors.join(staff, "staff_id")
        .join(t.departments, "dept_id")
        .join(booked, "doctor_id", "left")
        .select(
            "doctor_id", "full_name", "specialty", "dept_name", "phone_number", "email",
            F.coalesce("booked", F.lit(0)).alias("total_appointments"),
        )
        .orderBy("dept_name", "full_name", "doctor_id")
    )


def doctor_profile(t: Tables, doctor_id: int | None = None, staff_id: int | None = None) -> DataFrame:
    doctors = t.doctors
    if doctor_id is not None:
        doctors = doctors.filter(F.col("doctor_id") == doctor_id)
    if staff_id is not None:
        doctors = doctors.filter(F.col("staff_id") == staff_id)
    return (
        doctors.join(t.staff.select("staff_id", "full_name", "dept_id"), "staff_id")
        .join(t.departments, "dept_id")
        .select("doctor_id", "staff_id", "full_name", "specialty", "dept_name")
    )


def staff_accounts(t: Tables) -> DataFrame:
    return (
        t.staff.select("staff_id", "full_name", "user_id")
        .join(t.users.select("user_id", "username"), "user_id")
        .orderBy("full_name", "staff_id")
        .select("full_name", "user_id", "username")
    )


def users_by_role(t: Tables) -> DataFrame:
    """Every role name, unused ones too."""
    held = t.users.groupBy("role_id").agg(F.count("user_id").alias("held"))
    return (
        t.roles.join(held, "role_id", "left")
        .groupBy("role_name")
        .agg(F.sum(F.coalesce("held", F.lit(0))).cast("bigint").alias("user_count"))
    )


def executor_roles(t: Tables, executors: DataFrame) -> DataFrame:
    """What each executor may do; unknown users have no role and no rights."""
    distinct = executors.select("executor_id").distinct()
    return with_role(distinct, t).select(
        "executor_id",
        "role_name",
        permitted([ACCOUNTANT]).alias("may_take_payment"),
        permitted([ACCOUNTANT, ADMIN]).alias("may_read_revenue"),
        permitted([ADMIN, HR]).alias("may_manage_staff"),
        permitted([ADMIN, RECEPTIONIST]).alias("may_delete_appointment"),
    )


def reference_lists(t: Tables) -> DataFrame:
    """Patients, departments and roles as pick lists, each by name."""
    def entries(name: str, rows: DataFrame, key: str, label: str, phone):
        return rows.select(
            F.lit(name).alias("list_name"), F.col(key).cast("bigint").alias("entry_id"),
            F.col(label).alias("entry_name"), phone.cast("string").alias("phone"),
        )

    nothing = F.lit(None)
    return (
        entries("patients", t.patients, "patient_id", "full_name", F.col("phone"))
        .unionByName(entries("departments", t.departments, "dept_id", "dept_name", nothing))
        .unionByName(entries("roles", t.roles, "role_id", "role_name", nothing))
        .orderBy("list_name", "entry_name", "entry_id")
    )


def resolve_logins(t: Tables, attempts: DataFrame, accept_plain: bool = False) -> DataFrame:
    """Check attempts (attempt_id, username, password) and find who each one is.

    Only the SHA-256 of the password is compared; ``accept_plain`` also admits
    accounts whose stored value is the plain text.  A person with several staff
    or doctor rows gets the lowest id.
    """
    first_staff = t.staff.groupBy("user_id").agg(F.min(F.struct("staff_id", "full_name")).alias("person"))
    first_doctor = t.doctors.groupBy("staff_id").agg(F.min("doctor_id").alias("doctor_id"))
    accounts = (
        t.users.join(t.roles, "role_id")
        .join(first_staff, "user_id", "left")
        .select(
            "username", "user_id", "password_hash", "role_name",
            F.coalesce("person.full_name", "username").alias("full_name"), "person.staff_id",
        )
        .join(first_doctor, "staff_id", "left")
        .withColumn("doctor_id", F.when(F.col("role_name") == DOCTOR, F.col("doctor_id")))
    )
    match = F.col("password_hash") == F.sha2(F.col("password"), 256)
    if accept_plain:
        match = match | (F.col("password_hash") == F.col("password"))
    granted = F.coalesce(match, F.lit(False))
    found = ["user_id", "role_name", "full_name", "staff_id", "doctor_id"]
    return skew_join(attempts, accounts, ["username"], "left").select(
        "attempt_id", "username", granted.alias("granted"),
        *[F.when(granted, F.col(c)).alias(c) for c in found],
    )
