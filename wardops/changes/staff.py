"""Staff joining, moving and leaving; logins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from wardops.changes.core import UNKNOWN_USER, Changes, audit_of, first_per, mark_user, reject, split
from wardops.functions import text
from wardops.operators.access import gate
from wardops.operators.numbering import dense_number, last_id
from wardops.operators.references import delete_closure
from wardops.operators.rewrite import last_per_key
from wardops.operators.spread import skew_join
from wardops.schemas import ADMIN, DOCTOR, HR, LOGIN_ACTION
from wardops.session import Stage, keep
from wardops.tables import Tables

# Messages to refused executors.
ADD_DENIED = "Permission Denied: Only Admin or HR can add new staff"
DELETE_DENIED = "Permission Denied: Only Admin or HR can delete staff"
REQUIRED = ["full_name", "phone", "email", "username", "password"]


def add_staff(
    commands: DataFrame, t: Tables, as_of: datetime, stage: Stage = keep
) -> Changes:
    """A user account, a staff row and, for doctors, a doctor row per command.

    Commands (seq, executor_id, full_name, dob, gender, phone, email,
    dept_name, role_name, username, password, specialty).  All three rows are
    made or none.  User names and addresses may be used once.
    """
    # From here on a password is only its hash, so that none is staged.
    hashed = commands.withColumn("password", F.when(text.filled(F.col("password")), F.sha2("password", 256)))
    allowed, denied = gate(hashed.withColumnRenamed("role_name", "new_role"), t, [ADMIN, HR], ADD_DENIED)
    complete = F.lit(True)
    for name in REQUIRED:
        complete = complete & text.filled(F.col(name))
    departments = t.departments.groupBy("dept_name").agg(F.min("dept_id").alias("dept_id"))
    roles = t.roles.groupBy(F.col("role_name").alias("new_role")).agg(F.min("role_id").alias("role_id"))
    placed = stage(skew_join(skew_join(allowed, departments, ["dept_name"], "left"), roles, ["new_role"], "left"))
    valid, invalid = split(
        placed,
        [
            (complete, "Please fill in all required fields"),
            (F.col("dept_id").isNotNull(), "Unknown department"),
            (F.col("role_id").isNotNull(), "Unknown role"),
        ],
    )
    by_name = valid.groupBy("username").agg(F.min("seq").alias("seq"))
    by_mail = valid.groupBy("email").agg(F.min("seq").alias("seq"))
    new_name = by_name.join(t.users.select("username"), "username", "left_anti").select(
        "seq", F.lit(True).alias("new_name")
    )
    new_mail = by_mail.join(t.staff.select("email"), "email", "left_anti").select(
        "seq", F.lit(True).alias("new_mail")
    )
    accepted, repeated = split(
        stage(valid.join(new_name, "seq", "left").join(new_mail, "seq", "left")),
        [
            (F.col("new_name"), "User name is taken"),
            (F.col("new_mail"), "Email address is taken"),
        ],
    )
    numbered = stage(dense_number(accepted, "seq", "number"))
    user_id = (F.col("number") + last_id(t, "users")).alias("user_id")
    staff_id = (F.col("number") + last_id(t, "staff")).alias("staff_id")
    doctors = dense_number(
        numbered.filter((F.col("new_role") == DOCTOR) & text.filled(F.col("specialty"))), "seq", "doctor_number"
    )
    doctor_id = (F.col("doctor_number") + last_id(t, "doctors")).alias("doctor_id")
    action = F.concat(F.lit("Added new staff member: "), "full_name")
    return Changes(
        inserts={
            "users": numbered.select(
                user_id, "username", F.col("password").alias("password_hash"), "role_id"
            ),
            "staff": numbered.select(
                staff_id, "full_name", "dob", "gender", F.col("phone").alias("phone_number"), "email",
                user_id, "dept_id",
            ),
            "doctors": doctors.select(doctor_id, staff_id, "specialty"),
        },
        audit=audit_of(numbered, "executor_id", action, as_of),
        rejected=reject(denied).unionByName(reject(invalid)).unionByName(reject(repeated)),
    )


def transfer_staff(commands: DataFrame, t: Tables, as_of: datetime) -> Changes:
    """Commands (seq, executor_id, staff_name, dept_name), both given by name.

    Of namesakes the highest staff id moves; of equal department names the
    lowest id counts.  The last command per person wins.
    """
    people = t.staff.groupBy(F.col("full_name").alias("staff_name")).agg(F.max("staff_id").alias("staff_id"))
    departments = t.departments.groupBy("dept_name").agg(F.min("dept_id").alias("dept_id"))
    placed = skew_join(skew_join(commands, people, ["staff_name"], "left"), departments, ["dept_name"], "left")
    accepted, refused = split(
        mark_user(placed, t),
        [
            (F.col("staff_id").isNotNull(), "Unknown staff member"),
            (F.col("dept_id").isNotNull(), "Unknown department"),
            (F.col("has_user"), UNKNOWN_USER),
        ],
    )
    moves = last_per_key(accepted.select("staff_id", "seq", "dept_id"), "staff_id", "seq")
    action = F.concat(F.lit("Transferred staff "), "staff_name", F.lit(" to "), "dept_name")
    return Changes(
        updates={"staff": moves.select("staff_id", "dept_id")},
        audit=audit_of(accepted, "executor_id", action, as_of),
        rejected=reject(refused),
    )


def delete_staff(
    commands: DataFrame, t: Tables, as_of: datetime, stage: Stage = keep
) -> Changes:
    """Commands (seq, staff_id, executor_id): the doctor row goes, then the staff row.

    A doctor with appointments, admissions or prescriptions cannot be removed.
    """
    allowed, denied = gate(commands, t, [ADMIN, HR], DELETE_DENIED)
    asked = allowed.select(F.col("staff_id").alias("root")).distinct()
    closure = delete_closure(t, "staff", asked, {"doctors"})
    in_use = closure.blocked.select(F.col("root").alias("staff_id"), F.lit(True).alias("in_use"))
    accepted, blocked = split(
        skew_join(allowed, in_use, ["staff_id"], "left"),
        [(F.col("in_use").isNull(), "Doctor still has appointments, admissions or prescriptions")],
    )
    accepted = stage(accepted)
    gone = accepted.select("staff_id").distinct()
    logged = (
        accepted.join(first_per(accepted, "staff_id"), "seq", "left")
        .join(t.staff.select("staff_id", "full_name"), "staff_id", "left")
    )
    action = F.when(F.col("is_first"), F.concat(F.lit("Deleted staff member: "), "full_name"))
    return Changes(
        deletes=closure.keys(gone.select(F.col("staff_id").alias("root"))),
        audit=audit_of(logged, "executor_id", action, as_of),
        rejected=reject(denied).unionByName(reject(blocked)),
    )


def log_logins(commands: DataFrame, t: Tables, as_of: datetime) -> Changes:
    """Commands (seq, user_id): one audit row per login of a known user."""
    accepted, refused = split(mark_user(commands, t, "user_id"), [(F.col("has_user"), UNKNOWN_USER)])
    return Changes(
        audit=audit_of(accepted, "user_id", F.lit(LOGIN_ACTION), as_of), rejected=reject(refused)
    )
