"""Activity, logins, the audit trail and the home counters."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from wardops.functions import clock
from wardops.operators.asof import trailing_counts
from wardops.operators.numbering import running_number
from wardops.operators.pruning import since
from wardops.operators.spread import skew_join
from wardops.schemas import LOGIN_ACTION
from wardops.tables import Tables

LATEST_ROWS = 100  # fixed value: length of the audit page


def staff_activity(t: Tables, user_id: int | None = None) -> DataFrame:
    logs = t.audit_logs.filter(F.col("user_id").isNotNull())
    if user_id is not None:
        logs = logs.filter(F.col("user_id") == user_id)
    acted = logs.groupBy("user_id").agg(
        F.count("log_id").alias("total_actions"), F.max("timestamp").alias("last_activity")
    )
    return acted.join(t.users.select("user_id", "username"), "user_id").select(
        "username", "total_actions", "last_activity"
    )


def actions_last_24h(t: Tables, as_of: datetime) -> DataFrame:
    start = clock.instant(as_of - timedelta(hours=24))
    newer = since(t.audit_logs, "timestamp", start).filter(F.col("timestamp") > start)
    return newer.agg(F.count("*").alias("action_count"))


def actions_trailing_24h(t: Tables) -> DataFrame:
    """Per instant with an action: what ``actions_last_24h`` counted at that moment."""
    stamped = t.audit_logs.filter(F.col("timestamp").isNotNull())
    counted = trailing_counts(stamped.groupBy(F.col("timestamp").alias("at")).agg(F.count("*").alias("n")))
    return counted.select(F.col("at").alias("timestamp"), F.col("trailing").alias("action_count"))


def _logins(t: Tables) -> DataFrame:
    return t.audit_logs.filter(F.col("action") == LOGIN_ACTION).filter(F.col("user_id").isNotNull())


def _accounts(t: Tables) -> DataFrame:
    return t.users.select("user_id", "username", "role_id").join(t.roles, "role_id").drop("role_id")


def login_history(t: Tables) -> DataFrame:
    """Logins numbered per user by time, newest first."""
    people = _accounts(t).join(t.staff.select("user_id", "staff_id", "full_name"), "user_id", "left")
    rows = skew_join(_logins(t).select("log_id", "user_id", "timestamp"), people, ["user_id"])
    numbered = running_number(rows, "username", "timestamp", ["log_id", "staff_id"], "login_no")
    return numbered.orderBy(F.desc("timestamp"), F.desc("log_id")).select(
        F.col("login_no").cast("bigint"), "username", "full_name", "role_name",
        F.col("timestamp").alias("login_time"),
    )


def login_frequency(t: Tables) -> DataFrame:
    """Rows of the login list per user; counted before names are joined."""
    counted = _logins(t).groupBy("user_id").agg(F.count("*").alias("logins"))
    people = t.staff.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("people"))
    listed = F.sum(F.col("logins") * F.coalesce("people", F.lit(1)))
    return (
        counted.join(_accounts(t), "user_id")
        .join(people, "user_id", "left")
        .groupBy("username")
        .agg(listed.cast("bigint").alias("total_logins"))
        .orderBy(F.desc("total_logins"), "username")
    )


def audit_latest(t: Tables, rows: int = LATEST_ROWS) -> DataFrame:
    """The newest actions of known users; names are joined to the chosen rows only."""
    newest = [F.desc("timestamp"), F.desc("log_id")]
    attributed = t.audit_logs.join(t.users.select("user_id"), "user_id", "left_semi")
    latest = attributed.orderBy(*newest).limit(rows)
    return (
        latest.join(t.users.select("user_id", "username"), "user_id")
        .orderBy(*newest)
        .select("log_id", "username", "action", "timestamp")
    )


def home_kpis(t: Tables, as_of: datetime) -> DataFrame:
    """Four counters in one row."""
    def counter(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("kpi"), "n")

    counters = {
        "patients": t.patients,
        "appointments_today": t.appointments.filter(clock.on_day(F.col("appt_date"), as_of)),
        "available_beds": t.beds.filter(F.col("status") == "Available"),
        "unpaid_invoices": t.invoices.filter(F.col("payment_status") == "Unpaid"),
    }
    stacked = None
    for name, rows in counters.items():
        one = counter(name, rows)
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.agg(
        *[F.max(F.when(F.col("kpi") == name, F.col("n"))).alias(name) for name in counters]
    )
