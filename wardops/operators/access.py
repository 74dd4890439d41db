"""Who may do what: executor → role → allowed or rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardops.operators.spread import skew_join
from wardops.tables import Tables


def with_role(rows: DataFrame, t: Tables, user: str = "executor_id") -> DataFrame:
    """Add ``role_name`` of the user; NULL where user or role is unknown."""
    roles = t.users.join(t.roles, "role_id").select(F.col("user_id").alias(user), "role_name")
    known = skew_join(rows.filter(F.col(user).isNotNull()), roles, [user], "left")
    # Rows without a user need no lookup, and must not meet in one join task.
    unknown = rows.filter(F.col(user).isNull()).withColumn("role_name", F.lit(None).cast("string"))
    return known.unionByName(unknown)


def permitted(roles: list[str]):
    """True only for a known role on the list."""
    return F.coalesce(F.col("role_name").isin(roles), F.lit(False))


def gate(
    commands: DataFrame, t: Tables, roles: list[str], message: str
) -> tuple[DataFrame, DataFrame]:
    """Split commands into (allowed, rejected with a message)."""
    judged = with_role(commands, t)
    allowed = judged.filter(permitted(roles)).drop("role_name")
    rejected = judged.filter(~permitted(roles)).drop("role_name").withColumn("reason", F.lit(message))
    return allowed, rejected
