"""The result of a rule and how it becomes a new table state."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from wardops.functions import clock
from wardops.operators.numbering import gives_ids, highest_id, id_mark, new_ids
from wardops.operators.pruning import PARTITION_COLUMNS
from wardops.operators.rewrite import updated, with_rows, without
from wardops.operators.spread import skew_join
from wardops.schemas import DEFAULTS, KEYS
from wardops.tables import Tables


@dataclass
class Changes:
    """Touched rows per table.

    ``inserts`` hold new rows, ``updates`` the key and the changed columns (one
    row per key), ``deletes`` the keys.  ``audit`` has (seq, user_id, action,
    timestamp), without ids yet.  ``rejected`` keeps refused commands and why.
    """

    inserts: dict[str, DataFrame] = field(default_factory=dict)
    updates: dict[str, DataFrame] = field(default_factory=dict)
    deletes: dict[str, DataFrame] = field(default_factory=dict)
    audit: DataFrame | None = None
    rejected: DataFrame | None = None

    def then(self, later: "Changes") -> "Changes":
        """Both changes as one, where they update different columns or tables."""
        shared = {
            name
            for part in ("inserts", "updates", "deletes")
            for name in getattr(self, part)
            if name in getattr(later, part)
        }
        if shared or (self.audit is not None and later.audit is not None):
            raise ValueError(f"changes overlap: {sorted(shared) or 'audit'}")
        refused = [r for r in (self.rejected, later.rejected) if r is not None]
        return Changes(
            inserts={**self.inserts, **later.inserts},
            updates={**self.updates, **later.updates},
            deletes={**self.deletes, **later.deletes},
            audit=later.audit if self.audit is None else self.audit,
            rejected=refused[0].unionByName(refused[1]) if len(refused) == 2 else (refused or [None])[0],
        )

    def touched(self) -> list[str]:
        named = [*self.deletes, *self.updates, *self.inserts]
        if self.audit is not None:
            named.append("audit_logs")
        return list(dict.fromkeys(named))

    def audit_rows(self, t: Tables) -> DataFrame:
        return new_ids(self.audit, "seq", t, "audit_logs").drop("seq")

    def apply(self, t: Tables) -> Tables:
        """The tables afterwards; ids of deleted rows stay used."""
        after: dict[str, DataFrame] = {}
        marks: dict[str, DataFrame] = {}
        for name in self.touched():
            # New rows carry no partition value; the snapshot writer derives it.
            table = t[name].drop(*PARTITION_COLUMNS)
            if name in self.deletes:
                table = without(table, KEYS[name], self.deletes[name])
            if name in self.updates:
                table = updated(table, KEYS[name], self.updates[name])
            if name in self.inserts:
                table = with_rows(table, with_defaults(name, self.inserts[name]))
            if name == "audit_logs" and self.audit is not None:
                table = with_rows(table, self.audit_rows(t))
            after[name] = table
            if gives_ids(name, table) and (name in self.deletes or name in t.id_marks):
                marks[name] = id_mark(t, name)
                for given in self._new_rows(name, t):
                    marks[name] = marks[name].unionByName(highest_id(name, given))
        return t.replace(**after).marked(marks)

    def _new_rows(self, name: str, t: Tables) -> list[DataFrame]:
        rows = [self.inserts[name]] if name in self.inserts else []
        return [*rows, self.audit_rows(t)] if name == "audit_logs" and self.audit is not None else rows


def with_defaults(name: str, rows: DataFrame) -> DataFrame:
    """Fill the declared column defaults where a column is missing or NULL."""
    for column, value in DEFAULTS.get(name, {}).items():
        if column in rows.columns:
            filled = F.coalesce(F.col(column), F.lit(value).cast(rows.schema[column].dataType))
        else:
            filled = F.lit(value)
        rows = rows.withColumn(column, filled)
    return rows


def audit_of(commands: DataFrame, user: str, action: Column, as_of: datetime) -> DataFrame:
    return commands.select(
        "seq", F.col(user).alias("user_id"), action.alias("action"),
        clock.instant(as_of).alias("timestamp"),
    )


def split(commands: DataFrame, checks: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the first check that does not hold gives the reason.

    A command without a sequence number is always refused.
    """
    reason = F.lit(None).cast("string")
    checks = [(F.col("seq").isNotNull(), "No sequence number"), *checks]
    for holds, message in reversed(checks):
        reason = F.when(~F.coalesce(holds, F.lit(False)), message).otherwise(reason)
    judged = commands.withColumn("reason", reason)
    return (
        judged.filter(F.col("reason").isNull()).drop("reason"),
        judged.filter(F.col("reason").isNotNull()),
    )


def mark_known(commands: DataFrame, column: str, parent: DataFrame, key: str, flag: str) -> DataFrame:
    """Add a flag: does ``column`` refer to an existing parent row."""
    parents = parent.select(F.col(key).alias(column), F.lit(True).alias(flag))
    return skew_join(commands, parents, [column], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def mark_known_or_none(commands: DataFrame, column: str, parent: DataFrame, key: str, flag: str) -> DataFrame:
    """Add a flag: ``column`` is empty or refers to an existing parent row."""
    return mark_known(commands, column, parent, key, flag).withColumn(flag, F.col(flag) | F.col(column).isNull())


UNKNOWN_USER = "Unknown user"


def mark_user(commands: DataFrame, t: Tables, user: str = "executor_id") -> DataFrame:
    """Add ``has_user``: audit rows may name a known user or none."""
    marked = mark_known(commands, user, t.users, "user_id", "has_user")
    return marked.withColumn("has_user", F.col("has_user") | F.col(user).isNull())


def reject(refused: DataFrame) -> DataFrame:
    """All rejected frames share one shape: (seq, reason)."""
    return refused.select("seq", "reason")


def first_per(commands: DataFrame, key: str) -> DataFrame:
    """The sequence number of the first command per key.

    Keyed by sequence, not by ``key``, so that marking the commands is a join
    on a unique column even when one key fills much of the batch.
    """
    return commands.groupBy(key).agg(F.min("seq").alias("seq")).select(
        "seq", F.lit(True).alias("is_first")
    )
