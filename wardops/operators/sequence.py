"""Commands that arrive late: what was decided by a newer command stays.

Within one batch the highest sequence number per key wins.  Over several
micro-batches the same holds if the number that decided each key is remembered.
``command_marks`` is an ordinary table of a state: one row per rule and key with
the deciding number and, where a rule needs it again, what was chosen.  A state
without that table (a plain batch) is not guarded.  Numbers are expected to be
unique per rule; the same command arriving twice is applied twice, to the same end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardops.tables import Tables

MARKS = "command_marks"
MARKS_SCHEMA = "command string, seq bigint, choice bigint"
LATE, APPLIED, CHOSEN = "_late", "_applied", "_chosen"


def guarded(t: Tables) -> Tables:
    """The same tables with room for marks."""
    if MARKS in t:
        return t
    spark: SparkSession = next(iter(t.values())).sparkSession
    # Known to be empty while a query is planned, so nothing is joined to it.
    return t.replace(**{MARKS: spark.createDataFrame([], MARKS_SCHEMA).limit(0)})


def _command(rule: str, key: str) -> Column:
    return F.concat(F.lit(f"{rule}:"), F.col(key).cast("string"))


def with_marks(rows: DataFrame, t: Tables, rule: str, key: str, seq: Column) -> DataFrame:
    """Add the remembered number and choice, and whether the row's own number is older.

    Marks are joined by the key they name, not by their text: rows grouped by it stay where they are.
    """
    if MARKS not in t:
        none = F.lit(None).cast("bigint")
        return rows.withColumns({APPLIED: none, CHOSEN: none, LATE: F.lit(False)})
    own = F.col("command").startswith(f"{rule}:")
    named = F.substr("command", F.lit(len(rule) + 2)).try_cast(rows.schema[key].dataType)
    seen = t[MARKS].filter(own).select(named.alias(key), F.col("seq").alias(APPLIED), F.col("choice").alias(CHOSEN))
    found = rows.join(seen, key, "left").select(*rows.columns, APPLIED, CHOSEN)
    return found.withColumn(LATE, F.coalesce(seq < F.col(APPLIED), F.lit(False)))


def marks_of(decided: DataFrame, t: Tables, rule: str, key: str, seq: Column, choice: Column | None = None) -> dict[str, DataFrame]:
    """The marks to keep for rows that were decided, as inserts of a change."""
    if MARKS not in t:
        return {}
    kept = F.lit(None) if choice is None else choice
    return {
        MARKS: decided.select(
            _command(rule, key).alias("command"), seq.cast("bigint").alias("seq"), kept.cast("bigint").alias("choice")
        )
    }


def newest_only(chosen: DataFrame, t: Tables, rule: str, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One row per key with its ``seq``: those no newer command has decided, and their marks."""
    marked = with_marks(chosen, t, rule, key, F.col("seq"))
    fresh = marked.filter(~F.col(LATE)).select(*chosen.columns)
    return fresh, marks_of(fresh, t, rule, key, F.col("seq"))
