"""UPDATE, DELETE and INSERT as joins that produce a new table state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def updated(table: DataFrame, key: str, changes: DataFrame, only_touched: bool = False) -> DataFrame:
    """Overwrite the columns of ``changes`` (one row per key) where keys match; all rows, or the matching ones.

    A new value of NULL does overwrite.  The change side is as large as the
    batch, so the optimizer can broadcast it when it is small and leave the
    table unshuffled.
    """
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, F.struct(*fields).alias("_new"))
    joined = table.join(new, key, "inner" if only_touched else "left")
    hit = F.col("_new").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c)
            if c in fields
            else F.col(c)
            for c in table.columns
        ]
    )


def without(table: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    return table.join(removed.select(key), key, "left_anti")


def with_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows; missing columns become NULL, types follow the table."""
    aligned = rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table.schema.fields
        ]
    )
    return table.unionByName(aligned)


def last_per_key(commands: DataFrame, key: str, sequence: str) -> DataFrame:
    """The latest command per key, combined before the shuffle."""
    return (
        commands.groupBy(key)
        .agg(F.max(F.struct(sequence, *[c for c in commands.columns if c not in (key, sequence)])).alias("_last"))
        .select(key, "_last.*")
    )
