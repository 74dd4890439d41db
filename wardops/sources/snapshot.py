"""Stored table states: one folder per snapshot, one Parquet table each.

A change never overwrites the files it reads: it writes the next snapshot.
"""

from __future__ import annotations

import json
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardops.operators.numbering import gives_ids, id_mark
from wardops.operators.pruning import partition_of
from wardops.schemas import SCHEMAS
from wardops.sources.sqltext import load_order, read_insert_statements, write_insert_statements
from wardops.tables import Tables

ID_MARKS = "_id_marks"
PARTITION_TYPES = {"invoice_month": T.IntegerType(), "log_day": T.DateType()}


def snapshot_name(when: datetime) -> str:
    return when.strftime("%Y%m%d_%H%M%S")


def _folder(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/snapshot={name}"


def table_names() -> list[str]:
    return sorted(SCHEMAS)


def write_table(name: str, table: DataFrame, folder: str) -> None:
    """Large tables are partitioned by time.

    ``rebalance`` lets adaptive execution split a month or day that holds far
    more rows than others, and merge tiny ones, so files come out even.
    """
    partition = partition_of(name)
    if partition is None:
        table.write.mode("errorifexists").parquet(folder)
        return
    column, value = partition
    (
        table.withColumn(column, value)
        .hint("rebalance", column)
        .write.mode("errorifexists")
        .partitionBy(column)
        .parquet(folder)
    )


def write_snapshot(t: Tables, root: str, when: datetime) -> str:
    """Write every table, its highest id ever given and a description of the schemas; returns the folder."""
    folder = _folder(root, snapshot_name(when))
    described = []
    marks = None
    spark = None
    for name in t:
        table = t[name]
        spark = table.sparkSession
        write_table(name, table, f"{folder}/{name}")
        described.append((name, table.schema.json()))
        if gives_ids(name, table):
            mark = id_mark(t, name).select(F.lit(name).alias("table_name"), "last_id")
            marks = mark if marks is None else marks.unionByName(mark)
    if marks is not None:
        marks.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/{ID_MARKS}")
    if spark is not None:
        schemas = spark.createDataFrame(described, "table_name string, schema_json string")
        schemas.coalesce(1).write.mode("errorifexists").json(f"{folder}/_schemas")
    return folder


def write_sql_snapshot(t: Tables, root: str, when: datetime) -> str:
    """The same as SQL text, one folder of statement files per table."""
    folder = f"{root.rstrip('/')}/sql_snapshot={snapshot_name(when)}"
    for name in t:
        write_insert_statements(name, t[name], f"{folder}/{name}")
    return folder


def read_sql_snapshot(spark: SparkSession, folder: str, names: list[str]) -> Tables:
    """Tables written as SQL text, referred-to tables first."""
    return Tables({name: read_insert_statements(spark, name, f"{folder.rstrip('/')}/{name}") for name in load_order(names)})


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds the values of both: the wider number, else text."""
    if a == b:
        return a
    digits = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}
    if a in digits and b in digits:
        return max(a, b, key=digits.get)
    decimal = [T.DecimalType(digits[x], 0) if x in digits else x for x in (a, b)]
    if all(isinstance(x, T.DecimalType) for x in decimal):
        scale = max(x.scale for x in decimal)
        return T.DecimalType(min(38, scale + max(x.precision - x.scale for x in decimal)), scale)
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    return T.StringType()


def read_versions(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table out of all snapshots under ``root``, with the column ``snapshot``.

    Every snapshot is read by the schema it was stored with.  A column that some
    lack is NULL there, a column stored in several types takes one that holds
    them all.  Snapshots of one schema are read together.
    """
    base = root.rstrip("/")
    stored = (
        spark.read.option("basePath", base).schema("table_name string, schema_json string, snapshot string")
        .json(f"{base}/snapshot=*/_schemas").filter(F.col("table_name") == name)
    )
    versions: dict[str, list[str]] = {}
    for row in stored.collect():  # one row a snapshot
        versions.setdefault(row.schema_json, []).append(row.snapshot)
    if not versions:
        raise ValueError(f"no snapshot of {name} under {root}")
    schemas = {text: T.StructType.fromJson(json.loads(text)) for text in versions}
    columns: dict[str, T.DataType] = {}
    for text in sorted(schemas):
        for field in schemas[text].fields:
            columns[field.name] = _wider(columns.get(field.name, field.dataType), field.dataType)
    parts = []
    for text, snapshots in sorted(versions.items()):
        rows = spark.read.schema(schemas[text]).parquet(*[f"{base}/snapshot={s}/{name}" for s in sorted(snapshots)])
        own = set(schemas[text].names)
        parts.append(rows.select(
            F.regexp_extract("_metadata.file_path", "/snapshot=([^/]+)/", 1).alias("snapshot"), *[(F.col(c) if c in own else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]
        ))
    return reduce(DataFrame.unionByName, parts)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Explicit schema; a column that older files lack reads as NULL."""
    schema = T.StructType(list(SCHEMAS[name].fields))
    partition = partition_of(name)
    if partition is not None:
        schema = schema.add(partition[0], PARTITION_TYPES[partition[0]], True)
    return spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}")


def read_snapshot(spark: SparkSession, folder: str) -> Tables:
    tables = Tables({name: lambda name=name: read_table(spark, folder, name) for name in SCHEMAS})
    try:
        marks = spark.read.schema("table_name string, last_id bigint").parquet(f"{folder.rstrip('/')}/{ID_MARKS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return tables  # an older snapshot: ids follow the highest that is left
    numbered = [name for name, schema in SCHEMAS.items() if isinstance(schema.fields[0].dataType, T.IntegralType)]
    return tables.marked({name: marks.filter(F.col("table_name") == name).select("last_id") for name in numbered})
