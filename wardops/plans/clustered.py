"""The bill over tables stored by visit: every join finds its rows in the same bucket.

``write_visit_store`` lays what a bill needs out by ``(visit_kind, visit_id)``, bucketed
and sorted, one file a bucket: invoices, records with their prescribed lines, and the
visit's patient with each policy.  Readers then join without moving a row; records,
prescriptions and lines, whose joins need further keys, were joined when they were
stored.  A store belongs to one state of the tables and is never changed; the next
state gets its own.

Rows with two parents are stored under each of them, except invoices: the few
invoices with two parents are billed when the store is written.  Invoices without
a parent get a key of their own that matches nothing.  All rows of one visit lie in
one bucket, sorted, and are streamed through the joins; a visit that holds a large
part of all lines makes its bucket as large, and ``billing.patient_bill``, which
splits hot keys, is then the better plan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardops.functions import money
from wardops.operators.coverage import rate_or_zero
from wardops.operators.parents import VISIT_KEY, per_parent, single_parent, two_parents, visits
from wardops.operators.spread import skew_join
from wardops.plans.billing import patient_bill, policies, treatments
from wardops.tables import Tables

BUCKETS = 200
CLUSTERED = ["bill_invoices", "bill_treatments", "bill_covers"]
DOUBLE = "bill_double"


def _layout(t: Tables) -> dict[str, DataFrame]:
    invoices = t.invoices.select(
        "invoice_id", "invoice_date", "appt_id", "admission_id", "total_amount", "net_amount", "payment_status"
    )
    return {
        "bill_invoices": single_parent(invoices, "invoice_id").drop("appt_id", "admission_id"),
        "bill_treatments": per_parent(treatments(t)).drop("appt_id", "admission_id"),
        "bill_covers": skew_join(visits(t).select(*VISIT_KEY, "patient_id"), policies(t), ["patient_id"]).drop("patient_id"),
    }


def write_visit_store(t: Tables, folder: str, buckets: int = BUCKETS) -> str:
    """Write the store and a description of it; returns its folder."""
    spark = t.invoices.sparkSession
    described = []
    for name, rows in _layout(t).items():
        rows = rows.withColumn("visit_id", F.col("visit_id").cast("bigint"))
        table = f"{name}_{uuid.uuid4().hex}"
        (
            rows.repartition(buckets, *VISIT_KEY)
            .write.bucketBy(buckets, *VISIT_KEY).sortBy(*VISIT_KEY)
            .option("path", f"{folder}/{name}").format("parquet").saveAsTable(table)
        )
        described.append((name, ", ".join(f"{c} {kind}" for c, kind in rows.dtypes), buckets))
        spark.sql(f"DROP TABLE {table}")  # the files stay: a table with a path of its own
    double = patient_bill(t.replace(invoices=two_parents(t.invoices)))
    double.write.parquet(f"{folder}/{DOUBLE}")
    spark.createDataFrame(described, "name string, columns string, buckets int").coalesce(1).write.json(f"{folder}/_layout")
    return folder


def read_visit_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored tables; the session's catalog learns how each of them is bucketed."""
    layout = {r.name: r for r in spark.read.schema("name string, columns string, buckets int").json(f"{folder}/_layout").collect()}
    found = {DOUBLE: spark.read.parquet(f"{folder}/{DOUBLE}")}
    keys = ", ".join(VISIT_KEY)
    for name in CLUSTERED:
        table = f"{name}_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {table} ({layout[name].columns}) USING parquet "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout[name].buckets} BUCKETS LOCATION '{folder}/{name}'"
        )
        found[name] = spark.table(table)
    return found


def clustered_bill(store: dict[str, DataFrame]) -> DataFrame:
    """``patient_bill`` without an exchange: one row per paid invoice, record, prescription, line and policy."""
    paid = store["bill_invoices"].filter(F.col("payment_status") == "Paid")
    billed = paid.join(store["bill_covers"], VISIT_KEY, "left").join(store["bill_treatments"], VISIT_KEY, "left")
    rate = rate_or_zero(F.col("coverage_rate"))
    own = billed.select(
        "invoice_id", "invoice_date", "patient_name", "doctor_diagnosis", "medicine_name", "dosage",
        F.col("total_amount").alias("gross_amount"), rate.alias("insurance_rate"),
        F.coalesce(F.col("net_amount"), money.net_pay(F.col("total_amount"), rate)).cast("decimal(15,2)").alias("net_pay"),
    )
    return own.unionByName(store[DOUBLE])
