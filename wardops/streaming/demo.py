"""Rules run as streams over the stored tables, for the registered queries.

The files of one source table arrive as a stream; each micro-batch is turned
into commands and applied.  Returned are the rows the stream has changed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardops.changes import billing, clinical, staff, visits
from wardops.changes.core import Changes
from wardops.session import configure, shared_folder, stager
from wardops.sources import batches
from wardops.sources.bridge import Bridge, bridge_tables
from wardops.streaming.rules import start_rule, stored_table
from wardops.streaming.store import REMOVED, DeltaStore
from wardops.tables import Tables

AS_OF = datetime(1999, 6, 15, 9, 55)


def _run(
    spark: SparkSession, sf_dir: str, source: str, table: str, writes: list[str],
    rule: Callable[[DataFrame, Tables], Changes], commands: Callable[[Tables], DataFrame],
    once_per: str | None = None,
) -> DeltaStore:
    """``once_per``: only the first row of each value arrives, over all micro-batches."""
    folder = shared_folder(configure(spark), f"stream-{table}")
    store = DeltaStore(spark, f"{folder}/state", bridge_tables(spark, sf_dir), writes)
    path = stored_table(sf_dir, source)
    arriving = (
        spark.readStream.schema(spark.read.parquet(path).schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(path)
    )
    if once_per:
        arriving = arriving.dropDuplicates([once_per])

    def as_commands(batch: DataFrame, t: Tables) -> Changes:
        arrived = getattr(Bridge(spark, sf_dir).over(**{source: batch}), table)()
        return rule(commands(t.replace(**{table: arrived})), t)

    start_rule(arriving, as_commands, store, f"{folder}/checkpoint").awaitTermination()
    return store


def _changed(store: DeltaStore, name: str) -> DataFrame:
    return store.changed_rows(name).filter(~F.col(REMOVED)).drop(REMOVED)


def bookings_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings make appointments, invoices and audit rows; the invoices."""
    store = _run(
        spark, sf_dir, "customer", "patients", ["appointments", "invoices", "audit_logs"],
        lambda c, t: visits.book_appointments(c, t, AS_OF, stage=stager(spark, "bookings")),
        lambda t: batches.bookings(t, AS_OF),
    )
    return _changed(store, "invoices")


def records_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New records complete their visits; the appointments they changed."""
    store = _run(
        spark, sf_dir, "orders", "appointments", ["appointments", "medical_records", "audit_logs"],
        lambda c, t: visits.add_records(c, t, AS_OF, stage=stager(spark, "records")),
        batches.records,
    )
    return _changed(store, "appointments")


def payments_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments settle invoices and free beds; the beds they changed."""
    store = _run(
        spark, sf_dir, "orders", "invoices", ["invoices", "beds", "admissions", "audit_logs"],
        lambda c, t: billing.pay_invoices(c, t, AS_OF, stage=stager(spark, "payments")),
        batches.payments,
    )
    return _changed(store, "beds")


def lines_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New prescription lines reprice invoices and free beds; the invoices."""
    store = _run(
        spark, sf_dir, "orders", "medical_records",
        ["prescriptions", "presc_details", "invoices", "beds", "admissions"],
        lambda c, t: clinical.prescribe_and_price(c, t, AS_OF, stage=stager(spark, "lines")),
        batches.prescription_lines,
    )
    return _changed(store, "invoices").select("invoice_id", "total_amount")


def logins_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ins become audit rows; those rows."""
    store = _run(
        spark, sf_dir, "events", "users", ["audit_logs"],
        lambda c, t: staff.log_logins(c, t, AS_OF),
        batches.logins,
        once_per="user_id",
    )
    return _changed(store, "audit_logs")
