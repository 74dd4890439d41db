"""Date filters that also skip whole partitions of stored snapshots.

Snapshots keep invoices by month and audit rows by day.  A filter on the
timestamp alone would still open every partition, so the same bounds are put on
the partition column where the table has one.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from wardops.functions import clock


def _month_number(stamp: Column) -> Column:
    return F.year(stamp) * 100 + F.month(stamp)


PARTITION_COLUMNS = ["invoice_month", "log_day"]


def partition_of(table: str) -> tuple[str, Column] | None:
    """The partition column of a stored table and how it follows from a row."""
    if table == "invoices":
        return "invoice_month", _month_number(F.col("invoice_date"))
    if table == "audit_logs":
        return "log_day", F.to_date("timestamp")
    return None


def _as_month(value: date | datetime) -> int:
    return value.year * 100 + value.month


def within_days(rows: DataFrame, stamp: str, first: date | datetime, last: date | datetime) -> DataFrame:
    """Rows of both days and those between."""
    kept = rows.filter(clock.between_days(F.col(stamp), first, last))
    if "invoice_month" in rows.columns:
        kept = kept.filter(F.col("invoice_month").between(_as_month(first), _as_month(last)))
    if "log_day" in rows.columns:
        kept = kept.filter(F.col("log_day").between(clock.day(first), clock.day(last)))
    return kept


def since(rows: DataFrame, stamp: str, start: Column) -> DataFrame:
    """Rows from the instant ``start`` on."""
    kept = rows.filter(F.col(stamp) >= start)
    if "invoice_month" in rows.columns:
        kept = kept.filter(F.col("invoice_month") >= _month_number(start))
    if "log_day" in rows.columns:
        kept = kept.filter(F.col("log_day") >= F.to_date(start))
    return kept


def within_months(rows: DataFrame, stamp: str, requests: DataFrame) -> DataFrame:
    """Rows from the first to the last month of requests (year, month)."""
    number = F.col("year") * 100 + F.col("month")
    start = F.make_date("year", "month", F.lit(1))
    valid = requests.filter(F.col("month").between(1, 12) & F.col("year").between(1, 9999))
    first, end = valid.agg(F.min(start)).scalar(), valid.agg(F.add_months(F.max(start), 1)).scalar()
    kept = rows.filter((F.col(stamp) >= first.cast("timestamp_ntz")) & (F.col(stamp) < end.cast("timestamp_ntz")))
    if "invoice_month" in rows.columns:
        kept = kept.filter(
            F.col("invoice_month").between(valid.agg(F.min(number)).scalar(), valid.agg(F.max(number)).scalar())
        )
    return kept
