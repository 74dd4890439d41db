"""Bills, revenue and insurance."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardops.functions import clock, money
from wardops.operators.access import permitted, with_role
from wardops.operators.calendar import days_of_month
from wardops.operators.coverage import active_policy, rate_or_zero, with_active_rate
from wardops.operators.parents import left_linked, with_visit
from wardops.operators.pruning import since, within_days, within_months
from wardops.operators.spread import left_spread, skew_join
from wardops.schemas import ACCOUNTANT, ADMIN
from wardops.tables import Tables

# Settled states and who may read revenue.
SETTLED = ["Paid", "Refunded", "Cancelled"]
REVENUE_READERS = [ACCOUNTANT, ADMIN]
REVENUE_DENIED = "Permission Denied"


def _paid(t: Tables) -> DataFrame:
    return t.invoices.filter(F.col("payment_status") == "Paid")


def _in_month(rows: DataFrame, year: int, month: int) -> DataFrame:
    return within_days(
        rows, "invoice_date", clock.month_first(year, month), clock.month_last(year, month)
    )


def _collected() -> Column:
    return money.revenue(F.sum(money.collected(F.col("net_amount"), F.col("total_amount"))))


def _visit_type() -> Column:
    return F.when(F.col("appt_id").isNotNull(), "Outpatient").otherwise("Inpatient")


def _with_patient_name(rows: DataFrame, t: Tables) -> DataFrame:
    names = t.patients.select("patient_id", F.col("full_name").alias("patient_name"))
    return rows.join(names, "patient_id", "left")


def line_totals(t: Tables) -> DataFrame:
    """(presc_id, total) over prescriptions that have priced lines."""
    prices = t.medicines.select("med_id", "price")
    return (
        t.presc_details.select("presc_id", "med_id", "quantity")
        .join(prices, "med_id")
        .groupBy("presc_id")
        .agg(F.sum(F.col("price") * F.col("quantity")).cast("decimal(15,2)").alias("total"))
    )


def prescription_total(t: Tables) -> DataFrame:
    zero = F.lit(0).cast("decimal(15,2)")
    return t.prescriptions.select("presc_id").join(line_totals(t), "presc_id", "left").select(
        "presc_id", F.coalesce("total", zero).alias("total_amount")
    )


def net_pay(t: Tables, as_of: datetime) -> DataFrame:
    """Every invoice with today's coverage applied to its gross amount."""
    billed = with_visit(t.invoices.select("invoice_id", "appt_id", "admission_id", "total_amount"), t, "invoice_id")
    return with_active_rate(billed, t, as_of).select(
        "invoice_id",
        F.col("total_amount").alias("gross_amount"),
        "coverage_rate",
        money.net_pay(F.col("total_amount"), F.col("coverage_rate")).alias("net_pay"),
    )


def active_coverage(t: Tables, as_of: datetime) -> DataFrame:
    return t.patients.select("patient_id").join(active_policy(t, as_of), "patient_id", "left").select(
        "patient_id", rate_or_zero(F.col("coverage_rate")).alias("coverage_rate")
    )


def treatments(t: Tables) -> DataFrame:
    """(appt_id, admission_id, doctor_diagnosis, medicine_name, dosage): every record by prescription and line."""
    medicines = t.medicines.select("med_id", F.col("med_name").alias("medicine_name"))
    lines = (
        t.presc_details.select("presc_id", "med_id", "dosage")
        .join(medicines, "med_id", "left")
        .select("presc_id", "medicine_name", "dosage")
    )
    prescribed = left_spread(
        t.prescriptions.select("record_id", "presc_id"), lines, ["presc_id"], right_keys=t.presc_details
    ).select("record_id", "medicine_name", "dosage")
    return left_spread(
        t.medical_records.select(
            "record_id", "appt_id", "admission_id", F.col("diagnosis").alias("doctor_diagnosis")
        ),
        prescribed, ["record_id"], right_keys=t.prescriptions,
    ).select("appt_id", "admission_id", "doctor_diagnosis", "medicine_name", "dosage")


def policies(t: Tables) -> DataFrame:
    """(patient_id, patient_name, coverage_rate): every patient by policy."""
    return t.patients.select("patient_id", F.col("full_name").alias("patient_name")).join(
        t.insurance.select("patient_id", "coverage_rate"), "patient_id", "left"
    )


def patient_bill(t: Tables) -> DataFrame:
    """Paid invoices by record, prescription, line and *every* policy.

    Policies are joined without an expiry test, one row each, as the bill view
    defines it; a stored net amount always wins over a computed one.
    """
    paid = with_visit(
        _paid(t).select("invoice_id", "invoice_date", "appt_id", "admission_id", "total_amount", "net_amount"),
        t, "invoice_id",
    ).select("invoice_id", "invoice_date", "appt_id", "admission_id", "total_amount", "net_amount", "patient_id")
    billed = left_linked(paid, treatments(t), "invoice_id", t.medical_records)
    rate = rate_or_zero(F.col("coverage_rate"))
    return skew_join(billed, policies(t), ["patient_id"], "left").select(
        "invoice_id",
        "invoice_date",
        "patient_name",
        "doctor_diagnosis",
        "medicine_name",
        "dosage",
        F.col("total_amount").alias("gross_amount"),
        rate.alias("insurance_rate"),
        F.coalesce(F.col("net_amount"), money.net_pay(F.col("total_amount"), rate))
        .cast("decimal(15,2)").alias("net_pay"),
    )


def monthly_revenue(t: Tables, year: int, month: int) -> DataFrame:
    """One row; the revenue of a month without paid invoices is NULL."""
    return _in_month(_paid(t), year, month).agg(
        _collected().alias("total_revenue"), F.count("invoice_id").alias("total_invoices")
    )


def monthly_revenue_reports(t: Tables, requests: DataFrame) -> DataFrame:
    """Many requests (executor_id, year, month) at once, each answered or refused.

    Only invoices from the first to the last month asked for are read.
    """
    stamp = F.col("invoice_date")
    by_month = (
        within_months(_paid(t), "invoice_date", requests)
        .groupBy(F.year(stamp).alias("year"), F.month(stamp).alias("month"))
        .agg(_collected().alias("total_revenue"), F.count("invoice_id").alias("total_invoices"))
    )
    answered = permitted(REVENUE_READERS)
    return skew_join(with_role(requests, t), by_month, ["year", "month"], "left").select(
        "executor_id",
        "year",
        "month",
        answered.alias("allowed"),
        F.when(~answered, REVENUE_DENIED).alias("reason"),
        F.when(answered, F.col("total_revenue")).alias("total_revenue"),
        F.when(answered, F.coalesce("total_invoices", F.lit(0))).alias("total_invoices"),
    )


def monthly_average(t: Tables, year: int, month: int) -> DataFrame:
    """Revenue and its mean per invoice; no revenue is 0, no invoice counts as one."""
    revenue = F.coalesce("total_revenue", F.lit(0).cast("decimal(20,2)"))
    count = F.when(F.col("total_invoices") == 0, F.lit(1)).otherwise(F.col("total_invoices"))
    return monthly_revenue(t, year, month).select(
        revenue.alias("revenue"),
        count.cast("bigint").alias("invoices_collected"),
        (revenue / count.cast("decimal(20,0)")).cast("decimal(20,2)").alias("average_per_invoice"),
    )


def daily_revenue(t: Tables, year: int, month: int, spark: SparkSession | None = None) -> DataFrame:
    """Every day of the month, 0 where nothing was paid."""
    taken = (
        _in_month(_paid(t), year, month)
        .groupBy(F.day("invoice_date").alias("day"))
        .agg(_collected().alias("taken"))
    )
    days = days_of_month(spark or taken.sparkSession, year, month)
    return days.join(taken, "day", "left").select(
        "day", F.coalesce("taken", F.lit(0).cast("decimal(20,2)")).alias("daily_revenue")
    ).orderBy("day")


def revenue_trend_12m(t: Tables, as_of: datetime) -> DataFrame:
    """From twelve months before ``as_of`` onward, by month; no upper bound."""
    stamp = F.col("invoice_date")
    return (
        since(_paid(t), "invoice_date", clock.months_before(as_of, 12))
        .groupBy(F.year(stamp).alias("yr"), F.month(stamp).alias("mo"))
        .agg(_collected().alias("revenue"))
        .withColumn("month_label", clock.month_label(F.col("yr"), F.col("mo")))
        .orderBy("yr", "mo")
    )


def payment_history(t: Tables, first: date, last: date) -> DataFrame:
    settled = within_days(
        t.invoices.filter(F.col("payment_status").isin(SETTLED)), "invoice_date", first, last
    )
    return (
        _with_patient_name(with_visit(settled, t, "invoice_id"), t)
        .select("invoice_id", "invoice_date", "payment_status", "patient_name", "total_amount", "net_amount")
        .orderBy(F.desc("invoice_date"), "invoice_id")
    )


def period_net_revenue(t: Tables, first: date, last: date) -> DataFrame:
    """One row.  Here a stored net of 0.00 falls back to gross, unlike by month."""
    amount = money.collected_nonzero(F.col("net_amount"), F.col("total_amount"))
    total = F.coalesce(money.revenue(F.sum(amount)), F.lit(0).cast("decimal(20,2)"))
    return (
        within_days(_paid(t), "invoice_date", first, last)
        .agg(total.alias("total_net_revenue"))
        .withColumn("total_display", money.dollars(F.col("total_net_revenue")))
    )


def refundable_invoices(t: Tables, first: date, last: date) -> DataFrame:
    paid = payment_history(t, first, last).filter(F.col("payment_status") == "Paid")
    name = F.coalesce("patient_name", F.lit("None"))
    return paid.select(
        "invoice_id",
        F.concat(F.lit("#"), F.col("invoice_id").cast("string"), F.lit(" — "), name).alias("label"),
    )


def pending_invoices(t: Tables, as_of: datetime) -> DataFrame:
    """Unpaid invoices with today's coverage and the estimated amount to pay."""
    unpaid = t.invoices.filter(F.col("payment_status") == "Unpaid").withColumn(
        "gross_amount", F.coalesce("total_amount", F.lit(0).cast("decimal(10,2)"))
    )
    billed = _with_patient_name(with_visit(unpaid, t, "invoice_id"), t)
    net = money.net_pay(F.col("gross_amount"), F.col("coverage_rate"))
    return (
        with_active_rate(billed, t, as_of)
        .select(
            "invoice_id", "invoice_date", "patient_name", "patient_id", "coverage_rate",
            "gross_amount", net.alias("estimated_net"), _visit_type().alias("visit_type"),
        )
        .orderBy(F.desc("invoice_date"), "invoice_id")
    )


def pending_invoice_cards(t: Tables, as_of: datetime) -> DataFrame:
    """The same as display texts."""
    name = F.coalesce("patient_name", F.lit("N/A"))
    return pending_invoices(t, as_of).select(
        "invoice_id",
        F.concat(
            F.lit("Invoice #"), F.col("invoice_id").cast("string"), F.lit(" — "), name,
            F.lit(" — "), "visit_type",
        ).alias("title"),
        money.dollars(F.col("gross_amount")).alias("gross_display"),
        money.percent(F.col("coverage_rate")).alias("coverage_display"),
        money.dollars(F.col("estimated_net")).alias("net_display"),
    )


def invoice_line_items(t: Tables, payment_status: str | None = "Unpaid") -> DataFrame:
    """Prescribed lines of outpatient invoices."""
    invoices = t.invoices.filter(F.col("appt_id").isNotNull())
    if payment_status is not None:
        invoices = invoices.filter(F.col("payment_status") == payment_status)
    records = t.medical_records.filter(F.col("appt_id").isNotNull()).select("record_id", "appt_id")
    subtotal = (F.col("price") * F.col("quantity")).cast("decimal(15,2)")
    return (
        invoices.select("invoice_id", "appt_id")
        .join(records, "appt_id")
        .join(t.prescriptions.select("record_id", "presc_id"), "record_id")
        .join(t.presc_details.select("presc_id", "med_id", "dosage", "quantity"), "presc_id")
        .join(t.medicines.select("med_id", "med_name", "price"), "med_id")
        .select("invoice_id", "med_name", "dosage", "quantity", "price", subtotal.alias("subtotal"))
    )


def insurance_status(t: Tables, as_of: datetime) -> DataFrame:
    expired = F.col("expiry_date").isNull() | (F.col("expiry_date") < clock.day(as_of))
    return (
        t.insurance.join(
            t.patients.select("patient_id", F.col("full_name").alias("patient_name")), "patient_id"
        )
        .select(
            "insurance_id", "patient_name", "patient_id", "provider", "coverage_rate", "expiry_date",
            F.when(expired, "Expired").otherwise("Active").alias("policy_state"),
            money.percent(F.col("coverage_rate")).alias("coverage_display"),
            F.coalesce(F.col("expiry_date").cast("string"), F.lit("None")).alias("expiry_display"),
        )
        .orderBy("expiry_date", "insurance_id")
    )
