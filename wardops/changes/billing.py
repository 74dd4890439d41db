"""Prices, payments, beds freed by payment, policies."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from wardops.changes.core import Changes, audit_of, reject, split
from wardops.functions import clock, money
from wardops.operators.access import gate
from wardops.operators.coverage import with_active_rate
from wardops.operators.parents import linked_max, with_visit
from wardops.operators.rewrite import last_per_key
from wardops.operators.sequence import APPLIED, CHOSEN, marks_of, newest_only, with_marks
from wardops.schemas import ACCOUNTANT, DOMAINS
from wardops.session import Stage, keep
from wardops.tables import Tables

# The message to refused executors.
PAYMENT_DENIED = "Permission Denied: Only Accountants can process payments"


def release_beds(
    updated_invoices: DataFrame, t: Tables, as_of: datetime, only_on_transition: bool = False,
    stage: Stage = keep,
) -> Changes:
    """Free the bed and close the stay behind every paid inpatient invoice.

    ``updated_invoices`` are invoice rows after an update.  By default each
    update that leaves an invoice Paid counts, so a repeated one stamps the
    discharge again; ``only_on_transition`` needs a column ``old_status`` and
    skips invoices that were Paid before.
    """
    paid = updated_invoices.filter(
        (F.col("payment_status") == "Paid") & F.col("admission_id").isNotNull()
    )
    if only_on_transition:
        paid = paid.filter(~F.col("old_status").eqNullSafe("Paid"))
    stays = stage(paid.select("admission_id").distinct())
    closed = stays.select(
        "admission_id",
        clock.instant(as_of).alias("discharge_date"),
        F.lit("Discharged").alias("discharge_status"),
    )
    freed = (
        t.admissions.select("admission_id", "bed_id")
        .join(stays, "admission_id")
        .filter(F.col("bed_id").isNotNull())
        .select("bed_id")
        .distinct()
        .withColumn("status", F.lit("Available"))
    )
    return Changes(updates={"admissions": closed, "beds": freed})


def pay_invoices(
    commands: DataFrame, t: Tables, as_of: datetime, only_on_transition: bool = False,
    stage: Stage = keep,
) -> Changes:
    """Commands (seq, invoice_id, executor_id); accountants only.

    The amount due after today's coverage is stored with the Paid state.  An
    unknown invoice changes nothing but is still logged.
    """
    allowed, refused = gate(commands, t, [ACCOUNTANT], PAYMENT_DENIED)
    allowed = stage(allowed)
    chosen = allowed.select("invoice_id").distinct()
    invoices = t.invoices.select(
        "invoice_id", "appt_id", "admission_id", "total_amount",
        F.col("payment_status").alias("old_status"),
    ).join(chosen, "invoice_id")
    paid = with_active_rate(with_visit(invoices, t, "invoice_id"), t, as_of).select(
        "invoice_id", "admission_id", "old_status",
        F.lit("Paid").alias("payment_status"),
        money.net_pay(F.col("total_amount"), F.col("coverage_rate")).cast("decimal(10,2)").alias("net_amount"),
    )
    released = release_beds(
        invoices.withColumn("payment_status", F.lit("Paid")), t, as_of, only_on_transition
    )
    text = F.concat(F.lit("Processed payment for invoice #"), F.col("invoice_id").cast("string"))
    return Changes(
        updates={
            "invoices": paid.select("invoice_id", "payment_status", "net_amount"),
            **released.updates,
        },
        audit=audit_of(allowed, "executor_id", text, as_of),
        rejected=reject(refused),
    )


def reprice_invoices(
    changed: DataFrame, t: Tables, as_of: datetime, only_on_transition: bool = False,
    stage: Stage = keep,
) -> Changes:
    """Invoices follow the prescription whose lines changed last.

    ``changed`` lists (presc_id, change_seq) for every inserted, updated or
    deleted line; ``t`` already holds the new lines.  The invoice takes the
    total of that one prescription, not the sum over the record, whatever its
    payment state.  Paid inpatient invoices then free their bed.  Totals come as
    wide as prescription totals are; applying one that the invoice column cannot
    hold is an error.
    """
    latest = changed.groupBy("presc_id").agg(F.max("change_seq").alias("change_seq"))
    touched = (
        t.prescriptions.select("presc_id", "record_id")
        .join(latest, "presc_id")
        .join(t.medical_records.select("record_id", "appt_id", "admission_id"), "record_id")
        .select("appt_id", "admission_id", F.struct("change_seq", "presc_id").alias("change"))
    )
    billed = t.invoices.select("invoice_id", "appt_id", "admission_id", "payment_status")
    paired = (
        linked_max(billed, touched, "change")
        # At most one row per parent: combining them before the shuffle would only sort them once more.
        .repartition("invoice_id")
        .groupBy("invoice_id")
        .agg(
            F.max("change").alias("last"),
            F.max("admission_id").alias("admission_id"),
            F.max("payment_status").alias("payment_status"),
        )
    )
    # An older change leaves the invoice with the prescription that decided it, at that one's present total.
    known = with_marks(paired, t, "reprice", "invoice_id", F.col("last.change_seq"))
    change = F.struct(F.col("last.change_seq").cast("bigint").alias("seq"), F.col("last.presc_id").cast("bigint").alias("presc_id"))
    decided = F.when(F.col(APPLIED).isNotNull(), F.struct(F.col(APPLIED).alias("seq"), F.col(CHOSEN).alias("presc_id")))
    winners = stage(
        known.withColumn("last", F.greatest(change, decided))
        .select("invoice_id", "admission_id", "payment_status", F.col("last.presc_id").alias("presc_id"), F.col("last.seq").alias("seq"))
    )
    totals = (
        t.presc_details.select("presc_id", "med_id", "quantity")
        .join(winners.select("presc_id"), "presc_id", "left_semi")
        .join(t.medicines.select("med_id", "price"), "med_id")
        .groupBy("presc_id")
        .agg(F.sum(F.col("price") * F.col("quantity")).alias("total"))
    )
    repriced = winners.join(totals, "presc_id", "left").select(
        "invoice_id", F.coalesce("total", F.lit(0)).cast("decimal(15,2)").alias("total_amount")
    )
    released = release_beds(
        winners.withColumn("old_status", F.col("payment_status")), t, as_of, only_on_transition, stage
    )
    return Changes(
        inserts=marks_of(winners, t, "reprice", "invoice_id", F.col("seq"), F.col("presc_id")),
        updates={"invoices": repriced, **released.updates},
    )


def set_payment_state(commands: DataFrame, t: Tables) -> Changes:
    """Commands (seq, invoice_id, payment_status): cancel or refund; the last wins."""
    known = F.col("payment_status").isin(DOMAINS["invoices", "payment_status"])
    accepted, refused = split(commands, [(known, "Unknown payment state")])
    chosen = last_per_key(accepted.select("invoice_id", "seq", "payment_status"), "invoice_id", "seq")
    chosen, marks = newest_only(chosen, t, "payment-state", "invoice_id")
    return Changes(
        inserts=marks,
        updates={"invoices": chosen.select("invoice_id", "payment_status")}, rejected=reject(refused),
    )


def update_policies(commands: DataFrame, t: Tables) -> Changes:
    """Commands (seq, insurance_id, rate_percent, expiry_date); the last wins."""
    in_range = F.col("rate_percent").between(0, 100)
    accepted, refused = split(commands, [(in_range, "Coverage must be between 0 and 100 percent")])
    chosen = last_per_key(
        accepted.select("insurance_id", "seq", "rate_percent", "expiry_date"), "insurance_id", "seq"
    )
    chosen, marks = newest_only(chosen, t, "policy", "insurance_id")
    rate = (F.col("rate_percent").cast("decimal(5,2)") / 100).cast("decimal(3,2)")
    return Changes(
        inserts=marks,
        updates={"insurance": chosen.select("insurance_id", rate.alias("coverage_rate"), "expiry_date")},
        rejected=reject(refused),
    )
