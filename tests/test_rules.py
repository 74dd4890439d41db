"""What every change rule must keep true, over the bridged tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clinic import at, clinic, rows
from wardops.changes import billing as pricing, clinical as care, integrity, staff as hiring, visits
from wardops.changes.core import Changes
from wardops.schemas import KEYS
from wardops.session import stager
from wardops.sources import batches
from wardops.sources.snapshot import read_snapshot, write_snapshot

NOW = datetime(1999, 6, 15, 9, 55)

RULES = {
    "register": (lambda t: batches.registrations(t, NOW), lambda c, t, s: care.register_patients(c, t, NOW, s)),
    "prescribe": (batches.prescription_lines, care.prescribe),
    "book": (lambda t: batches.bookings(t, NOW), lambda c, t, s: visits.book_appointments(c, t, NOW, stage=s)),
    "book checked": (
        lambda t: batches.bookings(t, NOW), lambda c, t, s: visits.book_appointments(c, t, NOW, True, s)
    ),
    "record": (batches.records, lambda c, t, s: visits.add_records(c, t, NOW, s)),
    "pay": (batches.payments, lambda c, t, s: pricing.pay_invoices(c, t, NOW, stage=s)),
    "hire": (batches.new_staff, lambda c, t, s: hiring.add_staff(c, t, NOW, s)),
    "dismiss": (batches.staff_removals, lambda c, t, s: hiring.delete_staff(c, t, NOW, s)),
    "remove visit": (batches.appointment_removals, lambda c, t, s: visits.delete_appointments(c, t, NOW, s)),
    "transfer": (batches.transfers, lambda c, t, s: hiring.transfer_staff(c, t, NOW)),
}


@pytest.fixture(scope="module")
def stage(spark):
    return stager(spark, "test-rules")


def accepted(name, changes):
    if name == "prescribe":
        return changes.inserts["presc_details"].count()
    return changes.audit.count()


@pytest.mark.parametrize("name", sorted(RULES))
def test_every_command_is_accepted_or_rejected_once(bridge, stage, name):
    make, rule = RULES[name]
    commands = make(bridge)
    changes = rule(commands, bridge, stage)
    refused = rows(changes.rejected, "seq")
    assert len(refused) == len(set(refused))
    assert accepted(name, changes) + len(refused) == commands.count()
    assert changes.rejected.filter(F.col("reason").isNull()).count() == 0


@pytest.mark.parametrize("name", sorted(RULES))
def test_no_broken_keys_or_references_after(bridge, stage, name):
    make, rule = RULES[name]
    changes = rule(make(bridge), bridge, stage)
    after = changes.apply(bridge)
    # Staged, because the audit reads every table several times.
    after = after.replace(**{table: stage(after[table]) for table in changes.touched()})
    broken = integrity.violations(after, datetime(2024, 1, 1)).filter(
        F.col("rule").isin("key", "unique", "reference", "domain")
    )
    assert rows(broken) == []


@pytest.mark.parametrize("name", ["pay", "record", "transfer"])
def test_updates_keep_the_number_of_rows(bridge, stage, name):
    make, rule = RULES[name]
    changes = rule(make(bridge), bridge, stage)
    after = changes.apply(bridge)
    for table in changes.updates:
        key = KEYS[table]
        assert changes.updates[table].groupBy(key).count().filter("count > 1").count() == 0
        assert after[table].count() == bridge[table].count()


def test_paying_twice_changes_nothing_more(bridge):
    commands = batches.payments(bridge)
    once = pricing.pay_invoices(commands, bridge, NOW).apply(bridge)
    twice = pricing.pay_invoices(commands, once, NOW).apply(once)
    for table in ("invoices", "beds", "admissions"):
        assert rows(twice[table]) == rows(once[table])


def test_last_command_wins(bridge, spark):
    commands = spark.createDataFrame(
        [(2, 1, "Completed"), (1, 1, "Cancelled"), (3, 1, "In-Progress"), (4, 1, "Gone")],
        "seq bigint, appt_id bigint, status string",
    )
    after = visits.set_visit_state(commands, bridge, NOW).apply(bridge).appointments.filter("appt_id = 1").first()
    assert (after.status, after.completed_at) == ("In-Progress", NOW)


def test_hot_commands_give_the_same_result(bridge, spark):
    """Thousands of commands on one invoice and one doctor behave as one would."""
    unpaid = bridge.invoices.filter("payment_status = 'Unpaid'").first().invoice_id
    many = spark.range(1, 3001).select(
        F.col("id").alias("seq"), F.lit(unpaid).alias("invoice_id"), F.lit(4).cast("bigint").alias("executor_id")
    )
    one = many.filter("seq = 1")
    assert rows(pricing.pay_invoices(many, bridge, NOW).apply(bridge).invoices) == rows(
        pricing.pay_invoices(one, bridge, NOW).apply(bridge).invoices
    )
    changes = pricing.pay_invoices(many, bridge, NOW)
    logged = changes.apply(bridge).audit_logs
    assert logged.count() == bridge.audit_logs.count() + 3000
    assert logged.select("log_id").distinct().count() == logged.count()


def test_ids_of_deleted_rows_stay_used(spark, tmp_path):
    """After the last visit is deleted, the next one gets a new id, also from a stored snapshot."""
    now = datetime(2026, 5, 1, 9)
    t = clinic(spark, appointments=[(7, 1, 1, at("2026-05-02 09:00"), None, "Scheduled")])
    gone = Changes(deletes={"appointments": spark.createDataFrame([(7,)], "appt_id bigint")}).apply(t)
    ask = spark.createDataFrame([(1, 1, 2, 2, at("2026-05-03 10:00"))],
                                "seq bigint, executor_id bigint, patient_id bigint, doctor_id bigint, appt_date timestamp_ntz")

    def booked(tables):
        return visits.book_appointments(ask, tables, now)

    assert [r.appt_id for r in booked(gone).inserts["appointments"].collect()] == [8]
    after = booked(gone).apply(gone)
    again = Changes(deletes={"appointments": spark.createDataFrame([(8,)], "appt_id bigint")}).apply(after)
    stored = read_snapshot(spark, write_snapshot(again, str(tmp_path), now))
    assert stored.appointments.isEmpty()
    assert [r.appt_id for r in booked(stored).inserts["appointments"].collect()] == [9]
