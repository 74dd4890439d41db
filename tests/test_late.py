"""Commands in several micro-batches, in any order, against one batch."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from clinic import clinic, money, on, rows
from wardops.changes import billing, visits
from wardops.operators.sequence import MARKS, guarded
from wardops.streaming.store import DeltaStore

NOW = datetime(2024, 5, 1, 8)
ORDERS = [(2, 1, 0), (1, 2, 0), (0, 0, 2, 1, 1)]


def in_order(spark, t, folder, parts, order, rule, writes):
    store = DeltaStore(spark, str(folder), guarded(t), [*writes, MARKS])
    for epoch, n in enumerate(order):
        before = store.current(before=epoch)
        store.append(epoch, rule(parts[n], before), before)
    return store.current()


def check(spark, t, tmp_path, commands, cut, rule, tables):
    parts = [commands.filter(F.pmod(F.col(cut), F.lit(3)) == n) for n in range(3)]
    whole = rule(commands, t).apply(t)
    for number, order in enumerate(ORDERS):
        after = in_order(spark, t, tmp_path / str(number), parts, order, rule, tables)
        for name in tables:
            assert rows(after[name]) == rows(whole[name]), (order, name)
    return whole


def test_visit_states(spark, tmp_path):
    """A late Completed command stamps its time, the state stays that of the newest one."""
    t = clinic(spark, appointments=[(n, n, 1, NOW, None, "Scheduled") for n in range(1, 6)])
    commands = spark.createDataFrame(
        [(1, 1, "Completed"), (2, 1, "Scheduled"), (3, 1, "Cancelled"), (4, 2, "CheckedIn"), (6, 2, "Completed"),
         (8, 2, "Done"), (9, 3, "In-Progress"), (5, 99, "Completed"), (None, 4, "Cancelled"), (10, 4, "CheckedIn")],
        "seq bigint, appt_id bigint, status string",
    )
    whole = check(spark, t, tmp_path, commands, "seq", lambda c, b: visits.set_visit_state(c, b, NOW), ["appointments"])
    assert rows(whole.appointments, "appt_id", "status", "completed_at")[:2] == [(1, "Cancelled", NOW), (2, "Completed", NOW)]


def test_policies_and_payment_states(spark, tmp_path):
    t = clinic(spark, invoices=[(1, None, 1, NOW, money("5.00"), "Unpaid"), (2, None, 2, NOW, money("6.00"), "Paid")])
    policies = spark.createDataFrame(
        [(1, "P-01", 10, date(2030, 1, 1)), (2, "P-01", 20, date(2031, 1, 1)), (3, "P-01", 120, date(2032, 1, 1)),
         (4, "P-02", 30, on("2033-01-01")), (5, "P-02", 40, None)],
        "seq bigint, insurance_id string, rate_percent int, expiry_date date",
    )
    check(spark, t, tmp_path / "policies", policies, "seq", billing.update_policies, ["insurance"])
    states = spark.createDataFrame(
        [(1, 1, "Paid"), (2, 1, "Cancelled"), (3, 2, "Refunded"), (4, 2, "Odd"), (5, 2, "Cancelled"), (6, 1, "Refunded")],
        "seq bigint, invoice_id bigint, payment_status string",
    )
    check(spark, t, tmp_path / "states", states, "seq", billing.set_payment_state, ["invoices"])


def test_repricing(spark, tmp_path):
    """The prescription changed last decides, whichever change arrives last; beds are freed once or again alike."""
    t = clinic(
        spark,
        medical_records=[(1, None, 6, "s", "d", ""), (2, None, 6, "s", "d", ""), (3, None, 7, "s", "d", "")],
        prescriptions=[(1, 1, 1), (2, 1, 1), (3, 2, 1), (4, 3, 1)],
        presc_details=[(1, 1, 1001, 1, "x"), (2, 2, 1002, 3, "x"), (3, 3, 1003, 2, "x"), (4, 4, 1004, 2, "x")],
        invoices=[(1, None, 6, NOW, money("1.00"), "Paid"), (2, None, 7, NOW, money("1.00"), "Unpaid"), (3, None, 8, NOW, money("1.00"), "Paid")],
    )
    changed = spark.createDataFrame([(1, 1), (2, 5), (3, 3), (1, 4), (4, 2), (4, 9)], "presc_id bigint, change_seq bigint")
    whole = check(
        spark, t, tmp_path, changed, "change_seq", lambda c, b: billing.reprice_invoices(c, b, NOW), ["invoices", "beds", "admissions"]
    )
    assert rows(whole.invoices, "invoice_id", "total_amount") == [(1, money("6.00")), (2, money("30.00")), (3, money("1.00"))]


def test_discharges(spark, tmp_path):
    commands = spark.createDataFrame(
        [(1, 6, "Transferred"), (2, 6, "Discharged"), (3, 7, "Died"), (5, 7, "Transferred")],
        "seq bigint, admission_id bigint, status string",
    )
    check(spark, clinic(spark), tmp_path, commands, "seq", lambda c, b: visits.discharge(c, b, NOW), ["admissions"])


def test_a_plain_batch_keeps_no_marks(spark):
    t = clinic(spark)
    commands = spark.createDataFrame([(1, "P-01", 10, date(2030, 1, 1))], "seq bigint, insurance_id string, rate_percent int, expiry_date date")
    assert billing.update_policies(commands, t).touched() == ["insurance"]
    assert MARKS in billing.update_policies(commands, guarded(t)).touched()


@pytest.mark.parametrize("rule", ["a", "b"])
def test_marks_of_rules_do_not_mix(spark, rule):
    from wardops.operators.sequence import newest_only

    seen = spark.createDataFrame([("a:1", 5, None)], "command string, seq bigint, choice bigint")
    t = guarded(clinic(spark)).replace(**{MARKS: seen})
    chosen = spark.createDataFrame([(1, 3)], "id bigint, seq bigint")
    fresh, _ = newest_only(chosen, t, rule, "id")
    assert fresh.count() == (0 if rule == "a" else 1)


def test_marks_are_joined_by_their_key(spark):
    """Rows grouped by their key meet its marks without a second shuffle."""
    from test_plans import plan_of
    from wardops.operators.sequence import APPLIED, with_marks

    marks = spark.createDataFrame([("rule:1", 5, 7), ("rule:x", 6, 7), ("other:2", 9, 9)], "command string, seq bigint, choice bigint")
    t = guarded(clinic(spark)).replace(**{MARKS: marks})
    chosen = spark.createDataFrame([(1, 4), (1, 6), (2, 3), (None, 2)], "id bigint, seq bigint").groupBy("id").agg(F.min("seq").alias("seq"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = with_marks(chosen, t, "rule", "id", F.col("seq"))
        assert plan_of(found).count("Exchange hashpartitioning") == 2
        assert {(r.id, r[APPLIED], r._late) for r in found.collect()} == {(1, 5, True), (2, None, False), (None, None, False)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_update_meets_its_table_once(spark, tmp_path):
    """Staged updates: the rows an epoch writes come from one join of the table with them."""
    from test_plans import plan_of
    from wardops.session import stager

    t = guarded(clinic(spark, appointments=[(n, n, 1, NOW, None, "Scheduled") for n in range(1, 6)]))
    commands = spark.createDataFrame([(1, 1, "Completed"), (2, 2, "Cancelled"), (3, 99, "Cancelled")], "seq bigint, appt_id bigint, status string")
    store = DeltaStore(spark, str(tmp_path / "state"), t, ["appointments", MARKS], stager(spark, "updates"))
    before = store.current(before=0)
    changes = visits.set_visit_state(commands, before, NOW, stager(spark, "states"))
    delta = store._delta("appointments", changes, {}, t)
    assert plan_of(delta).count("Join") == 1
    assert rows(delta, "appt_id", "status", "completed_at", "_removed") == [(1, "Completed", NOW, False), (2, "Cancelled", None, False)]


def test_an_empty_state_of_marks_is_not_joined(spark):
    from test_plans import plan_of
    from wardops.operators.sequence import with_marks

    chosen = spark.createDataFrame([(1, 4), (2, 3)], "id bigint, seq bigint")
    found = with_marks(chosen, guarded(clinic(spark)), "rule", "id", F.col("seq"))
    assert "Join" not in plan_of(found)
    assert {(r.id, r._late) for r in found.collect()} == {(1, False), (2, False)}


def test_changed_rows_group_what_is_read(spark, tmp_path):
    """Marks and prices are hashed, not sorted; columns that a query leaves out are not carried along."""
    from test_plans import plan_of

    t = guarded(clinic(spark, invoices=[(n, None, n, NOW, money("5.00"), "Unpaid") for n in range(1, 4)]))
    store = DeltaStore(spark, str(tmp_path / "state"), t, ["invoices", MARKS])
    for epoch, state in enumerate(("Paid", "Refunded")):
        commands = spark.createDataFrame([(epoch + 1, n, state) for n in (1, 2 + epoch)], "seq bigint, invoice_id bigint, payment_status string")
        before = store.current(before=epoch)
        store.append(epoch, billing.set_payment_state(commands, before), before)
    assert "SortAggregate" not in plan_of(store.changed_rows(MARKS))
    prices = plan_of(store.changed_rows("invoices").select("invoice_id", "total_amount"))
    assert "SortAggregate" not in prices and "payment_status" not in prices
    assert rows(store.changed_rows(MARKS), "command", "seq") == [("payment-state:1", 2), ("payment-state:2", 1), ("payment-state:3", 2)]
    assert rows(store.current().invoices, "invoice_id", "payment_status") == [(1, "Refunded"), (2, "Paid"), (3, "Refunded")]


def test_repricing_groups_and_pairs_visits_in_one_shuffle(spark):
    """Grouped changes meet the invoices where they are; pairs are sorted once to be grouped by invoice."""
    from test_plans import plan_of

    changed = spark.createDataFrame([(1, 1), (2, 5)], "presc_id bigint, change_seq bigint")
    kept = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        billing.reprice_invoices(changed, clinic(spark), NOW, stage=lambda frame: kept.append(plan_of(frame)) or frame)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Changes, prescriptions, both sides by record, both sides by visit, pairs by invoice.
    assert kept[0].count("Exchange hashpartitioning") == 7


def test_the_largest_value_of_either_parent(spark):
    """As pairing every row with every other and taking the largest; equal on both keys, equal values and NULLs included."""
    from wardops.operators.parents import linked_max, linked_pairs

    left = spark.createDataFrame(
        [(1, 1, None), (2, None, 1), (3, 1, 1), (4, 2, 3), (5, None, None), (6, 9, None), (1, 2, None), (None, 1, 3)],
        "id bigint, appt_id bigint, admission_id bigint",
    )
    right = spark.createDataFrame(
        [(1, None, 5, 1), (1, None, 5, 2), (None, 1, 7, 3), (1, 1, 6, 4), (2, 3, None, 5), (2, None, None, 6), (None, 3, 1, 7), (None, None, 9, 8)],
        "appt_id bigint, admission_id bigint, seq bigint, choice bigint",
    ).select("appt_id", "admission_id", F.struct("seq", "choice").alias("last"))
    largest = [
        {(r.id, tuple(r.last)) for r in pairs.groupBy("id").agg(F.max("last").alias("last")).collect()}
        for pairs in (linked_pairs(left, right), linked_max(left, right, "last"))
    ]
    assert largest[0] == largest[1] == {(1, (6, 4)), (2, (7, 3)), (3, (7, 3)), (4, (1, 7)), (None, (6, 4))}
