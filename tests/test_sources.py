"""Snapshots, SQL text, schema growth and named views."""

import json
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clinic import at, clinic, money, rows
from wardops.catalog import register
from wardops.changes.core import Changes
from wardops.plans import audit, billing
from wardops.schemas import FOREIGN_KEYS, SCHEMAS
from wardops.sources import snapshot
from wardops.sources.sqltext import read_insert_statements

WHEN = datetime(2026, 5, 1, 9, 30, 5)


@pytest.fixture(scope="module")
def small(spark):
    return clinic(
        spark,
        invoices=[
            (1, None, 1, at("2026-03-31 23:59:59"), money("1.00"), "Paid"),
            (2, None, 1, at("2026-04-01 00:00:00"), money("2.00"), "Paid"),
            (3, None, 2, at("2026-04-30 23:59:59"), money("4.00"), "Paid"),
            (4, None, 2, at("2026-05-01 00:00:00"), money("8.00"), "Paid"),
            (5, None, 2, None, money("16.00"), "Paid"),
        ],
        audit_logs=[(1, 1, "it's", at("2026-04-30 09:30:05")), (2, 1, "b", at("2026-04-30 09:30:06")), (3, None, "c", None)],
    )


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("snapshots"))
    return Path(snapshot.write_snapshot(small, root, WHEN))


def test_round_trip(spark, small, stored):
    assert stored.name == "snapshot=20260501_093005"
    back = snapshot.read_snapshot(spark, str(stored))
    assert sorted(back) == snapshot.table_names() == sorted(SCHEMAS)
    for name in back:
        assert rows(back[name], *small[name].columns) == rows(small[name])


def test_schemas_stand_beside_the_data(spark, stored):
    described = {r.table_name: json.loads(r.schema_json) for r in spark.read.json(f"{stored}/_schemas").collect()}
    assert [f["name"] for f in described["roles"]["fields"]] == ["role_id", "role_name"]


def test_month_query_opens_one_partition(spark, small, stored):
    back = snapshot.read_snapshot(spark, str(stored))
    month = billing.monthly_revenue(back, 2026, 4)
    assert month.first().total_revenue == billing.monthly_revenue(small, 2026, 4).first().total_revenue == 6
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = billing.monthly_revenue(back, 2026, 4)._jdf.queryExecution().executedPlan().toString()
    assert "invoice_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(invoice_date" in plan
    assert audit.actions_last_24h(back, WHEN).first().action_count == 1
    trend = billing.revenue_trend_12m(back, datetime(2027, 4, 30, 23, 59, 59)).collect()
    assert [(r.month_label, r.revenue) for r in trend] == [("4/2026", 4), ("5/2026", 8)]


def test_changes_apply_to_stored_tables(spark, stored, tmp_path):
    back = snapshot.read_snapshot(spark, str(stored))
    new = spark.createDataFrame([(9, at("2026-04-09 10:00:00"))], "invoice_id bigint, invoice_date timestamp_ntz")
    after = Changes(inserts={"invoices": new.withColumn("total_amount", F.lit("3").cast("decimal(10,2)"))}).apply(back)
    added = after.invoices.filter("invoice_id = 9").first()
    assert added.payment_status == "Unpaid"  # the column's default
    snapshot.write_table("invoices", after.invoices, str(tmp_path / "invoices"))
    again = snapshot.read_table(spark, str(tmp_path), "invoices")
    assert again.filter("invoice_month = 202604").count() == 3


def test_missing_column_reads_as_null(spark, small, tmp_path):
    small.medicines.drop("stock").write.parquet(str(tmp_path / "medicines"))
    assert set(rows(snapshot.read_table(spark, str(tmp_path), "medicines"), "stock")) == {None}


def test_sql_text(small, tmp_path):
    folder = Path(snapshot.write_sql_snapshot(small, str(tmp_path), WHEN))
    lines = [line for part in sorted((folder / "audit_logs").glob("part-*")) for line in part.read_text().splitlines()]
    assert sorted(lines) == [
        "INSERT INTO `audit_logs` VALUES (1, 1, 'it''s', '2026-04-30 09:30:05');",
        "INSERT INTO `audit_logs` VALUES (2, 1, 'b', '2026-04-30 09:30:06');",
        "INSERT INTO `audit_logs` VALUES (3, NULL, 'c', NULL);",
    ]


def test_views_answer_sql(spark, small):
    names = register(spark, small, WHEN)
    assert "view_detailed_patient_bill" in names and "patients" in names
    found = spark.sql(
        "SELECT net_pay FROM view_detailed_patient_bill WHERE invoice_date >= :since", {"since": date(2026, 5, 1)}
    )
    assert [r.net_pay for r in found.collect()] == [8]


def test_sql_text_reads_back(spark, small, tmp_path):
    """Quotes, commas, line ends and statement ends inside texts, NULLs, and texts that look like NULL."""
    odd = ["it's", "''", "a, b", "line\nend);\n", "NULL", "'NULL'", "", None, "x" * 50_000, "'); --", "\\n \\' \t"]
    logs = spark.createDataFrame([(i, i, text, WHEN) for i, text in enumerate(odd)], small.audit_logs.schema).repartition(3)
    folder = snapshot.write_sql_snapshot(small.replace(audit_logs=logs), str(tmp_path), WHEN)
    back = snapshot.read_sql_snapshot(spark, folder, list(SCHEMAS))
    for name in SCHEMAS:
        want = logs if name == "audit_logs" else small[name]
        assert rows(back[name], *want.columns) == rows(want)
    order = list(back)
    for child, _, parent in FOREIGN_KEYS:
        assert order.index(parent) < order.index(child)


def test_statement_of_another_table_fails(spark, small, tmp_path):
    folder = snapshot.write_sql_snapshot(small, str(tmp_path), WHEN)
    with pytest.raises(Exception, match="values expected"):
        read_insert_statements(spark, "audit_logs", f"{folder}/invoices").collect()


def test_versions_are_reconciled(spark, tmp_path):
    """A column added, one dropped, and three kinds of types that grew."""
    def store(when, ddl, *data):
        folder = f"{tmp_path}/snapshot={snapshot.snapshot_name(when)}"
        frame = spark.createDataFrame(list(data), ddl)
        frame.write.parquet(f"{folder}/rooms")
        spark.createDataFrame([("rooms", frame.schema.json())], "table_name string, schema_json string").write.json(f"{folder}/_schemas")

    store(datetime(2024, 1, 1), "room_id int, price decimal(5,2), opened date, note string", (1, money("1.25"), date(2024, 1, 1), "x"))
    store(datetime(2025, 1, 1), "room_id bigint, price decimal(12,1), opened timestamp_ntz, floor int", (2**40, money("7.5"), at("2025-01-01 10:00:00"), 3))
    store(datetime(2026, 1, 1), "room_id bigint, price decimal(12,1), opened timestamp_ntz, floor int", (3, None, None, 4))
    found = snapshot.read_versions(spark, str(tmp_path), "rooms")
    assert dict(found.dtypes) == {
        "snapshot": "string", "room_id": "bigint", "price": "decimal(13,2)", "opened": "timestamp_ntz", "note": "string", "floor": "int"}
    assert rows(found, "snapshot", "room_id", "price", "opened", "note", "floor") == sorted([
        ("20240101_000000", 1, money("1.25"), at("2024-01-01 00:00:00"), "x", None),
        ("20250101_000000", 2**40, money("7.50"), at("2025-01-01 10:00:00"), None, 3),
        ("20260101_000000", 3, None, None, None, 4)], key=repr)
    with pytest.raises(ValueError):
        snapshot.read_versions(spark, str(tmp_path), "beds")
