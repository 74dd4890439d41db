"""Plans a large cluster could run."""

from datetime import datetime

import pytest

import __spark_entry__ as entry_points
from harness import SMALL
from wardops.changes import integrity
from wardops.plans import audit, billing
from wardops.sources.bridge import bridge_tables

# The corpus operators are held to their own methods, some of which broadcast bounded tables or run Python tasks.
LAZY = {
    name: run
    for name, run in entry_points.queries().items()
    if not name.endswith("_stream") and name not in entry_points.CORPUS
}


def plan_of(frame) -> str:
    frame.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Tables too large to broadcast."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    yield
    spark.conf.set(setting, old)


@pytest.mark.parametrize("name", sorted(LAZY))
def test_no_nested_loops_forced_broadcasts_or_python(spark, no_broadcast, name):
    plan = plan_of(LAZY[name](spark, SMALL))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastExchange", "EvalPython", "Python", "Pandas", "InArrow"):
        assert operator not in plan


def test_windows_are_partitioned(spark, no_broadcast):
    """Ranking windows run per (user, hour) and per id range, never over a table."""
    t = bridge_tables(spark, SMALL)
    assert "hashpartitioning(username" in plan_of(audit.login_history(t))
    numbered = plan_of(LAZY["w18_allocated_ids"](spark, SMALL))
    assert "row_number() windowspecdefinition(_level1" in numbered.replace("#", " ").replace("_level1 ", "_level1")


def test_filters_reach_the_scan(spark, tmp_path):
    t = bridge_tables(spark, SMALL)
    t.invoices.write.parquet(str(tmp_path / "invoices"))
    stored = t.replace(invoices=spark.read.parquet(str(tmp_path / "invoices")))
    plan = plan_of(billing.monthly_revenue(stored, 1999, 6))
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(payment_status,Paid)" in pushed and "LessThan(invoice_date" in pushed
    assert "appt_id" not in plan.split("ReadSchema: ")[1]


def test_integrity_reads_every_table_once(spark, bridge):
    """All row rules, keys, unique values and references of a table come out of one scan."""
    plan = plan_of(integrity.violations(bridge, datetime(2024, 1, 1)))
    assert plan.count("Scan parquet") == len(list(bridge)) and plan.count("Exchange hashpartitioning") == 1
