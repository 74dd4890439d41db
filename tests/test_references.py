"""Deletions followed through the declared references."""

from datetime import date, datetime

from clinic import rows, tables
from wardops.operators.references import delete_closure

NOW = datetime(2026, 5, 1, 12)


def closure(spark, table, keys, cascades):
    t = tables(
        spark,
        departments=[(1, "Ear")], roles=[(1, "Admin")], users=[(1, "u", "h", 1)],
        staff=[(n, f"S{n}", None, None, None, None, None, 1) for n in (1, 2, 3)],
        doctors=[(10, 1, "a"), (20, 2, "b"), (30, 3, "c")],
        patients=[(1, "Ann", date(1990, 1, 1), "Female", "031", "a@x"), (2, "Bob", date(1991, 1, 1), "Male", "032", "b@x")],
        insurance=[("P1", 1, None, None, None), ("P2", 2, None, None, None)],
        appointments=[(1, 1, 10, NOW, None, "Scheduled"), (2, 1, 20, NOW, None, "Completed"), (3, 2, None, NOW, None, "Scheduled")],
        medical_records=[(1, 2, None, "s", "d", "")],
        invoices=[(1, 1, None, NOW, None, "Unpaid", None), (2, 1, None, NOW, None, "Unpaid", None), (3, 2, None, NOW, None, "Paid", None)],
    )
    found = delete_closure(t, table, spark.createDataFrame([(k,) for k in keys], "root bigint"), cascades)
    accepted = spark.createDataFrame([(k,) for k in keys], "root bigint").join(found.blocked, "root", "left_anti")
    return list(found.goes), {n: sorted(r[0] for r in rows(f)) for n, f in found.keys(accepted).items()}, sorted(r[0] for r in rows(found.blocked))


def test_cascades_and_restrictions(spark):
    assert closure(spark, "appointments", [1, 2, 3, 99], {"invoices"}) == (
        ["invoices", "appointments"], {"invoices": [1, 2], "appointments": [1, 3, 99]}, [2])
    assert closure(spark, "staff", [1, 2, 3], {"doctors"}) == (["doctors", "staff"], {"doctors": [30], "staff": [3]}, [1, 2])


def test_closure_goes_through_several_levels(spark):
    """A patient with visits, their invoices and records, and policies; children are listed before parents."""
    order, keys, blocked = closure(spark, "patients", [1, 2], {"insurance", "appointments", "invoices", "medical_records"})
    assert blocked == [] and keys == {
        "patients": [1, 2], "insurance": ["P1", "P2"], "appointments": [1, 2, 3], "medical_records": [1], "invoices": [1, 2, 3]}
    assert order.index("invoices") < order.index("appointments") < order.index("patients")
    assert closure(spark, "patients", [1, 2], {"insurance", "appointments", "invoices"})[2] == [1]


def test_nothing_asked(spark):
    assert closure(spark, "staff", [], {"doctors"}) == (["doctors", "staff"], {"doctors": [], "staff": []}, [])
