"""Bills over tables stored by visit."""

from datetime import datetime

import pytest

from clinic import at, clinic, on, rows
from test_plans import no_broadcast, plan_of  # noqa: F401
from wardops.plans import billing, clustered

DAY = datetime(2024, 5, 1, 8)


def stored(spark, t, folder, buckets=4):
    return clustered.read_visit_store(spark, clustered.write_visit_store(t, str(folder / "store"), buckets))


def test_no_join_moves_a_row(spark, bridge, tmp_path, no_broadcast):  # noqa: F811
    store = stored(spark, bridge, tmp_path)
    plan = plan_of(clustered.clustered_bill(store))
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    assert rows(clustered.clustered_bill(store)) == rows(billing.patient_bill(bridge))


def test_odd_parents_bill_alike(spark, tmp_path):
    """Two parents on either side, none, an unknown visit, several policies, records without lines."""
    t = clinic(
        spark,
        appointments=[(1, 1, 1, DAY, None, "Completed"), (2, 2, 1, DAY, None, "Completed"), (3, None, 1, DAY, None, "Completed")],
        admissions=[(1, 3, 1, 1, DAY, None, "Admitted"), (2, 1, 1, 1, DAY, None, "Admitted")],
        medical_records=[
            (1, 1, None, "s", "d1", ""), (2, 1, 1, "s", "d2", ""), (3, None, 1, "s", "d3", ""),
            (4, 2, 2, "s", "d4", ""), (5, None, None, "s", "d5", ""), (6, 3, None, "s", "d6", ""),
        ],
        prescriptions=[(1, 1, 1), (2, 2, 1), (3, 2, 1), (4, 6, 1)],
        presc_details=[(1, 1, 1002, 5, "x"), (2, 2, 1004, 1, "y"), (3, 2, 1002, 1, "z"), (4, 4, 1005, 1, "w")],
        insurance=[("I1", 1, None, on("2030-01-01"), "p"), ("I2", 1, None, on("2020-01-01"), "p")],
        invoices=[
            (1, 1, None, DAY, None, "Paid"), (2, None, 1, DAY, None, "Paid"), (3, 1, 1, DAY, None, "Paid"),
            (4, 2, 2, DAY, None, "Paid"), (5, None, None, DAY, None, "Paid"), (6, 99, None, DAY, None, "Paid"),
            (7, 3, None, DAY, None, "Paid"), (8, 1, None, DAY, None, "Unpaid"), (9, 99, 98, DAY, None, "Paid"),
        ],
    )
    bill = rows(clustered.clustered_bill(stored(spark, t, tmp_path)))
    assert bill == rows(billing.patient_bill(t)) and len(bill) > 12


@pytest.mark.parametrize("buckets", [1, 7])
def test_an_empty_clinic_bills_nothing(spark, tmp_path, buckets):
    assert rows(clustered.clustered_bill(stored(spark, clinic(spark), tmp_path, buckets))) == []


def test_a_store_is_written_once(spark, tmp_path):
    t = clinic(spark, appointments=[(1, 1, 1, at("2024-05-01 08:00:00"), None, "Completed")])
    stored(spark, t, tmp_path)
    with pytest.raises(Exception, match="exist|EXIST"):
        stored(spark, t, tmp_path)
