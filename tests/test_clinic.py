"""A small clinic whose state is built by the rules, checked by hand-worked numbers."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clinic import at, clinic, cut, frame, money, rows
from wardops.changes import billing as pricing, clinical as care, visits
from wardops.operators.rewrite import updated, with_rows
from wardops.plans import audit, beds, billing, people, scheduling

NOW = datetime(2026, 5, 1, 12)


@pytest.fixture(scope="module")
def after(spark):
    """Three bookings, three records, two prescriptions, then invoices by hand."""
    t = clinic(spark)
    bookings = spark.createDataFrame(
        [
            (1, None, 1, 1, at("2026-04-30 08:30:00")),
            (2, None, 2, 4, at("2026-04-30 09:15:00")),
            (3, None, 3, 8, at("2026-05-01 10:00:00")),
        ],
        "seq bigint, executor_id bigint, patient_id bigint, doctor_id bigint, appt_date timestamp_ntz",
    )
    t = cut(visits.book_appointments(bookings, t, NOW).apply(t))
    records = spark.createDataFrame(
        [(n, None, n, None, "ache", d, "") for n, d in [(1, "throat"), (2, "flu"), (3, "healing")]],
        "seq bigint, executor_id bigint, appt_id bigint, admission_id bigint, "
        "symptoms string, diagnosis string, doctor_notes string",
    )
    t = cut(visits.add_records(records, t, NOW).apply(t))
    lines = spark.createDataFrame(
        [(1, 1, 1, 1001, 14, "twice"), (2, 2, 4, 1002, 10, "if needed")],
        "seq bigint, record_id bigint, doctor_id bigint, med_id bigint, quantity int, dosage string",
    )
    t = cut(care.prescribe_and_price(lines, t, NOW).apply(t))
    priced = t
    paid = spark.createDataFrame(
        [(1, "Paid", Decimal("250000.00"), at("2026-04-30 10:15:00"))],
        "invoice_id bigint, payment_status string, total_amount decimal(10,2), invoice_date timestamp_ntz",
    )
    more = frame(
        spark, "invoices",
        [
            (4, None, 1, at("2023-10-10 15:00:00"), money("3200000.00"), "Paid"),
            (5, None, 2, at("2023-10-12 10:30:00"), money("2750000.00"), "Paid"),
            (6, None, 3, at("2023-10-20 17:00:00"), money("5100000.00"), "Paid"),
            (7, None, 4, at("2023-11-05 12:00:00"), money("1800000.00"), "Paid"),
            (8, None, 5, at("2023-11-15 09:00:00"), money("4300000.00"), "Unpaid"),
            (9, None, 6, at("2023-12-01 10:00:00"), money("0.00"), "Unpaid"),
            (10, None, 7, at("2023-12-03 15:00:00"), money("0.00"), "Unpaid"),
            (11, None, 8, at("2023-12-04 17:00:00"), money("0.00"), "Unpaid"),
            (12, None, 9, at("2023-12-05 08:00:00"), money("0.00"), "Unpaid"),
        ],
    )
    t = t.replace(invoices=with_rows(updated(t.invoices, "invoice_id", paid), more))
    return priced, cut(t)


def test_records_complete_visits(after):
    priced, _ = after
    assert rows(priced.appointments, "appt_id", "status") == [(n, "Completed") for n in (1, 2, 3)]


def test_lines_price_the_booked_invoices(after):
    priced, t = after
    assert rows(priced.invoices, "invoice_id", "total_amount", "payment_status") == [
        (1, Decimal("147.00"), "Unpaid"), (2, Decimal("20.00"), "Unpaid"), (3, Decimal("0.00"), "Unpaid"),
    ]
    assert rows(billing.prescription_total(t)) == [(1, Decimal("147.00")), (2, Decimal("20.00"))]


def test_unpaid_count(after):
    _, t = after
    assert audit.home_kpis(t, NOW).first().unpaid_invoices == 7


@pytest.mark.parametrize(
    "year, month, revenue, count",
    [(2023, 10, "11050000.00", 3), (2023, 11, "1800000.00", 1), (2026, 4, "250000.00", 1), (2025, 1, None, 0)],
)
def test_monthly_revenue(after, year, month, revenue, count):
    _, t = after
    row = billing.monthly_revenue(t, year, month).first()
    assert (row.total_revenue, row.total_invoices) == (money(revenue), count)


def test_empty_month_still_has_all_days(after):
    _, t = after
    days = billing.daily_revenue(t, 2024, 2).collect()
    assert [r.day for r in days] == list(range(1, 30)) and {r.daily_revenue for r in days} == {Decimal("0.00")}
    average = billing.monthly_average(t, 2024, 2).first()
    assert (average.revenue, average.invoices_collected, average.average_per_invoice) == (0, 1, 0)


def test_bill(after):
    _, t = after
    bill = {r.invoice_id: r for r in billing.patient_bill(t).collect()}
    assert sorted(bill) == [1, 4, 5, 6, 7]
    assert bill[1].net_pay == Decimal("50000.00") and bill[6].net_pay == Decimal("1275000.00")
    assert all(bill[n].net_pay == bill[n].gross_amount for n in (4, 5, 7))
    assert [n for n in bill if bill[n].doctor_diagnosis] == [1]
    assert (bill[1].doctor_diagnosis, bill[1].medicine_name) == ("throat", "Tablet A")


def test_beds(after):
    _, t = after
    counts = {}
    listed = beds.bed_status(t).collect()
    for r in listed:
        counts[r.bed_status] = counts.get(r.bed_status, 0) + 1
    assert counts == {"Available": 5, "Occupied": 4, "Maintenance": 1}
    inside = {r.bed_code: r.current_patient for r in listed if r.current_patient != "Empty"}
    assert inside == {
        "B202-1": "Patient 11", "B203-1": "Patient 12", "B301-1": "Patient 13", "B302-1": "Patient 10",
    }
    by_dept = {r.dept_name: (r.beds_shown, r.beds_available) for r in beds.bed_availability_counts(t).collect()}
    assert by_dept["Internal"] == (3, 3) and by_dept["Birth"] == (2, 1)


def test_people(after):
    _, t = after
    assert dict(rows(people.users_by_role(t))) == {
        "Admin": 1, "Doctor": 20, "Receptionist": 1, "Accountant": 1, "Human Resource (HR)": 1,
    }
    per = people.doctor_profile(t).groupBy("specialty").count().collect()
    assert {r.specialty: r["count"] for r in per} == {
        "Internal": 3, "Children": 4, "Birth": 4, "Ear": 3, "Surgery": 3, "Skin": 3,
    }


def test_policies(after):
    _, t = after
    states = billing.insurance_status(t, datetime(2026, 5, 1)).groupBy("policy_state").count().collect()
    assert {r.policy_state: r["count"] for r in states} == {"Active": 7, "Expired": 3}


def test_free_doctors(after):
    _, t = after
    assert scheduling.doctors_free_on_date(t, date(2026, 4, 30)).count() == 18
    assert scheduling.doctors_free_on_date(t, date(2026, 5, 1)).count() == 19


def test_audit_rows_without_user(after):
    _, t = after
    assert t.audit_logs.count() == 6
    assert t.audit_logs.filter(F.col("user_id").isNotNull()).count() == 0
    assert audit.staff_activity(t).count() == 0 and audit.audit_latest(t).count() == 0


def test_paying_an_inpatient_invoice_frees_the_bed(after, spark):
    _, t = after
    commands = spark.createDataFrame(
        [(1, 12, 2), (2, 9, 23), (3, 999, 2), (4, 8, 77)], "seq bigint, invoice_id bigint, executor_id bigint"
    )
    changes = pricing.pay_invoices(commands, t, NOW)
    done = changes.apply(t)
    assert rows(changes.rejected, "seq") == [2, 4]  # an Admin and an unknown user
    assert rows(changes.audit, "action") == [
        "Processed payment for invoice #12", "Processed payment for invoice #999",
    ]
    invoice = done.invoices.filter("invoice_id = 12").first()
    assert (invoice.payment_status, invoice.net_amount) == ("Paid", Decimal("0.00"))
    assert done.beds.filter("bed_id = 9").first().status == "Available"
    stay = done.admissions.filter("admission_id = 9").first()
    assert (stay.discharge_status, stay.discharge_date) == ("Discharged", NOW)
    assert done.beds.filter("bed_id = 6").first().status == "Occupied"
    # The refused Admin may still read revenue.
    request = spark.createDataFrame([(23, 2023, 10), (1, 2023, 10)], "executor_id bigint, year int, month int")
    report = {r.executor_id: r for r in billing.monthly_revenue_reports(t, request).collect()}
    assert report[23].total_revenue == Decimal("11050000.00")
    assert (report[1].allowed, report[1].total_revenue) == (False, None)
