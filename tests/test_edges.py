"""Rows that decide the exact meaning of a rule."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clinic import ROLES, at, money, on, rows, tables
from wardops.changes import billing as pricing, integrity, visits
from wardops.functions import clock, money as m, text
from wardops.operators.coverage import active_policy
from wardops.operators.exclusion import not_in
from wardops.plans import billing, clinical, scheduling
from wardops.session import stager
from wardops.sources.sqltext import insert_statements

NOW = datetime(2026, 5, 1, 12)
DOCTORS = {
    "departments": [(1, "Ear"), (2, "Eye")],
    "staff": [(n, f"Doc {n}", None, None, None, None, None, 1) for n in (1, 2, 3)],
    "doctors": [(10, 1, "a"), (20, 2, "b"), (30, 3, "a")],
    "patients": [(1, "Ann", on("1990-01-01"), "Female", "031", "a@x"), (2, "Bob", on("1991-01-01"), "Male", "032", "b@x")],
}


def appointment(number, doctor, when, status, done=None):
    return (number, 1, doctor, at(when), at(done), status)


def free(spark, appointments):
    t = tables(spark, **DOCTORS, appointments=appointments)
    return (
        rows(scheduling.doctors_free_on_date(t, NOW), "staff_id"),
        rows(scheduling.slot_available_doctors(t, NOW), "doctor_id"),
    )


def test_null_doctor_empties_not_in(spark):
    assert free(spark, [appointment(1, None, "2026-05-01 12:00:00", "Scheduled")]) == ([], [])


def test_no_appointments_leaves_all(spark):
    assert free(spark, []) == ([1, 2, 3], [10, 20, 30])


def test_slot_edge_is_strict(spark):
    appointments = [
        appointment(1, 10, "2026-05-01 12:30:00", "Scheduled"),
        appointment(2, 20, "2026-05-01 12:29:59", "CheckedIn"),
        appointment(3, 30, "2026-05-01 11:30:01", "In-Progress"),
    ]
    assert free(spark, appointments) == ([], [10])


def test_cancelled_is_busy_for_the_day_but_free_for_the_slot(spark):
    assert free(spark, [appointment(1, 10, "2026-05-01 12:00:00", "Cancelled")]) == ([2, 3], [10, 20, 30])


def test_never_completed_doctors_lead(spark):
    t = tables(spark, **DOCTORS, appointments=[
        appointment(1, 10, "2026-04-30 12:00:00", "Completed", "2026-05-01 11:00:40"),
        appointment(2, 20, "2026-04-30 12:00:00", "Completed", "2026-05-01 13:10:00"),
    ])
    listed = [(r.doctor_id, r.minutes_from_slot) for r in scheduling.slot_available_doctors(t, NOW).collect()]
    assert listed == [(30, 0), (10, 59), (20, 70)]
    others = scheduling.referral_candidates(t, 30, datetime(2026, 5, 1, 11, 55)).collect()
    assert [r.doctor_id for r in others] == [10, 20]


def test_not_in_keeps_null_keys_only_without_exclusions(spark):
    left = spark.createDataFrame([(1,), (None,)], "k bigint")
    none = spark.createDataFrame([], "k bigint")
    assert rows(not_in(left, "k", none), "k") == [1, None]
    assert rows(not_in(left, "k", spark.createDataFrame([(2,)], "k bigint")), "k") == [1]


POLICIES = [
    ("A", 1, money("0.20"), on("2027-01-01"), "x"), ("B", 1, money("0.30"), on("2028-01-01"), "x"),
    ("C", 1, money("0.40"), on("2028-01-01"), "x"), ("D", 2, money("0.50"), on("2026-04-30"), "x"),
]


def test_latest_policy_then_highest_id(spark):
    t = tables(spark, insurance=POLICIES)
    assert rows(active_policy(t, NOW)) == [(1, Decimal("0.40"))]
    assert rows(active_policy(t, datetime(2026, 4, 30, 23))) == [(1, Decimal("0.40")), (2, Decimal("0.50"))]


def test_bill_uses_every_policy_even_expired(spark):
    t = tables(
        spark, **DOCTORS, insurance=POLICIES,
        appointments=[(1, 1, 10, NOW), (2, 2, 10, NOW)],
        invoices=[(1, 1, None, NOW, money("100.00"), "Paid"), (2, 2, None, NOW, money("100.00"), "Paid")],
    )
    assert rows(billing.patient_bill(t), "invoice_id", "net_pay") == [
        (1, Decimal("60.00")), (1, Decimal("70.00")), (1, Decimal("80.00")), (2, Decimal("50.00")),
    ]
    assert rows(billing.net_pay(t, NOW), "invoice_id", "coverage_rate") == [(1, Decimal("0.40")), (2, Decimal("0.00"))]


def test_rounding_half_up(spark):
    amounts = spark.createDataFrame([(money("10.05"), money("0.50"))], "g decimal(10,2), r decimal(3,2)")
    assert amounts.select(m.net_pay(F.col("g"), F.col("r"))).first()[0] == Decimal("5.03")
    assert amounts.select(m.net_pay(F.col("g"), F.lit(None).cast("decimal(3,2)"))).first()[0] == Decimal("10.05")


def test_two_revenue_rules_differ_on_zero_net(spark):
    t = tables(spark, invoices=[(1, None, None, NOW, money("100.00"), "Paid", money("0.00"))])
    assert billing.monthly_revenue(t, 2026, 5).first().total_revenue == 0
    period = billing.period_net_revenue(t, date(2026, 5, 1), date(2026, 5, 1)).first()
    assert (period.total_net_revenue, period.total_display) == (Decimal("100.00"), "$100.00")
    assert billing.period_net_revenue(t, date(2026, 6, 1), date(2026, 6, 1)).first().total_net_revenue == 0


BOTH = {
    **DOCTORS,
    "appointments": [(1, 1, 10, at("2026-04-01 08:00:00"), None, "Completed"), (2, None, 10, None, None, None)],
    "admissions": [(1, 2, 10, 1, at("2026-03-01 08:00:00"), None, "Admitted")],
}


def test_both_parents_match_once(spark):
    t = tables(
        spark, **BOTH,
        medical_records=[(1, 1, 1, "s", "both", ""), (2, None, 1, "s", "stay", ""), (3, 1, None, "s", "visit", "")],
        invoices=[
            (1, 1, 1, NOW, money("9.00"), "Paid"), (2, 1, None, NOW, money("9.00"), "Paid"),
            (3, None, 1, NOW, money("9.00"), "Paid"), (4, None, None, NOW, money("9.00"), "Paid"),
            (5, 2, 1, NOW, money("9.00"), "Paid"), (6, 2, 77, NOW, money("9.00"), "Paid"),
        ],
    )
    # Each invoice with each record that shares either parent, never twice.
    assert rows(billing.patient_bill(t), "invoice_id", "patient_name", "doctor_diagnosis") == sorted([
        (1, "Ann", "both"), (1, "Ann", "stay"), (1, "Ann", "visit"),
        (2, "Ann", "both"), (2, "Ann", "visit"), (3, "Bob", "both"), (3, "Bob", "stay"),
        (4, None, None), (5, "Bob", "both"), (5, "Bob", "stay"), (6, None, None),
    ], key=repr)


def test_history_through_either_parent(spark):
    t = tables(spark, **BOTH, medical_records=[(1, 1, 1, "s", "both", ""), (2, None, 1, "s", "stay", "")])
    found = rows(clinical.patient_history(t), "patient_id", "record_id", "event_date", "visit_type")
    first, second = at("2026-04-01 08:00:00"), at("2026-03-01 08:00:00")
    assert found == [(1, 1, first, "Outpatient"), (2, 1, first, "Outpatient"), (2, 2, second, "Inpatient")]
    assert rows(clinical.patient_history(t, patient_id=1), "record_id") == [1]


def test_visit_end_does_not_wrap(spark):
    at_night = spark.createDataFrame([(at("2026-05-01 23:45:00"),)], "t timestamp_ntz")
    assert at_night.select(clock.visit_end_text(F.col("t"))).first()[0] == "24:15:00"


def test_twelve_months_clamp_to_month_end(spark):
    t = tables(spark, invoices=[
        (1, None, None, at("2023-02-28 12:00:00"), money("1.00"), "Paid"),
        (2, None, None, at("2023-02-28 11:59:59"), money("2.00"), "Paid"),
        (3, None, None, at("2030-01-01 00:00:00"), money("4.00"), "Paid"),
    ])
    trend = billing.revenue_trend_12m(t, datetime(2024, 2, 29, 12)).collect()
    assert [(r.month_label, r.revenue) for r in trend] == [("2/2023", 1), ("1/2030", 4)]


def test_active_visit_bounds(spark):
    t = tables(spark, **DOCTORS, appointments=[
        appointment(1, 10, "2026-05-01 11:30:00", "CheckedIn"), appointment(2, 20, "2026-05-01 11:29:59", "CheckedIn"),
        appointment(3, 30, "2026-05-01 12:00:00", "In-Progress"), appointment(4, 30, "2026-05-01 12:00:01", "Scheduled"),
        appointment(5, 30, "2026-05-01 13:00:00", "Scheduled"),
    ])
    assert rows(scheduling.doctor_schedule_flow(t, NOW), "flow_type", "doctor_id", "clock") == [
        ("Active", 10, "11:30"), ("Active", 30, "12:00"), ("Next", 30, "12:00"),
    ]


def test_search_wildcards_case_and_accents(spark):
    t = tables(spark, patients=[
        (1, "José Núñez", None, None, "0301"), (2, "Anna 100%", None, None, "0302"), (3, "Xu", None, None, None),
    ])
    assert rows(clinical.patient_search(t, "ANNA"), "patient_id") == [2]
    assert rows(clinical.patient_search(t, "03_1"), "patient_id") == [1]
    assert rows(clinical.patient_search(t, "nunez"), "patient_id") == []
    assert rows(clinical.patient_search(t, "nunez", ignore_accents=True), "patient_id") == [1]
    assert rows(clinical.patient_search(t, "0%", ignore_accents=True), "patient_id") == [2]


def test_ids_pad_but_never_cut(spark):
    ids = spark.createDataFrame([(7,), (12345,)], "n bigint")
    assert rows(ids.select(text.padded_policy_id(2026, F.col("n")).alias("x")), "x") == [
        "INS-2026-0007", "INS-2026-12345",
    ]
    names = spark.createDataFrame([("Ann B Lee",)], "n string")
    assert names.select(text.username_slug("dr_", F.col("n"))).first()[0] == "dr_ann_b_lee"


def test_sql_text_quotes(spark):
    t = tables(spark, patients=[(1, "O'Neil", on("1990-01-02"), None, "1")], medicines=[(1, "m", 2, money("1.50"))])
    assert insert_statements("patients", t.patients).first()[0] == (
        "INSERT INTO `patients` VALUES (1, 'O''Neil', '1990-01-02', NULL, '1', NULL);"
    )
    assert insert_statements("medicines", t.medicines).first()[0] == (
        "INSERT INTO `medicines` VALUES (1, 'm', 2, '1.50', NULL);"
    )


def priced(spark, changes, **more):
    t = tables(spark, **BOTH, **{
        "medicines": [(1, "m", 1, money("2.00")), (2, "n", 1, money("5.00"))],
        "beds": [(1, "b", 1, "Occupied")],
        "medical_records": [(1, None, 1, "s", "d", ""), (2, 1, None, "s", "d", "")],
        "prescriptions": [(1, 1, 10), (2, 1, 10), (3, 2, 10)],
        "presc_details": [(1, 1, 1, 3, "x"), (2, 2, 2, 4, "x")],
        "invoices": [(1, None, 1, NOW, money("1.00"), "Paid"), (2, 1, None, NOW, money("1.00"), "Unpaid")],
        **more,
    })
    changed = spark.createDataFrame(changes, "presc_id bigint, change_seq bigint")
    return t, pricing.reprice_invoices(changed, t, NOW).apply(t)


def test_last_changed_prescription_sets_the_price(spark):
    _, first = priced(spark, [(1, 9), (2, 8)])
    assert rows(first.invoices, "invoice_id", "total_amount") == [(1, Decimal("6.00")), (2, Decimal("1.00"))]
    _, second = priced(spark, [(1, 7), (2, 8), (3, 1)])
    # Prescription 3 has lost its last line: the total is 0.
    assert rows(second.invoices, "invoice_id", "total_amount") == [(1, Decimal("20.00")), (2, Decimal("0.00"))]


def test_repricing_a_paid_stay_frees_the_bed_again(spark):
    _, done = priced(spark, [(1, 1)])
    assert done.beds.first().status == "Available"
    assert done.admissions.first().discharge_date == NOW
    t, untouched = priced(spark, [(3, 1)])
    assert untouched.beds.first().status == "Occupied"
    changed = spark.createDataFrame([(1, 1)], "presc_id bigint, change_seq bigint")
    once = pricing.reprice_invoices(changed, t, NOW, only_on_transition=True).apply(t)
    assert once.beds.first().status == "Occupied"


def test_delete_with_children_is_refused(spark):
    t = tables(
        spark, **BOTH, roles=ROLES, users=[(5, "u", None, 3)],
        medical_records=[(1, 1, None, "s", "d", "")],
        invoices=[(1, 1, None, NOW, money("1.00"), "Paid"), (2, 2, None, NOW, money("1.00"), "Paid")],
    )
    commands = spark.createDataFrame([(1, 1, 5), (2, 2, 5), (3, 2, 5), (4, 2, 6)], "seq bigint, appt_id bigint, executor_id bigint")
    changes = visits.delete_appointments(commands, t, NOW)
    done = changes.apply(t)
    assert rows(done.appointments, "appt_id") == [1] and rows(done.invoices, "invoice_id") == [1]
    assert rows(changes.rejected, "seq") == [1, 4]
    assert rows(changes.audit, "seq", "action") == [(2, None), (3, None)]  # no patient on appointment 2


def test_integrity_reports_each_broken_rule(spark):
    t = tables(
        spark, **{**DOCTORS, "patients": [*DOCTORS["patients"], (2, "", on("1890-01-01"), None, "9" * 16, "a@x")]},
        insurance=[("A", 1, money("1.50"), None, "x"), (None, 99, money("0.10"), None, "x")],
        beds=[(1, "b", None, "Broken")],
        presc_details=[(1, None, None, 0, "x")],
    )
    found = set(rows(integrity.violations(t, NOW), "table_name", "rule", "column_name", "rows_affected"))
    assert found == {
        ("patients", "key", "patient_id", 2), ("patients", "unique", "email", 2),
        ("patients", "required", "full_name", 1), ("patients", "range", "dob", 1),
        ("patients", "length", "phone", 1), ("insurance", "range", "coverage_rate", 1),
        ("insurance", "key", "insurance_id", 1), ("insurance", "reference", "patient_id", 1),
        ("beds", "domain", "status", 1), ("presc_details", "range", "quantity", 1),
        ("staff", "required", "phone_number", 3), ("staff", "required", "email", 3),
    }


@pytest.mark.parametrize("gap, clash", [(29, True), (30, False), (-29, True), (-30, False), (0, True)])
def test_slot_clash_band(spark, gap, clash):
    from wardops.operators.slots import clashing_requests

    for start in ("2026-05-01 12:00:00", "2026-05-01 12:14:00"):
        when = at(start)
        t = tables(spark, appointments=[appointment(1, 10, start, "Scheduled"), appointment(2, 10, "2026-05-01 20:00:00", "Scheduled")])
        from datetime import timedelta

        asked = spark.createDataFrame([(1, 10, when + timedelta(minutes=gap))], "seq bigint, doctor_id bigint, appt_date timestamp_ntz")
        assert (clashing_requests(asked, t, "seq").count() == 1) is clash


def test_requests_of_one_batch_respect_each_other(spark):
    from wardops.operators.slots import granted_requests

    times = {  # seq -> (doctor, time); 3 falls to 1, so 4 is free again; 6 and 9 ask for what others have
        1: (10, "12:00"), 2: (20, "12:00"), 3: (10, "12:20"), 4: (10, "12:40"), 5: (10, "13:10"), 6: (10, "12:00"),
        7: (10, "15:00"), 8: (10, "11:30"), 9: (20, "11:31"), 10: (20, "12:30"),
    }
    asked = spark.createDataFrame(
        [(seq, doctor, at(f"2026-05-01 {time}:00")) for seq, (doctor, time) in times.items()] + [(11, 10, None)],
        "seq bigint, doctor_id bigint, appt_date timestamp_ntz",
    )
    assert sorted(r.seq for r in granted_requests(asked, "seq", stager(spark, "test")).collect()) == [1, 2, 4, 5, 7, 8, 10]


def test_crowded_requests_equal_one_by_one(spark):
    """A third of all requests on one doctor at microsecond instants, many at or just beside half-hour borders."""
    from wardops.operators.slots import granted_requests

    rng, start = random.Random(4), at("2026-05-01 00:00:00")
    half = timedelta(minutes=30)
    asked = []
    for seq in rng.sample(range(3000), 900):
        doctor = 10 if seq % 3 == 0 else rng.randrange(20, 40)
        edge = half * rng.randrange(12) + timedelta(microseconds=rng.choice([-1, 0, 1]))
        crowd = timedelta(hours=3) + timedelta(microseconds=rng.randrange(200))
        any_time = timedelta(microseconds=rng.randrange(6 * 3600 * 10**6))
        asked.append((seq, doctor, start + rng.choice([edge, crowd, any_time, any_time])))
    granted: dict[int, list] = {}
    expected = []
    for seq, doctor, when in sorted(asked):
        if all(abs(when - other) >= half for other in granted.setdefault(doctor, [])):
            granted[doctor].append(when)
            expected.append(seq)
    frame = spark.createDataFrame(asked, "seq bigint, doctor_id bigint, appt_date timestamp_ntz")
    assert sorted(r.seq for r in granted_requests(frame, "seq", stager(spark, "test")).collect()) == expected


def test_session_time_zone_does_not_matter(spark):
    """02:30 does not exist in New York on this day; zone-less times keep it."""
    night = at("2024-03-10 02:30:00")
    t = tables(
        spark, **DOCTORS,
        appointments=[
            (1, 1, 10, night, None, "Scheduled"),
            (2, 1, 20, at("2024-03-09 00:00:00"), at("2024-03-10 00:30:00"), "Completed"),
        ],
        audit_logs=[(1, None, "a", night), (2, None, "b", datetime(2024, 3, 10, 2, 30, 0, 500))],
    )
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert rows(scheduling.today_appointments(t, night), "clock") == ["02:30"]
        assert rows(scheduling.doctor_work_schedule(t, night), "schedule_time", "end_time") == [
            ("00:00:00", "00:30:00"), ("02:30:00", "03:00:00"),
        ]
        listed = dict(rows(scheduling.slot_available_doctors(t, at("2024-03-10 04:00:00")), "doctor_id", "minutes_from_slot"))
        assert listed == {10: 0, 20: 210, 30: 0}
        assert rows(scheduling.slot_available_doctors(t, at("2024-03-10 02:59:59")), "doctor_id") == [20, 30]
        asked = spark.createDataFrame([(1, 10, at("2024-03-10 02:01:00")), (2, 10, at("2024-03-10 03:00:00"))], "seq bigint, doctor_id bigint, appt_date timestamp_ntz")
        from wardops.operators.slots import clashing_requests

        assert rows(clashing_requests(asked, t, "seq")) == [(1,)]
        assert "'2024-03-10 02:30:00.000500'" in insert_statements("audit_logs", t.audit_logs).filter("statement LIKE '%(2,%'").first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
