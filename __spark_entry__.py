"""Entry points: the flagship query, every registered query, and its SQL twin.

``queries()`` runs each operator over whole tables.  Scheduling and billing
queries look at 1999-06-15 09:55, audit queries at 2024-01-30 12:00.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import date, datetime

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession, functions as F  # noqa: E402

from oracles import all_sql  # noqa: E402
from wardops import catalog  # noqa: E402
from wardops.changes import billing as pricing, clinical as care, integrity, staff as hiring, visits  # noqa: E402
from wardops.changes.core import Changes, with_defaults  # noqa: E402
from wardops.functions.text import username_slug  # noqa: E402
from wardops.operators.access import permitted, with_role  # noqa: E402
from wardops.operators.numbering import allocate_ids  # noqa: E402
from wardops.operators.rewrite import with_rows  # noqa: E402
from wardops.operators.sequence import guarded  # noqa: E402
from wardops.plans import audit, beds, billing, clinical, clustered, people, scheduling  # noqa: E402
from wardops.schemas import ACCOUNTANT  # noqa: E402
from wardops.session import Stage, configure, shared_folder, stager  # noqa: E402
from wardops.sources import batches  # noqa: E402
from wardops.sources.bridge import bridge_tables  # noqa: E402
from wardops.sources.snapshot import read_snapshot, read_sql_snapshot, read_versions, write_snapshot, write_sql_snapshot  # noqa: E402
from wardops.sources.sqltext import insert_statements  # noqa: E402
from wardops.streaming.activity import actions_24h_stream, actions_trailing_stream  # noqa: E402
from wardops.streaming import demo  # noqa: E402
from wardops.streaming.store import DeltaStore  # noqa: E402
from wardops.tables import Tables  # noqa: E402

try:  # the corpus operators are an optional part
    import corpus_pipeline  # noqa: E402
    from wardops.llm import registry  # noqa: E402
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith(("corpus_pipeline", "wardops.llm")):
        raise
    CORPUS, CORPUS_SQL = {}, {}
else:
    CORPUS, CORPUS_SQL = {**registry.QUERIES, "pipeline": corpus_pipeline.run}, dict(registry.SQL)
    if corpus_pipeline.ORACLE_SQL:
        CORPUS_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

AS_OF = datetime(1999, 6, 15, 9, 55)
AUDIT_AS_OF = datetime(2024, 1, 30, 12)
FIRST, LAST = date(1999, 1, 1), date(1999, 6, 30)
YEAR, MONTH = 1999, 6
KEYWORD = "00012"
REFERRING_DOCTOR = 1_000_001

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """Itemised patient bills: two-parent lookup, OR join, insurance fan-out."""
    return queries()["patient_bill"](spark, "/root/testdata/sf0.001")


def _login_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every audit event as a sign-in; error events carry a wrong password."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select(
        (F.col("event_id") + 1).alias("attempt_id"),
        F.concat(F.lit("user_"), (F.col("user_id") + 1).cast("string")).alias("username"),
        F.when(F.col("event_type") == "error", "wrong")
        .otherwise(F.concat(F.lit("secret_"), (F.col("user_id") + 1).cast("string")))
        .alias("password"),
    )


def _logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bridge_tables(configure(spark), sf_dir)
    return people.resolve_logins(t, _login_attempts(spark, sf_dir))


def _plain_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every second account still holds its password as plain text."""
    t = bridge_tables(configure(spark), sf_dir)
    plain = F.concat(F.lit("secret_"), F.col("user_id").cast("string"))
    stored = F.when(F.col("user_id") % 2 == 0, plain).otherwise(F.col("password_hash"))
    mixed = t.replace(users=t.users.withColumn("password_hash", stored))
    return people.resolve_logins(mixed, _login_attempts(spark, sf_dir), accept_plain=True)


LOGINS: dict[str, Query] = {"resolve_logins": _logins, "resolve_plain_logins": _plain_logins}

READS: dict[str, Callable[[Tables], DataFrame]] = {
    # billing
    "prescription_total": billing.prescription_total,
    "net_pay": lambda t: billing.net_pay(t, AS_OF),
    "patient_bill": billing.patient_bill,
    "active_coverage": lambda t: billing.active_coverage(t, AS_OF),
    "monthly_revenue": lambda t: billing.monthly_revenue(t, YEAR, MONTH),
    "monthly_revenue_empty_month": lambda t: billing.monthly_revenue(t, 2010, 1),
    "monthly_revenue_reports": lambda t: billing.monthly_revenue_reports(
        t, t.users.select(F.col("user_id").alias("executor_id"), F.lit(YEAR).alias("year"), F.lit(MONTH).alias("month"))
    ),
    "monthly_average": lambda t: billing.monthly_average(t, YEAR, MONTH),
    "daily_revenue": lambda t: billing.daily_revenue(t, YEAR, MONTH),
    "revenue_trend_12m": lambda t: billing.revenue_trend_12m(t, AS_OF),
    "payment_history": lambda t: billing.payment_history(t, FIRST, LAST),
    "period_net_revenue": lambda t: billing.period_net_revenue(t, FIRST, LAST),
    "refundable_invoices": lambda t: billing.refundable_invoices(t, FIRST, LAST),
    "pending_invoices": lambda t: billing.pending_invoices(t, AS_OF),
    "pending_invoice_cards": lambda t: billing.pending_invoice_cards(t, AS_OF),
    "invoice_line_items": billing.invoice_line_items,
    "insurance_status": lambda t: billing.insurance_status(t, AS_OF),
    # scheduling
    "receptionist_appointments": scheduling.receptionist_appointments,
    "today_appointments": lambda t: scheduling.today_appointments(t, AS_OF),
    "today_appointment_count": lambda t: scheduling.today_appointment_count(t, AS_OF, "Scheduled"),
    "doctor_work_schedule": lambda t: scheduling.doctor_work_schedule(t, AS_OF),
    "doctor_day_sheet": lambda t: scheduling.doctor_day_sheet(t, AS_OF),
    "doctors_free_on_date": lambda t: scheduling.doctors_free_on_date(t, AS_OF),
    "doctor_schedule_flow": lambda t: scheduling.doctor_schedule_flow(t, AS_OF),
    "slot_available_doctors": lambda t: scheduling.slot_available_doctors(t, AS_OF),
    "referral_candidates": lambda t: scheduling.referral_candidates(t, REFERRING_DOCTOR, AS_OF),
    "doctor_patients_today": lambda t: scheduling.doctor_patients_today(t, AS_OF),
    "patient_today_appointments": lambda t: scheduling.patient_today_appointments(t, AS_OF),
    "doctor_schedule_flow_at": lambda t: scheduling.doctor_schedule_flow_at(t, batches.schedule_questions(t)),
    # clinical
    "patient_search_many": lambda t: clinical.patient_search_many(t, batches.search_keywords(t)),
    "patient_search": lambda t: clinical.patient_search(t, KEYWORD),
    "patient_profile": clinical.patient_profile,
    "patient_history": clinical.patient_history,
    "exam_queue": clinical.exam_queue,
    "exam_profile_cards": clinical.exam_profile_cards,
    "medicine_catalogue": clinical.medicine_catalogue,
    "prescription_items": clinical.prescription_items,
    # beds
    "bed_status": beds.bed_status,
    "bed_board": beds.bed_board,
    "bed_availability_counts": beds.bed_availability_counts,
    # people
    "staff_directory": people.staff_directory,
    "staff_by_department": people.staff_by_department,
    "doctor_appointment_counts": people.doctor_appointment_counts,
    "doctor_profile": people.doctor_profile,
    "staff_accounts": people.staff_accounts,
    "users_by_role": people.users_by_role,
    "executor_roles": lambda t: people.executor_roles(t, t.audit_logs.select(F.col("user_id").alias("executor_id"))),
    "reference_lists": people.reference_lists,
    # audit
    "staff_activity": audit.staff_activity,
    "actions_last_24h": lambda t: audit.actions_last_24h(t, AUDIT_AS_OF),
    "actions_trailing_24h": audit.actions_trailing_24h,
    "login_history": audit.login_history,
    "login_frequency": audit.login_frequency,
    "audit_latest": audit.audit_latest,
    "home_kpis": lambda t: audit.home_kpis(t, AS_OF),
    # one value of an optional filter
    "staff_directory_of_role": lambda t: people.staff_directory(t, "NATION_6", "Doctor"),
    "staff_by_department_of_one": lambda t: people.staff_by_department(t, 7),
    "today_appointments_in_state": lambda t: scheduling.today_appointments(t, AS_OF, "CheckedIn"),
    "patient_history_of_one": lambda t: clinical.patient_history(t, 17),
    "doctor_schedule_flow_of_one": lambda t: scheduling.doctor_schedule_flow(t, AS_OF, REFERRING_DOCTOR),
    "bed_status_free": lambda t: beds.bed_status(t, status="Available"),
    "username_slugs": lambda t: t.staff.select("staff_id", username_slug("st_", F.col("full_name")).alias("username")),
    "directory_by_sql": lambda t: _directory_by_sql(t),
    # stored states
    "snapshot_invoices": lambda t: _stored_invoices(t),
    "patient_bill_clustered": lambda t: _clustered_bill(t),
    "snapshot_versions": lambda t: _invoice_versions(t),
    "snapshot_sql_read_back": lambda t: _patients_as_text(t),
}


def _stage(t: Tables, purpose: str) -> Stage:
    return stager(t.users.sparkSession, purpose)


def _register(t: Tables) -> Changes:
    return care.register_patients(batches.registrations(t, AS_OF), t, AS_OF, _stage(t, "registrations"))


def _prescribe(t: Tables) -> Changes:
    return care.prescribe(batches.prescription_lines(t), t)


def _book(t: Tables, check_slots: bool = False) -> Changes:
    return visits.book_appointments(batches.bookings(t, AS_OF), t, AS_OF, check_slots, _stage(t, "bookings"))


def _record(t: Tables) -> Changes:
    return visits.add_records(batches.records(t), t, AS_OF)


def _reprice(t: Tables) -> Changes:
    """Every present line counts as just changed, in order of its prescription."""
    changed = t.presc_details.select("presc_id", F.col("presc_id").alias("change_seq"))
    return pricing.reprice_invoices(changed, t, AS_OF)


def _reprice_new_lines(t: Tables) -> DataFrame:
    stage = stager(t.prescriptions.sparkSession, "new-lines")
    return care.prescribe_and_price(batches.prescription_lines(t), t, AS_OF, stage).updates["invoices"]


def _pay(t: Tables) -> Changes:
    return pricing.pay_invoices(batches.payments(t), t, AS_OF)


def _with_hr(t: Tables) -> Tables:
    """The bridge leaves one role without users; here user 16 works in HR."""
    hr = F.lit(5).cast(t.users.schema["role_id"].dataType)
    return t.replace(users=t.users.withColumn("role_id", F.when(F.col("user_id") == 16, hr).otherwise(F.col("role_id"))))


def _hire(t: Tables) -> Changes:
    t = _with_hr(t)
    return hiring.add_staff(batches.new_staff(t), t, AS_OF, _stage(t, "new-staff"))


def _move(t: Tables) -> Changes:
    return hiring.transfer_staff(batches.transfers(t), t, AS_OF)


def _dismiss(t: Tables) -> tuple[Changes, Tables]:
    """Everyone is to go, new colleagues too: those hired as doctors have no patients yet."""
    hired = _hire(t).apply(_with_hr(t))
    return hiring.delete_staff(batches.staff_removals(hired), hired, AS_OF, _stage(t, "staff-removals")), hired


def _remove_visits(t: Tables) -> tuple[Changes, Tables]:
    """All visits are to go, freshly booked ones too: those have no record yet."""
    booked = _book(t).apply(t)
    return visits.delete_appointments(batches.appointment_removals(booked), booked, AS_OF, _stage(t, "removals")), booked


def _after(result: tuple[Changes, Tables]) -> Tables:
    changes, before = result
    return changes.apply(before)


def _dirty(t: Tables) -> Tables:
    """The tables with unchecked commands appended as if they were rows."""
    people_rows = batches.registrations(t, AS_OF).withColumn("patient_id", F.col("seq"))
    visit_rows = batches.bookings(t, AS_OF).withColumn("appt_id", F.col("seq")).withColumn("status", F.lit("Scheduled"))
    return t.replace(
        patients=with_rows(t.patients, people_rows),
        appointments=with_rows(with_rows(t.appointments, visit_rows), batches.visit_states(t)),
    )


def _after_last_removed(t: Tables) -> DataFrame:
    """Bookings made after the newest visits were deleted; their ids stay used."""
    newest = t.appointments.filter(F.col("appt_id") > t.appointments.agg(F.max("appt_id")).scalar() - 100)
    left = Changes(deletes={"appointments": newest.select("appt_id")}).apply(t)
    booked = visits.book_appointments(batches.bookings(t, AS_OF), left, AS_OF, stage=_stage(t, "bookings"))
    return booked.inserts["appointments"]


def _root(t: Tables, purpose: str) -> str:
    return shared_folder(t.users.sparkSession, purpose)


def _stored_invoices(t: Tables) -> DataFrame:
    """Invoices through a snapshot: written by month, read by the declared schema."""
    folder = write_snapshot(Tables({name: t[name] for name in ("roles", "invoices")}), _root(t, "snapshots"), AS_OF)
    return read_snapshot(t.users.sparkSession, folder).invoices.drop("invoice_month")


def _invoice_versions(t: Tables) -> DataFrame:
    """An older snapshot without net amounts and with narrower totals beside a present one."""
    root = _root(t, "versions")
    old = t.invoices.drop("net_amount").withColumn("total_amount", F.col("total_amount").cast("decimal(9,1)"))
    write_snapshot(Tables({"invoices": old}), root, datetime(1998, 1, 1))
    write_snapshot(Tables({"invoices": t.invoices}), root, AS_OF)
    found = read_versions(t.users.sparkSession, root, "invoices")
    return found.select("snapshot", "invoice_id", "total_amount", "net_amount")


def _clustered_bill(t: Tables) -> DataFrame:
    """The bill over tables stored by visit; buckets follow the session's shuffle partitions."""
    spark = t.users.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = clustered.write_visit_store(t, _root(t, "visit-store"), buckets)
    return clustered.clustered_bill(clustered.read_visit_store(spark, folder))


def _newest_first(t: Tables, commands: DataFrame, late: Column, rule: Callable[[DataFrame, Tables], Changes], writes: list[str]) -> Tables:
    """Two micro-batches: what is not late first, then the late commands."""
    t = guarded(t)
    store = DeltaStore(t.users.sparkSession, _root(t, "late-commands"), t, [*writes, "command_marks"], _stage(t, "late-updates"))
    for epoch, part in enumerate((commands.filter(~late), commands.filter(late))):
        before = store.current(before=epoch)
        store.append(epoch, rule(part, before), before)
    return store.current()


def _late_states(t: Tables) -> DataFrame:
    """Every visit's second command arrives before its first."""
    first = F.col("seq") % 2 == 0
    rule = lambda c, before: visits.set_visit_state(c, before, AS_OF, stage=_stage(t, "late-states"))
    return _newest_first(t, batches.visit_states(t), first, rule, ["appointments"]).appointments


def _late_changes(t: Tables) -> DataFrame:
    """The newer prescription of a record is repriced before the older one."""
    changed = t.presc_details.select("presc_id", F.col("presc_id").alias("change_seq"))
    rule = lambda c, before: pricing.reprice_invoices(c, before, AS_OF, stage=_stage(t, "late-prices"))
    after = _newest_first(t, changed, F.col("presc_id") % 2 == 0, rule, ["invoices", "beds", "admissions"])
    return after.invoices.select("invoice_id", "total_amount")


def _patients_as_text(t: Tables) -> DataFrame:
    """Patients with quotes, commas and line ends in their names, written as SQL text and read back."""
    name = F.concat("full_name", F.lit(" 'O''Neil',\nNULL);\n"), F.col("phone"))
    odd = Tables({"patients": t.patients.withColumn("full_name", name).withColumn("gender", F.when(F.col("patient_id") % 2 == 0, F.col("gender")))})
    folder = write_sql_snapshot(odd, _root(t, "sql-text"), AS_OF)
    return read_sql_snapshot(t.users.sparkSession, folder, ["patients"]).patients


def _directory_by_sql(t: Tables) -> DataFrame:
    spark = t.users.sparkSession
    catalog.register(spark, t, AS_OF)
    text = "SELECT staff_id, full_name, dept_name FROM view_hr_staff_directory WHERE role_name = :role AND staff_id > :after"
    return spark.sql(text, args={"role": "Doctor", "after": 10})


CHANGES: dict[str, Callable[[Tables], DataFrame]] = {
    "w01_new_patients": lambda t: _register(t).inserts["patients"],
    "w01_new_profiles": lambda t: _register(t).inserts["patient_health_profile"],
    "w01_new_policies": lambda t: _register(t).inserts["insurance"],
    "w01_rejected": lambda t: _register(t).rejected,
    "w02_new_prescriptions": lambda t: _prescribe(t).inserts["prescriptions"],
    "w02_new_lines": lambda t: _prescribe(t).inserts["presc_details"].drop("seq"),
    "w02_rejected": lambda t: _prescribe(t).rejected,
    "w03_new_appointments": lambda t: _book(t).inserts["appointments"],
    "w03_new_invoices": lambda t: _book(t).inserts["invoices"],
    "w03_audit": lambda t: _book(t).audit_rows(t),
    "w03_slot_conflicts": lambda t: _book(t, check_slots=True).rejected,
    "w03_checked_appointments": lambda t: _book(t, check_slots=True).inserts["appointments"],
    "w03_booking_slips": lambda t: visits.booking_slips(_book(t), t),
    "w04_appointments": lambda t: visits.set_visit_state(batches.visit_states(t), t, AS_OF).apply(t).appointments,
    "w04_late_commands": lambda t: _late_states(t),
    "w05_new_records": lambda t: _record(t).inserts["medical_records"],
    "w05_appointments": lambda t: _record(t).apply(t).appointments,
    "w05_audit": lambda t: _record(t).audit_rows(t),
    "w05_rejected": lambda t: _record(t).rejected,
    "w06_repriced_invoices": lambda t: _reprice(t).updates["invoices"],
    "w06_after_new_lines": _reprice_new_lines,
    "w06_late_changes": lambda t: _late_changes(t),
    "w07_paid_invoices": lambda t: _pay(t).updates["invoices"],
    "w07_invoices": lambda t: _pay(t).apply(t).invoices,
    "w07_rejected": lambda t: _pay(t).rejected,
    "w07_audit": lambda t: _pay(t).audit_rows(t),
    "w08_beds": lambda t: _reprice(t).apply(t).beds,
    "w08_admissions": lambda t: _reprice(t).apply(t).admissions,
    "w09_invoice_states": lambda t: pricing.set_payment_state(batches.payment_states(t), t)
    .apply(t).invoices.select("invoice_id", "payment_status"),
    "w10_policies": lambda t: pricing.update_policies(batches.policy_changes(t), t).apply(t).insurance,
    "w11_admissions": lambda t: visits.discharge(batches.discharges(t), t, AS_OF).apply(t).admissions,
    "w12_new_users": lambda t: _hire(t).inserts["users"],
    "w12_new_staff": lambda t: _hire(t).inserts["staff"],
    "w12_new_doctors": lambda t: _hire(t).inserts["doctors"],
    "w12_rejected": lambda t: _hire(t).rejected,
    "w13_staff": lambda t: _move(t).apply(t).staff,
    "w13_audit": lambda t: _move(t).audit_rows(t),
    "w14_staff": lambda t: _after(_dismiss(t)).staff,
    "w14_doctors": lambda t: _after(_dismiss(t)).doctors,
    "w14_rejected": lambda t: _dismiss(t)[0].rejected,
    "w15_appointments": lambda t: _after(_remove_visits(t)).appointments,
    "w15_invoices": lambda t: _after(_remove_visits(t)).invoices,
    "w15_rejected": lambda t: _remove_visits(t)[0].rejected,
    "w15_audit": lambda t: (lambda changes, booked: changes.audit_rows(booked))(*_remove_visits(t)),
    "w16_login_log": lambda t: hiring.log_logins(batches.logins(t), t, AS_OF).apply(t).audit_logs,
    "w17_gated_payments": lambda t: with_role(batches.payments(t), t).select(
        "seq", "executor_id", "role_name", permitted([ACCOUNTANT]).alias("allowed")
    ),
    "w18_ids_after_removal": _after_last_removed,
    "w18_allocated_ids": lambda t: allocate_ids(
        t.audit_logs.select("log_id"), "log_id", t.audit_logs.select(F.col("log_id").alias("new_id")), "new_id"
    ),
    "w20_defaulted_beds": lambda t: with_defaults("beds", t.beds.drop("status")),
    "integrity_violations": lambda t: integrity.violations(_dirty(t), AS_OF),
    "snapshot_sql_text": lambda t: insert_statements("invoices", t.invoices),
}

STREAMS: dict[str, Query] = {
    "actions_24h_stream": actions_24h_stream,
    "actions_trailing_stream": actions_trailing_stream,
    "bookings_stream": demo.bookings_stream,
    "records_stream": demo.records_stream,
    "lines_stream": demo.lines_stream,
    "payments_stream": demo.payments_stream,
    "logins_stream": demo.logins_stream,
}


def _over_bridge(run: Callable[[Tables], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = bridge_tables(configure(spark), sf_dir)
        return run(t)

    return query


def queries() -> dict[str, Query]:
    plain = {name: _over_bridge(run) for name, run in {**READS, **CHANGES}.items()}
    return {**plain, **LOGINS, **STREAMS, **CORPUS}


def oracle_sql() -> dict[str, str]:
    return {**all_sql(), **CORPUS_SQL}
