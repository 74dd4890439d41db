"""Streams against the batch functions they call."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clinic import at, clinic, rows
from wardops.changes import clinical as care, visits
from wardops.session import stager
from wardops.sources import batches
from wardops.streaming.activity import counts_24h, latest_hours, write_hours
from wardops.streaming.rules import start_rule
from wardops.streaming.store import DeltaStore

NOW = datetime(1999, 6, 15, 9, 55)


def write_parts(commands, folder, parts=3):
    """One file per part, in order of the sequence number."""
    bounds = commands.selectExpr("min(seq) lo", "max(seq) hi").first()
    step = (bounds.hi - bounds.lo) // parts + 1
    for n in range(parts):
        low = bounds.lo + n * step
        part = commands.filter(F.col("seq").between(low, low + step - 1))
        part.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, commands, folder):
    return spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("check_slots", [False, True])
def test_bookings_in_three_batches_equal_one(spark, bridge, tmp_path, check_slots):
    commands = batches.bookings(bridge, NOW)
    write_parts(commands, str(tmp_path / "in"))
    store = DeltaStore(spark, str(tmp_path / "state"), bridge, ["appointments", "invoices", "audit_logs"])

    def rule(batch, t):
        return visits.book_appointments(batch, t, NOW, check_slots, stager(spark, "booked"))

    query = start_rule(stream(spark, commands, str(tmp_path / "in")), rule, store, str(tmp_path / "checkpoint"))
    query.awaitTermination()
    whole = visits.book_appointments(commands, bridge, NOW, check_slots, stager(spark, "whole")).apply(bridge)
    now = store.current()
    for name in ("appointments", "invoices", "audit_logs"):
        assert rows(now[name]) == rows(whole[name])


def test_repeated_epoch_counts_once(spark, bridge, tmp_path):
    """The same epoch written again, as after a failure, leaves one copy."""
    commands = batches.records(bridge)
    store = DeltaStore(spark, str(tmp_path / "state"), bridge, ["appointments", "medical_records", "audit_logs"])
    for epoch in (0, 0):
        before = store.current(before=epoch)
        store.append(epoch, visits.add_records(commands, before, NOW), before)
    whole = visits.add_records(commands, bridge, NOW).apply(bridge)
    assert rows(store.current().medical_records) == rows(whole.medical_records)
    assert rows(store.current().appointments) == rows(whole.appointments)


def test_removed_rows_stay_removed(spark, bridge, tmp_path):
    stage = stager(spark, "test")
    booked = visits.book_appointments(batches.bookings(bridge, NOW), bridge, NOW, stage=stage).apply(bridge)
    booked = booked.replace(**{name: stage(booked[name]) for name in ("appointments", "invoices")})
    commands = batches.appointment_removals(booked)
    store = DeltaStore(spark, str(tmp_path / "state"), booked, ["appointments", "invoices", "audit_logs"])
    for epoch in (0, 1):
        before = store.current(before=epoch)
        store.append(epoch, visits.delete_appointments(commands, before, NOW), before)
    whole = visits.delete_appointments(commands, booked, NOW).apply(booked)
    assert 0 < len(rows(whole.appointments)) < booked.appointments.count()
    assert rows(store.current().appointments) == rows(whole.appointments)
    assert rows(store.current().invoices) == rows(whole.invoices)


def test_lines_reprice_across_batches(spark, tmp_path):
    t = clinic(
        spark,
        appointments=[(1, 1, 1, NOW, None, "Completed")],
        medical_records=[(1, 1, None, "s", "d", "")],
        invoices=[(1, 1, None, NOW, None, "Unpaid")],
    )
    lines = spark.createDataFrame(
        [(1, 1, 1, 1002, 5, "x"), (2, 1, 1, 1004, 1, "x"), (100, 1, 1, 1005, 2, "x")],
        "seq bigint, record_id bigint, doctor_id bigint, med_id bigint, quantity int, dosage string",
    )
    write_parts(lines, str(tmp_path / "in"), parts=2)
    store = DeltaStore(
        spark, str(tmp_path / "state"), t, ["prescriptions", "presc_details", "invoices", "beds", "admissions"]
    )
    query = start_rule(
        stream(spark, lines, str(tmp_path / "in")),
        lambda batch, before: care.prescribe_and_price(batch, before, NOW), store, str(tmp_path / "checkpoint"),
    )
    query.awaitTermination()
    now = store.current()
    assert rows(now.presc_details, "detail_id", "presc_id", "med_id") == [(1, 1, 1002), (2, 1, 1004), (3, 2, 1005)]
    assert str(now.invoices.first().total_amount) == "16.40"  # the second prescription alone


def test_24h_counts(spark, tmp_path):
    events = [at(f"2024-01-0{d} {h:02d}:{m}:00") for d, h, m in [(1, 0, 10), (1, 0, 50), (1, 5, 30), (2, 1, 15), (4, 3, 30)]]
    frame = spark.createDataFrame([(e,) for e in events], "ts timestamp_ntz").select(F.col("ts").cast("timestamp"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    write_hours(source, "ts", str(tmp_path)).awaitTermination()
    counted = {
        r.window_end: (r.action_count, r.is_open)
        for r in counts_24h(latest_hours(spark, str(tmp_path))).withColumn("window_end", F.col("window_end").cast("timestamp_ntz")).collect()
    }
    ends = [at(f"2024-01-0{d} {h:02d}:00:00") for d in (1, 2, 3, 4, 5) for h in range(24)]
    from datetime import timedelta

    expected = {}
    for end in ends:
        n = sum(end - timedelta(hours=24) <= e < end for e in events)
        if n:
            expected[end] = (n, end > at("2024-01-04 02:30:00"))
    assert counted == expected


def test_streams_read_folders_of_part_files(spark, tmp_path):
    from harness import SMALL
    from wardops.streaming.activity import actions_24h_stream

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    one, many = tmp_path / "one", tmp_path / "many"
    events.coalesce(1).write.parquet(f"{one}/events.parquet")
    events.repartition(3).write.parquet(f"{many}/events.parquet")
    want = sorted(map(tuple, actions_24h_stream(spark, SMALL).collect()))
    assert want == sorted(map(tuple, actions_24h_stream(spark, str(one)).collect()))
    assert want == sorted(map(tuple, actions_24h_stream(spark, str(many)).collect()))


def test_uncommitted_epochs_are_not_read(spark, bridge, tmp_path):
    """Rows of an epoch count only once its marks are written; a committed epoch stays as it is."""
    commands = batches.records(bridge)
    store = DeltaStore(spark, str(tmp_path / "state"), bridge, ["appointments", "medical_records", "audit_logs"])
    before = store.current(before=0)
    commit, store._commit = store._commit, lambda *_: None
    store.append(0, visits.add_records(commands, before, NOW), before)
    assert store.changed_rows("medical_records").isEmpty()
    store._commit = commit
    store.append(0, visits.add_records(commands, before, NOW), before)
    written = store.changed_rows("medical_records").count()
    assert written > 0
    store.append(0, visits.add_records(commands.limit(0), before, NOW), before)
    assert store.changed_rows("medical_records").count() == written
