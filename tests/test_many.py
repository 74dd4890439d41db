"""Many questions in one plan: searches, schedules, trailing counts, against one question at a time."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clinic import at, clinic, rows
from test_plans import no_broadcast, plan_of  # noqa: F401
from wardops.operators.asof import next_after, trailing_counts
from wardops.operators.trigrams import keyword_grams, search_many
from wardops.plans import audit, clinical, scheduling


def test_many_searches_equal_single_ones(spark):
    names = ["Ann Lee", "anna_b", "50% off", "Ünal", "", None, "a", "Ba%ck\\slash", "Lee  Ann", "ANNANN"]
    t = clinic(spark, patients=[(n, name, None, None, f"0{n}1") for n, name in enumerate(names, start=100)])
    words = ["ann", "Ann", "", "%", "a", "A_n", "n%e", "ünal", "0", "__", "50\\%", "\\_b", "nnann", "zzz", "lee", "nn a", "e a"]
    asked = spark.createDataFrame([(w,) for w in [*words, "ann", None]], "keyword string")
    got = sorted((r.keyword, r.patient_id) for r in clinical.patient_search_many(t, asked).collect())
    want = sorted((w, r.patient_id) for w in words for r in clinical.patient_search(t, w).collect())
    assert got == want and len(got) > 40


def test_search_asks_no_product(spark, bridge, no_broadcast):  # noqa: F811
    words = bridge.staff.select(F.col("phone_number").alias("keyword"))
    plan = plan_of(clinical.patient_search_many(bridge, words))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_patterns_with_open_letters_look_up_four_letter_stretches(spark):
    words = ["1234", "12_4", "1_3", "R#%12", "__", "", "a\\_b", "x___y", "50\\%", "ab%c_de"]
    asked = spark.createDataFrame([(w,) for w in words], "keyword string")
    got = {}
    for r in keyword_grams(asked).collect():
        got.setdefault(r.keyword, set()).add(r.gram)
    assert got == {
        "1234": {"1234"}, "12_4": {"12_4"}, "1_3": {"1_3"}, "R#%12": {"r#", "12"}, "__": {""}, "": {""},
        "a\\_b": {"a_b"}, "x___y": {"x", "y"}, "50\\%": {"50"}, "ab%c_de": {"c_de"},
    }


def test_search_of_open_letters_equals_single_ones(spark):
    names = ["a_b", "aXb", "ab", "a%b", "12345", "1x3y5", "x\nb", "aab_", "𝒳b1", "İstanbul", "a\\b", ""]
    t = clinic(spark, patients=[(n, name, None, None, f"0{n}7") for n, name in enumerate(names, start=200)])
    words = ["a_b", "a\\_b", "a\\%b", "1_3_5", "_b", "b_", "1%5", "__b", "_", "a__", "x_b", "𝒳_1", "İs", "i_st", "2_37", "a\\\\b", "_____", "1___5"]
    asked = spark.createDataFrame([(w,) for w in words], "keyword string")
    got = sorted((r.keyword, r.patient_id) for r in clinical.patient_search_many(t, asked).collect())
    want = sorted((w, r.patient_id) for w in words for r in clinical.patient_search(t, w).collect())
    assert got == want and len(got) > 40


def test_search_spreads_texts_and_moves_what_is_asked_for(spark, bridge):
    """Patients in one small file are one task; a wildcard among digits must not bring all that hold two of them."""
    people = bridge.patients.select("patient_id", "full_name", "phone").coalesce(1)
    words = [r[0] for r in bridge.patients.select(F.concat(F.substring("phone", 7, 2), F.lit("_"), F.substring("phone", 10, 1))).distinct().collect()]
    staged = []

    def stage(frame):
        staged.append(frame)
        return frame

    found = search_many(people, "patient_id", ["full_name", "phone"], spark.createDataFrame([(w,) for w in words], "keyword string"), stage)
    posted = staged[1]
    assert "REPARTITION_BY_NUM" in plan_of(posted)
    assert posted.count() <= 3 * found.count()


def test_flow_at_instants_equals_single_instants(spark, bridge):
    stamps = [datetime(1999, 6, 15, 9, 55), datetime(1996, 2, 1, 0, 0), datetime(1990, 1, 1), datetime(2010, 1, 1)]
    first = bridge.appointments.agg(F.min("appt_date"), F.max("appt_date")).first()
    stamps += [first[0], first[0] + timedelta(minutes=30), first[1], first[1] + timedelta(minutes=30, microseconds=1)]
    asked = spark.createDataFrame([(s,) for s in stamps], "as_of timestamp_ntz").crossJoin(bridge.doctors.select("doctor_id"))
    got = rows(scheduling.doctor_schedule_flow_at(bridge, asked.unionByName(asked)), "as_of", "doctor_id", "flow_type", "full_name", "appt_date")
    want = [
        (s, *r) for s in stamps
        for r in rows(scheduling.doctor_schedule_flow(bridge, s), "doctor_id", "flow_type", "full_name", "appt_date")
    ]
    assert sorted(got) == sorted(want) and len(got) > 20


@pytest.mark.parametrize("spread", [3, 90_000_000, 200_000_000_000])
def test_next_after_on_ties_and_near_instants(spark, spread):
    base = datetime(2024, 2, 28, 23, 59, 59, 999_990)
    stamps = [base + timedelta(microseconds=(n * 7919) % 41 * spread) for n in range(60)]
    frame = spark.createDataFrame([(n % 3, s, n) for n, s in enumerate(stamps)], "who int, at timestamp_ntz, n int")
    asked = frame.select("who", (F.col("at") - F.expr("INTERVAL '0.000001' SECOND")).alias("at")).unionByName(frame.select("who", "at"))
    got = {(r.who, r.at): r.next and tuple(r.next) for r in next_after(asked, frame, ["who"], "at", F.struct("at", "n")).collect()}
    for who, when in got:
        later = [(s, n) for n, s in enumerate(stamps) if n % 3 == who and s > when]
        assert got[who, when] == (min(later) if later else None)
    assert len(got) == asked.distinct().count()


def test_trailing_counts_equal_a_plain_count(spark):
    base = datetime(1969, 12, 30, 23, 59, 59, 999_999)
    steps = [0, 0, 1, 2, 86_399_999_999, 86_400_000_000, 86_400_000_001, 90_000_000_000, 172_800_000_000, 172_800_000_000, 10**12]
    stamps = [base + timedelta(microseconds=s) for s in steps]
    frame = spark.createDataFrame([(s,) for s in stamps], "at timestamp_ntz").groupBy("at").agg(F.count("*").alias("n"))
    got = {r.at: r.trailing for r in trailing_counts(frame).collect()}
    assert got == {s: sum(s - timedelta(hours=24) < e <= s for e in stamps) for s in stamps}


def test_trailing_counts_of_an_empty_trail(spark):
    assert audit.actions_trailing_24h(clinic(spark)).collect() == []


def test_trailing_windows_are_bounded_by_the_clock(spark, bridge, no_broadcast):  # noqa: F811
    plan = plan_of(audit.actions_trailing_24h(bridge))
    assert "SinglePartition" not in plan


def test_trailing_stream_in_any_order(spark, tmp_path):
    from wardops.streaming.activity import trailing_24h, write_instants

    stamps = [at(f"2024-01-0{d} {h:02d}:30:00") for d in (3, 1, 2) for h in (5, 5, 9)]
    for n, part in enumerate((stamps[:3], stamps[3:5], stamps[5:])):
        frame = spark.createDataFrame([(s,) for s in part], "ts timestamp_ntz")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_instants(source, "ts", str(tmp_path)).awaitTermination()
    got = {r.timestamp: r.action_count for r in trailing_24h(spark, str(tmp_path)).collect()}
    assert got == {s: sum(s - timedelta(hours=24) < e <= s for e in stamps) for s in stamps}
