"""Distributed numbering against a plain count."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from wardops.operators.numbering import allocate_ids, dense_number, running_number

START = datetime(2024, 1, 1)
BIG = st.integers(min_value=-(2**63), max_value=2**63 - 1)


@given(st.sets(BIG | st.integers(min_value=-5, max_value=200_000), min_size=1, max_size=60))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_dense_number_any_unique_sequence(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "seq bigint")
    numbered = {r.seq: r.n for r in dense_number(rows, "seq", "n").collect()}
    assert numbered == {v: i for i, v in enumerate(sorted(values), start=1)}


def test_dense_number_across_many_ranges(spark):
    rows = spark.range(0, 300_000).selectExpr("id * 7 as seq")
    bad = dense_number(rows, "seq", "n").filter("n != seq / 7 + 1").count()
    assert bad == 0


def test_allocated_ids_follow_the_highest(spark):
    old = spark.createDataFrame([(3,), (41,)], "id bigint")
    new = spark.createDataFrame([(9,), (2**40,), (-1,)], "seq bigint")
    ids = {r.seq: r.id for r in allocate_ids(new, "seq", old, "id").collect()}
    assert ids == {-1: 42, 9: 43, 2**40: 44}
    assert allocate_ids(new, "seq", old.limit(0), "id").selectExpr("min(id)").first()[0] == 1


@pytest.mark.parametrize("hours, bucket_rows", [(1, 10**6), (24 * 400, 10**6), (1, 20), (0, 20), (30, 15)])
def test_running_number_with_one_hot_key(spark, hours, bucket_rows):
    """A third of the rows belong to one key; ties and missing times occur."""
    pick = random.Random(hours)
    data = []
    for n in range(3000):
        key = "hot" if n % 3 == 0 else f"user{pick.randrange(40)}"
        when = None if pick.random() < 0.02 else START + timedelta(
            minutes=pick.randrange(60 * hours + 1), microseconds=pick.randrange(3) * 500_000
        )
        data.append((n * 70_000, key, when))
    pick.shuffle(data)
    rows = spark.createDataFrame(data, "id bigint, key string, at timestamp_ntz")
    numbered = {r.id: r.n for r in running_number(rows, "key", "at", ["id"], "n", bucket_rows).collect()}
    expected, seen = {}, {}
    for n, key, when in sorted(data, key=lambda r: (r[2] is not None, r[2] or START, r[0])):
        seen[key] = expected[n] = seen.get(key, 0) + 1
    assert numbered == expected


def test_skew_join_equals_join_across_types(spark):
    from wardops.operators.spread import left_spread, skew_join

    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (9, "e")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n"), (7, "u")], "k bigint, r string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, split = left.join(right, ["k"], how), skew_join(left, right, ["k"], how)
        assert sorted(map(tuple, split.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    plain, spread = left.join(right, ["k"], "left"), left_spread(left, right, ["k"])
    assert sorted(map(tuple, spread.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
