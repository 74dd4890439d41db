"""Joins that adaptive execution can split when one key holds much of a side.

Two shapes defeat its skew handling.  ``skew_join`` is for a right side that is
itself grouped or joined on the same key: no shuffle lies between, and a join
is only split if both inputs come straight out of one.  ``left_spread`` is for
a left join whose *right* side has the hot key: only the preserved side of an
outer join may be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left JOIN right USING (on)`` with the left side splittable.

    A second key that follows from the first asks for a shuffle of the (already
    small) right side, after which a hot left partition can be cut up.
    """
    follows = F.hash(*[F.col(c).cast("string") for c in on])
    return (
        left.withColumn("_follows", follows)
        .join(right.withColumn("_follows", follows), [*on, "_follows"], how)
        .drop("_follows")
    )


def left_spread(
    left: DataFrame, right: DataFrame, on: list[str], right_keys: DataFrame | None = None
) -> DataFrame:
    """``left LEFT JOIN right USING (on)`` with the right side splittable.

    Matched rows come from an inner join, which may be split on either side,
    unmatched ones from an anti join against the distinct right keys.
    ``right_keys`` may name a cheaper source of the right side's keys than the
    right side itself.
    """
    keys = (right if right_keys is None else right_keys).select(*on).distinct()
    matched = right.join(left, on)
    unmatched = left.join(keys, on, "left_anti")
    missing = [
        F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name not in on
    ]
    columns = [*left.columns, *[c for c in right.columns if c not in on]]
    return matched.select(*columns).unionByName(unmatched.select(*left.columns, *missing))
