"""``key NOT IN (subquery)`` with SQL's NULL rule, without a forced broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def not_in(rows: DataFrame, key: str, excluded: DataFrame) -> DataFrame:
    """Rows whose ``key`` is not among ``excluded[key]``.

    Spark runs ``NOT IN`` by broadcasting the whole subquery whatever its size.
    An ordinary anti join on the distinct non-NULL keys gives the same rows and
    lets the optimizer choose the strategy; one scalar adds the NULL rule: a
    single NULL among the excluded keys empties the result.  A NULL ``key``
    itself survives only an empty exclusion list.
    """
    keys = excluded.select(key)
    known = keys.filter(F.col(key).isNotNull()).distinct()
    listed, non_null = F.count("*"), F.count(key)
    state = keys.agg(
        F.when(listed == 0, "empty").when(non_null < listed, "has null").otherwise("known")
    ).scalar()
    comparable = (state == "empty") | ((state == "known") & F.col(key).isNotNull())
    return rows.filter(comparable).join(known, key, "left_anti")
