"""Money stays decimal from end to end."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def net_pay(gross: Column, rate: Column) -> Column:
    """What the patient pays after coverage, to the cent, half up."""
    uncovered = F.lit(1).cast("decimal(3,2)") - F.coalesce(rate, F.lit(0).cast("decimal(3,2)"))
    return (gross * uncovered).cast("decimal(15,2)")


def collected(net: Column, gross: Column) -> Column:
    """Amount collected: the stored net amount, gross for rows without one."""
    return F.coalesce(net, gross)


def collected_nonzero(net: Column, gross: Column) -> Column:
    """As ``collected``, but a stored net of 0.00 also falls back to gross."""
    zero = F.lit(0).cast("decimal(10,2)")
    return F.coalesce(F.nullif(net, zero), gross, zero)


def dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def percent(rate: Column) -> Column:
    return F.concat((rate * 100).cast("int").cast("string"), F.lit("%"))


def revenue(total: Column) -> Column:
    return total.cast("decimal(20,2)")
