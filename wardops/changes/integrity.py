"""Which rows break the declared keys, references, domains and lengths."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wardops.functions import clock, text
from wardops.schemas import DOMAINS, FOREIGN_KEYS, KEYS, MAX_LENGTHS, UNIQUE
from wardops.tables import Tables

# Required texts and limits of entry forms.
REQUIRED = {
    "patients": ["full_name", "phone", "email"],
    "staff": ["full_name", "phone_number", "email"],
    "users": ["username", "password_hash"],
    "medical_records": ["symptoms", "diagnosis"],
}
OLDEST_BIRTH = date(1900, 1, 1)
MONEY_LIMIT = 100_000_000
MONEY_COLUMNS = {"medicines": ["price"], "invoices": ["total_amount", "net_amount"]}


def _row_rules(name: str, columns: list[str], as_of: datetime) -> list[tuple[str, str, Column]]:
    """(rule, column, is violated) for everything one row can show by itself."""
    rules = []
    for column, limit in MAX_LENGTHS[name].items():
        rules.append(("length", column, F.length(column) > limit))
    for (table, column), allowed in DOMAINS.items():
        if table == name:
            rules.append(("domain", column, ~F.col(column).isin(allowed)))
    for column in REQUIRED.get(name, []):
        rules.append(("required", column, ~text.filled(F.col(column))))
    for column in MONEY_COLUMNS.get(name, []):
        rules.append(("range", column, F.abs(F.col(column)) >= MONEY_LIMIT))
    if name == "insurance":
        rules.append(("range", "coverage_rate", ~F.col("coverage_rate").between(0, 1)))
    if name == "presc_details":
        rules.append(("range", "quantity", F.col("quantity") < 1))
    if name in ("patients", "staff"):
        outside = ~F.col("dob").between(F.lit(OLDEST_BIRTH), clock.day(as_of))
        rules.append(("range", "dob", outside))
    rules.append(("key", KEYS[name], F.col(KEYS[name]).isNull()))
    return [(rule, column, broken) for rule, column, broken in rules if column in columns]


Rule = tuple[str, str, str]  # table, rule, column


def _facts(t: Tables, name: str, as_of: datetime, number: dict[Rule, int]) -> DataFrame:
    """All that the rows of one table say, in one pass; ``number`` gains the rules met.

    A broken row rule says so itself (``broken``); a key or unique value is
    ``seen``; a reference is ``seen`` by the child and ``held`` by the parent.
    """
    columns = t[name].columns
    found = []

    def say(when: Column, rule: Rule, value: str, seen: int, held: int, broken: bool) -> None:
        fact = F.struct(
            F.lit(number.setdefault(rule, len(number))).alias("rule"), F.col(value).cast("string").alias("value"),
            F.lit(seen).alias("seen"), F.lit(held).alias("held"), F.lit(broken).alias("broken"),
        )
        found.append(F.when(when, fact))

    for rule, column, broken in _row_rules(name, columns, as_of):
        say(broken, (name, rule, column), column, 1, 0, True)
    key = KEYS[name]
    single = [("key", key)] + [("unique", column) for table, column in UNIQUE if table == name]
    for rule, column in single:
        if column in columns:
            say(F.col(column).isNotNull(), (name, rule, column), column, 1, 0, False)
    for child, column, parent in FOREIGN_KEYS:
        if child in t and parent in t and column in t[child].columns:
            rule = (child, "reference", column)
            if child == name:
                say(F.col(column).isNotNull(), rule, column, 1, 0, False)
            if parent == name and key in columns:
                say(F.col(key).isNotNull(), rule, key, 0, 1, False)
    return t[name].select(F.inline(F.filter(F.array(*found), lambda f: f.isNotNull())))


def violations(t: Tables, as_of: datetime) -> DataFrame:
    """(table_name, rule, column_name, value, rows_affected), one row per bad value.

    Every table is read once; all rules of all tables meet in one aggregation,
    which combines before the shuffle, so a value that fills a table is one row.
    """
    number: dict[Rule, int] = {}
    facts = reduce(DataFrame.unionByName, [_facts(t, name, as_of, number) for name in t])
    counts = facts.groupBy("rule", "value", "broken").agg(F.sum("seen").alias("n"), F.max("held").alias("held"))
    names = F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(column).alias("column_name"))
        for table, rule, column in number
    ])
    named = counts.withColumn("of", F.get(names, F.col("rule")))
    repeated = F.col("of.rule").isin("key", "unique") & (F.col("n") > 1)
    orphan = (F.col("of.rule") == "reference") & (F.col("held") == 0)
    return named.filter(F.col("broken") | repeated | orphan).select("of.*", "value", F.col("n").cast("bigint").alias("rows_affected"))
