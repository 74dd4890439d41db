"""What deletions carry along or run into, derived from the declared references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from wardops.operators.spread import skew_join
from wardops.schemas import FOREIGN_KEYS, KEYS
from wardops.tables import Tables


@dataclass
class Closure:
    """Keys that go with the rows asked for, per table, and the rows asked for that something still refers to.

    Frames have (root, the table's key); ``root`` is the key asked for.  Tables
    are in the order of deletion, children first.
    """

    goes: dict[str, DataFrame]
    blocked: DataFrame

    def keys(self, accepted: DataFrame) -> dict[str, DataFrame]:
        """Keys to delete per table, for the accepted roots only."""
        return {name: skew_join(rows, accepted, ["root"]).select(KEYS[name]).distinct() for name, rows in self.goes.items()}


def delete_closure(t: Tables, table: str, asked: DataFrame, cascades: set[str]) -> Closure:
    """Follow the references to ``table`` from the keys ``asked`` (one column ``root``).

    Rows of tables in ``cascades`` go along, with what refers to them in turn; a
    row of any other table blocks its root.  A restricting table is brought
    down to its distinct references first, so a key it is full of costs one row.
    """
    goes = {table: asked.select("root", F.col("root").alias(KEYS[table]))}
    blocked = asked.limit(0)
    todo = [table]
    while todo:
        parent = todo.pop(0)
        for child, column, to in FOREIGN_KEYS:
            if to != parent or child not in t or column not in t[child].columns:
                continue
            held = goes[parent].select("root", F.col(KEYS[parent]).alias(column))
            if child in cascades:
                rows = t[child].filter(F.col(column).isNotNull()).select(KEYS[child], column)
                along = skew_join(rows, held, [column]).select("root", KEYS[child])
                goes[child] = goes[child].unionByName(along) if child in goes else along
                todo.append(child)
            else:
                used = t[child].filter(F.col(column).isNotNull()).select(column).distinct()
                blocked = blocked.unionByName(held.join(used, column).select("root"))
    return Closure(dict(reversed(goes.items())), blocked.distinct())
