"""Permutation-filled lookup table: constant-time, balanced and stable shard placement.

Every shard has its own preference order over the slots of a prime-sized table
(``(offset + j * skip) mod slots``).  The shards take turns; in its turn a shard
claims the first slot of its order that is free.  A key's slot is a hash of the
key modulo the table's size.  When a shard is lost, almost only its own keys move.

The table is configuration: its size is a parameter, never a count of the data,
so the broadcast is bounded by ``MAX_SLOTS`` rows.  Keys are placed by built-in
functions and one broadcast hash join, without a shuffle, so hot keys cost nothing.

Defined cases: a null key is placed like the key '' ; repeated rows of a key go to
one shard; an empty table gives an empty result.  Existing columns named like an
output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import table

SLOTS = 2039
MAX_SLOTS = 1 << 20
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def hash60(text: Column) -> Column:
    """The first 60 bits of a text's MD5 as a non-negative long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _hash60(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard number of every slot.  Bounded by its parameters; reads no data."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not len(shards) <= slots <= MAX_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    place = [_hash60(f"{name}|offset") % slots for name in shards]
    skip = [_hash60(f"{name}|skip") % (slots - 1) + 1 for name in shards]
    owner = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        while owner[place[shard]] >= 0:
            place[shard] = (place[shard] + skip[shard]) % slots
        owner[place[shard]] = shard
    return owner


def slot_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard)."""
    owners = ",".join(map(str, lookup_table(shards, slots)))
    names = F.array(*map(F.lit, shards))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "at")).select(
        "slot", F.element_at(names, F.col("at").cast("int") + 1).alias("shard")
    )


def assign_shards(
    rows: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """``rows`` with columns ``slot`` (int) and ``shard`` (string)."""
    placed = rows.drop("slot", "shard").withColumn(
        "slot", (hash60(F.coalesce(F.col(key).cast("string"), F.lit(""))) % slots).cast("int")
    )
    return placed.join(F.broadcast(slot_frame(rows.sparkSession, shards, slots)), "slot")


def write_shards(rows: DataFrame, path: str, **options) -> None:
    """Write every row to the folder of its shard; tasks write what they hold, so nothing is shuffled."""
    assign_shards(rows, **options).write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document, and its shard if the first shard were lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    survivors = slot_frame(spark, SHARDS[1:]).withColumnRenamed("shard", "shard_after_loss")
    return assign_shards(docs).join(F.broadcast(survivors), "slot").select("doc_id", "slot", "shard", "shard_after_loss")


def _filled(name: str, shards: Sequence[str]) -> str:
    """SQL steps that fill a table turn by turn; ``{name}(slot, shard)`` holds the result."""
    values = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    start, skip = (f"('0x' || md5(shard || '|{part}')[1:15])::BIGINT" for part in ("offset", "skip"))
    return f"""
    {name}_order AS (
      SELECT i, list(slot ORDER BY j) AS wishes FROM (
        SELECT i, j, (({start}) % {SLOTS} + j * (({skip}) % {SLOTS - 1} + 1)) % {SLOTS} AS slot
        FROM (VALUES {values}) AS s(i, shard), range({SLOTS}) AS r(j)) GROUP BY i),
    {name}_turns(turn, slot, taken) AS (
      SELECT 0, wishes[1], [wishes[1]] FROM {name}_order WHERE i = 0
      UNION ALL
      SELECT turn + 1, free, list_append(taken, free) FROM (
        SELECT t.turn, t.taken, list_filter(o.wishes, lambda w: NOT list_contains(t.taken, w))[1] AS free
        FROM {name}_turns t JOIN {name}_order o ON o.i = (t.turn + 1) % {len(shards)}
        WHERE t.turn + 1 < {SLOTS})),
    {name} AS (
      SELECT slot, shard FROM {name}_turns JOIN (VALUES {values}) AS s(i, shard) ON i = turn % {len(shards)})"""


def op2_sql() -> str:
    return f"""
    WITH RECURSIVE {_filled("full_table", SHARDS)}, {_filled("less_table", SHARDS[1:])},
    keyed AS (SELECT doc_id, (('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT % {SLOTS})::INT AS slot FROM documents)
    SELECT k.doc_id, k.slot, f.shard, l.shard AS shard_after_loss
    FROM keyed k JOIN full_table f USING (slot) JOIN less_table l USING (slot)"""
