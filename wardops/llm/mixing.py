"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into ``BLOCKS`` permuted blocks by a hash of the row key, and
takes as many whole blocks (each at most twice) as fit its target; the first block
that does not fit is taken in part, by ``BLOCKS`` finer parts.  The numbers of
blocks drawn per source are split exactly among the output shards: a node of the
tree hands its left half a multivariate-hypergeometric draw of its blocks.  Every
shard then takes the next blocks of each source's permuted order, so shards are
disjoint, and orders its rows by a hash.

Any number of sources is mixed.  They are numbered in order of name and their
targets reshared by aggregates over one row a source; blocks are chosen on the
executors, a source a row.  The tree first splits the blocks of groups of ``GROUP``
sources, on the driver, then those of each group's sources, in one call a group.
Rows are placed by a join on (source, block): a broadcast one, which shuffles no
row, up to ``PLAN_ROWS`` rows of the plan, else a shuffled one whose hot keys adaptive
execution splits.  Everything depends on keys and ``seed`` alone, so reruns agree.

``op10`` returns, besides the words taken, the shard and the place in the shard's
shuffled order of every taken copy, as two arrays a document.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; a null id is replaced by the text's MD5; repeated rows of one id share a
block and are taken alike; an empty table gives an empty result; rows without
words are taken with their block and count 0 words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .frames import staged, table
from .sharding import hash60

BLOCK_BITS = 8
BLOCKS = 1 << BLOCK_BITS
GROUP = 4096
PLAN_ROWS = 1 << 17
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SHARDS = 16
SEED = 7


def word_count(text: Column) -> Column:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Each source's words: ``share`` of all by weight, at most ``cap`` times its size, the excess reshared."""
    left, found = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes))]
    while open_:
        per_weight = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if per_weight * weights[i] > cap * sizes[i]]
        if not above:
            for i in open_:
                found[i] = per_weight * weights[i]
            break
        for i in above:
            found[i] = cap * sizes[i]
            left -= found[i]
        open_ = [i for i in open_ if i not in above]
    return found


def split_quotas(
    drawn: Sequence[int], shards: int, seed: int = SEED, of: Sequence[int] = (0,), wanted: np.ndarray | None = None
) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources); columns add up to ``drawn``, rows to ``wanted`` if given.

    ``of`` tells draws over different groups of sources apart.
    """
    out = np.zeros((shards, len(drawn)), np.int64)

    def node(low: int, high: int, counts: np.ndarray) -> None:
        if high - low == 1:
            out[low] = counts
            return
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high, *of])
        total = int(counts.sum())
        share = total * (middle - low) // (high - low) if wanted is None else int(wanted[low:middle].sum())
        if not share:
            left = np.zeros_like(counts)
        elif total < 10**9:
            left = rng.multivariate_hypergeometric(counts, share, method="marginals")
        else:  # more than numpy draws from: in proportion, which at such totals differs little
            upto = [int(c) * share // total for c in np.cumsum(counts)]
            left = np.diff(upto, prepend=0)
        node(low, middle, left)
        node(middle, high, counts - left)

    if len(drawn):
        node(0, shards, np.asarray(drawn, np.int64))
    return out


def block_order(source: int, turn: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, source, turn]).permutation(BLOCKS)


def choose_blocks(sizes: np.ndarray, target: float, source: int, seed: int = SEED):
    """Whole (turn, block) draws that fit the target, the words left, and the (turn, block) to take in part."""
    left, drawn, partial = float(target), [], None
    for turn in range(int(CAP)):
        if left <= 0:
            break
        for block in block_order(source, turn, seed).tolist():
            if sizes[block] <= left + 1e-6:
                drawn.append((turn, block))
                left -= sizes[block]
            elif partial is None:
                partial = (turn, block)
        if partial:
            break
    return drawn, max(left, 0.0), partial


def choose_parts(sizes: dict[int, int], left: float) -> list[int]:
    """Parts of a block that bring it nearest to the words left."""
    chosen = []
    for part in sorted(sizes):
        if sizes[part] <= left:
            chosen.append(part)
            left -= sizes[part]
    rest = [p for p in sorted(sizes) if p not in chosen]
    if rest and abs(left - sizes[best := min(rest, key=lambda p: (sizes[p], p))]) < left:
        chosen.append(best)
    return sorted(chosen)


def _block(key: Column, seed: int) -> tuple[Column, Column]:
    hashed = hash60(F.concat(F.lit(f"{seed}|"), key))
    block = F.shiftright(hashed, 60 - BLOCK_BITS).cast("int")
    return block, (F.shiftright(hashed, 60 - 2 * BLOCK_BITS) % BLOCKS).cast("int")


def numbered(totals: DataFrame) -> DataFrame:
    """``totals`` (source, source_size) with each source's number in order of name, null last; no task sorts them all."""
    last = F.col("source").isNull()
    ranges = totals.repartitionByRange(last, F.col("source")).withColumn("range", F.spark_partition_id())
    ranges = staged(ranges, "mix-sources")
    before, offsets = 0, {}
    for r in ranges.groupBy("range").count().orderBy("range").collect():
        offsets[r["range"]] = before
        before += r["count"]
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for p in offsets.items() for x in p]), F.col("range").cast("long")) if offsets else F.lit(0)
    within = F.row_number().over(Window.partitionBy("range").orderBy(last, "source"))
    return ranges.select("source", "source_size", (offset + within - 1).cast("long").alias("number"))


def with_targets(sources: DataFrame, weights: Sequence[float], share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``targets`` over one row a source: the level per weight rises until no further source is above its cap."""
    kind = F.pmod("number", F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), kind + 1)
    most = F.lit(float(cap)) * F.col("source_size")
    words, level, closed = sources.agg(F.sum("source_size")).first()[0] or 0, None, -1
    while True:
        above = F.lit(False) if level is None else F.lit(level) * weight > most
        rows = sources.groupBy(kind.alias("kind")).agg(
            F.count_if(above).alias("closed"), F.count_if(~above).alias("open"),
            F.sum(F.when(above, F.col("source_size")).otherwise(0)).alias("taken"),
        ).orderBy("kind").collect()
        now = sum(r["closed"] for r in rows)
        if now == closed:
            break
        closed, open_ = now, sum(weights[r["kind"]] * r["open"] for r in rows)
        if not open_:
            break
        level = (share * words - cap * sum(r["taken"] for r in rows)) / open_
    fit = F.lit(level) * weight if level is not None else most
    return sources.withColumn("target", F.least(fit, most) if rows and open_ else most)


UNIT = pa.struct([("turn", pa.int32()), ("block", pa.int32()), ("parts", pa.list_(pa.int32()))])
PLACE = pa.struct([("turn", pa.int32()), ("shard", pa.int32()), ("parts", pa.list_(pa.int32()))])
UNIT_SQL = "array<struct<turn:int,block:int,parts:array<int>>>"
PLACE_SQL = "array<struct<turn:int,shard:int,parts:array<int>>>"


def mix_plan(sums: DataFrame, weights: Sequence[float], shards: int, seed: int) -> DataFrame:
    """One row per (source, block): the source's size and target, and its placements.

    ``sums`` holds (source, block, part, size); a placement is a turn, a shard and
    the parts taken (none listed: all).
    """
    blocks = staged(sums.groupBy("source", "block").agg(F.sum("size").alias("size")), "mix-blocks")
    sources = staged(numbered(blocks.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-numbers")
    sources = with_targets(sources, weights)
    sizes = blocks.groupBy("source").agg(F.collect_list(F.struct("block", "size")).alias("sizes"))
    per_source = sources.alias("s").join(sizes.alias("z"), F.expr("s.source <=> z.source")).select("s.*", "sizes")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for number, target, pairs in zip(*(batch.column(c).to_pylist() for c in ("number", "target", "sizes"))):
                own = np.zeros(BLOCKS, np.int64)
                for pair in pairs:
                    own[pair["block"]] = pair["size"]
                drawn, left, partial = choose_blocks(own, target, number, seed)
                units = [{"turn": turn, "block": block, "parts": []} for turn, block in drawn]
                found.append((units, left, *(partial or (None, None)), [pair["block"] for pair in pairs]))
            kinds = (pa.list_(UNIT), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            kept = [batch.column(c) for c in ("source", "number", "source_size", "target")]
            yield pa.RecordBatch.from_arrays(
                kept + columns, ["source", "number", "source_size", "target", "units", "left", "cut_turn", "cut_block", "blocks"]
            )

    head = "source string, number long, source_size long, target double"
    chosen = staged(
        per_source.mapInArrow(choose, f"{head}, units {UNIT_SQL}, left double, cut_turn int, cut_block int, blocks array<int>"), "mix-chosen"
    )
    edges = chosen.where("cut_block IS NOT NULL").select("source", "number", "cut_block")
    inside = sums.alias("s").join(edges.alias("e"), F.expr("s.source <=> e.source AND s.block = e.cut_block"))
    parts = inside.groupBy("number").agg(F.collect_list(F.struct("part", "size")).alias("sizes"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("units").to_pylist()
            names = ("left", "cut_turn", "cut_block", "sizes")
            for own, left, turn, block, pairs in zip(units, *(batch.column(c).to_pylist() for c in names)):
                if pairs and (some := choose_parts({pair["part"]: pair["size"] for pair in pairs}, left)):
                    own.append({"turn": turn, "block": block, "parts": some})
            kept = [batch.column(c) for c in ("source", "number", "source_size", "target", "blocks")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(units, pa.list_(UNIT))], ["source", "number", "source_size", "target", "blocks", "units"]
            )

    units = staged(
        chosen.join(parts, "number", "left").mapInArrow(cut, f"{head}, blocks array<int>, units {UNIT_SQL}"), "mix-units"
    )
    counts = units.select(F.expr(f"number div {GROUP}").alias("grp"), "number", F.size("units").alias("drawn"))
    groups = counts.groupBy("grp").agg(F.sum("drawn").alias("drawn")).orderBy("grp").collect()
    split = split_quotas([g.drawn for g in groups], shards, seed, (0, 1))
    wanted = {g.grp: split[:, i].tolist() for i, g in enumerate(groups)}

    def share_out(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("number")
        group = rows.column("grp")[0].as_py()
        quotas = split_quotas(rows.column("drawn").to_pylist(), shards, seed, (group,), np.array(wanted[group]))
        return pa.table({"number": rows.column("number"), "quota": pa.array(quotas.T.tolist(), pa.list_(pa.int32()))})

    quotas = counts.groupBy("grp").applyInArrow(share_out, "number long, quota array<int>")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, block_of, placed_of = [], [], []
            for i, (blocks_, units_, quota) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("blocks", "units", "quota")))):
                placed: dict[int, list] = {}
                for unit, shard in zip(units_, np.repeat(np.arange(shards), quota).tolist(), strict=True):
                    placed.setdefault(unit["block"], []).append({"turn": unit["turn"], "shard": shard, "parts": unit["parts"]})
                at += [i] * len(blocks_)
                block_of += blocks_
                placed_of += [placed.get(b, []) for b in blocks_]
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("source", "source_size", "target")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(block_of, pa.int32()), pa.array(placed_of, pa.list_(PLACE))],
                ["source", "source_size", "target", "block", "placed"],
            )

    kind = f"source string, source_size long, target double, block int, placed {PLACE_SQL}"
    return staged(units.join(quotas, "number").mapInArrow(place, kind), "mix-plan")


def with_placements(
    rows: DataFrame, size: Column, key: Column, weights: Sequence[float] = WEIGHTS, shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """``row`` (the whole input row), ``size``, ``source_size``, ``target`` and ``placements`` (turn, shard)."""
    block, part = _block(key, seed)
    sized = rows.select(
        F.struct("*").alias("row"), F.col("source").cast("string").alias("source"),
        size.alias("size"), key.alias("key"), block.alias("block"), part.alias("part"),
    )
    sums = staged(sized.groupBy("source", "block", "part").agg(F.sum("size").alias("size")), "mix-sums")
    plan = mix_plan(sums, weights, shards, seed)
    small = plan.limit(PLAN_ROWS + 1).count() <= PLAN_ROWS
    plan = F.broadcast(plan) if small else plan.hint("merge")
    joined = sized.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source AND d.block = p.block"))
    taken = F.filter("placed", lambda p: (F.size(p["parts"]) == 0) | F.array_contains(p["parts"], F.col("part")))
    return joined.select(
        "row", "key", "size", "source_size", "target",
        F.transform(taken, lambda p: F.struct(p["turn"].alias("turn"), p["shard"].alias("shard"))).alias("placements"),
    )


def row_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _place(key: Column, turn: Column) -> Column:
    """A copy's place in the shuffled order of its shard."""
    return hash60(F.concat_ws("|", F.lit("place"), key, turn.cast("string")))


def mixed(rows: DataFrame, **options) -> DataFrame:
    """One row per taken copy: the input's columns, its shard and its place in the shard."""
    placed = with_placements(rows, word_count(F.col("text")), row_key(), **options)
    copies = placed.select("row", "key", F.explode("placements").alias("at"))
    place = _place(F.col("key"), F.col("at.turn"))
    return copies.select("row.*", F.col("at.shard").alias("mix_shard"), place.alias("mix_place"))


def write_mix(rows: DataFrame, path: str, **options) -> None:
    """A folder per shard; every file is in shuffled order.  No rows are exchanged between tasks."""
    mixed(rows, **options).sortWithinPartitions("mix_shard", "mix_place").write.partitionBy("mix_shard").parquet(path)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = staged(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("n_words"), row_key().alias("row_key")), "mix-sizes"
    )
    placed = with_placements(sizes, F.col("n_words"), F.col("row_key"))
    return placed.select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.size("placements")).cast("long").alias("taken"),
        F.col("placements.shard").alias("shards"),
        F.transform("placements", lambda p: _place(F.col("key"), p["turn"])).alias("places"),
    )
