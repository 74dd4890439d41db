"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are the bitwise majority of XXH64 shingle hashes.  Two fingerprints
link at ``RADIUS`` or fewer differing bits.  Of ``RADIUS + 2`` bit groups, two
linked fingerprints agree in at least two; every distinct fingerprint therefore
enters one cell per pair of groups.  A cell with more than ``CELL`` members is cut
again by pairs of groups of its remaining bits; for radius 2 a cell then shares 48
bits and cannot hold more than 2^16 distinct fingerprints, however many rows there
are.  No candidate is dropped on either way.

Inside a cell fingerprints are stored as 64 vertical bit planes.  One member is
compared with 64 others at a time: its difference to a plane is added to carry-save
counters that start so that they overflow at the first bit beyond the radius, and
blocks of 64 are abandoned once all of them have overflowed.  A cell gives the
edges of a spanning forest of its links, not all pairs; links are joined into
components by alternating star contraction, as Spark joins over the edges.

Defined cases: a null or empty text has fingerprint 0 and links like any other; a
text with fewer words than a shingle is one shingle; repeated rows share their
fingerprint and appear once each; rows with a null id get a component but never
name it (null if no member has an id); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .frames import discard, over_texts, staged, table, texts_of
from .tokens import LOWER, NOT_SPACE, split_words

SHINGLE = 3
RADIUS = 2
HASH_SEED = 42
#: Cells above this size are cut further.
CELL = 4096
#: Rows of whole cells compared at once, and (row, block of 64) pairs at once.
PACK = 1 << 16
PAIRS = 1 << 16


def shingle_spans(words, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by one space, the span of each shingle, and each text's first shingle."""
    n = np.diff(words.first)
    keep = NOT_SPACE[words.data]
    folded = LOWER[words.data]
    inner = np.ones(len(words.start), bool)
    inner[words.first[1:][n > 0] - 1] = False
    gaps = words.end[inner]
    keep[gaps] = True
    folded[gaps] = 0x20
    place = np.cumsum(keep)
    start, end = place[words.start] - 1, place[words.end - 1]
    shingles = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(shingles)))
    text = np.repeat(np.arange(len(n)), shingles)
    begin = words.first[:-1][text] + np.arange(first[-1]) - first[:-1][text]
    last = begin + np.minimum(size, n[text]) - 1
    return folded[keep].tobytes(), start[begin], end[last], first


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, the bits set in over half of its hashes (0 without any)."""
    counts = np.diff(first)
    bits = np.zeros((len(counts), 64), np.int64)
    # chunks of up to 255 hashes: eight bytewise counters fit one 64-bit word
    per = -(-counts // 255)
    text = np.repeat(np.arange(len(counts)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[:-1][text] + 255 * number
    end = np.minimum(begin + 255, first[1:][text])
    for at in range(0, len(begin), 1024):
        low, high = begin[at], end[min(at + 1024, len(begin)) - 1]
        spread = np.unpackbits(hashes[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(spread.view(np.uint64), begin[at : at + 1024] - low, axis=0)
        np.add.at(bits, text[at : at + 1024], sums.view(np.uint8).reshape(-1, 64))
    packed = np.packbits(bits * 2 > counts[:, None], axis=1, bitorder="little")
    return packed.reshape(-1).view(np.uint64)


def simhash(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    words = split_words(texts, NOT_SPACE)
    if not len(words.start):
        return np.zeros(len(texts), np.uint64)
    text, start, end, first = shingle_spans(words, size)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(text[a:b], HASH_SEED) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start)
    )
    return majority(hashes, first)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) of every document; ``text_key`` is the text's MD5."""
    narrow = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = simhash(texts_of(batch.column("text")), shingle).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "text_key", "fp"])

    schema = StructType([*narrow.schema.fields[:2], StructField("fp", LongType(), False)])
    return over_texts(narrow, schema, work)


def near_links(values: np.ndarray, cell: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values of the same cell with at most ``radius`` differing bits; cells are contiguous."""
    n = len(values)
    blocks = -(-n // 64)
    rows = np.zeros(blocks * 64, np.uint64)
    rows[:n] = values
    spread = np.unpackbits(rows.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(spread.T), axis=1, bitorder="little").view(np.uint64)
    borders = np.flatnonzero(np.concatenate((cell[1:] != cell[:-1], [True])))
    stop = borders[np.searchsorted(borders, np.arange(n))]  # last row of each row's cell
    mine = np.flatnonzero(stop > np.arange(n))
    reach = stop[mine] // 64 - mine // 64 + 1
    upto = np.cumsum(reach)
    ones = ~np.uint64(0)
    counters = (radius + 1).bit_length()
    begin = 0
    while begin < len(mine):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
        some, many = mine[begin:end], reach[begin:end]
        query = np.repeat(some, many)
        block = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many) + query // 64
        low = np.where(block == query // 64, query % 64 + 1, 0)
        high = np.where(block == stop[query] // 64, stop[query] % 64 + 1, 64)
        below = lambda k: np.where(k >= 64, ones, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
        alive = below(high) & ~below(low)
        own = values[query]
        spare = (1 << counters) - 1 - radius
        count = [np.full(len(query), ones if spare >> c & 1 else 0, np.uint64) for c in range(counters)]
        for bit in range(64):
            if bit % 4 == 0:
                live = alive != 0
                if not live.all():
                    query, block, alive, own = query[live], block[live], alive[live], own[live]
                    count = [c[live] for c in count]
                if not len(query):
                    break
            carry = planes[bit][block] ^ (np.uint64(0) - (own >> np.uint64(bit) & np.uint64(1)))
            for c in count:
                over = c & carry
                c ^= carry
                carry = over
            alive &= ~carry
        if len(query):
            at, bit = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield query[at], block[at] * 64 + bit
        begin = end


def forest(values: np.ndarray, cell: np.ndarray, radius: int) -> np.ndarray:
    """For each row the smallest row index it is linked to, through any chain in its cell."""
    label = np.arange(len(values))
    for a, b in near_links(values, cell, radius):
        while len(a):
            x, y = label[a], label[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(label, up := label[label]):
                label = up
    return label


def _groups(bits: list[int], count: int) -> list[list[int]]:
    return [list(part) for part in np.array_split(bits, count)]


def _key(fp: Column, bits: list[int]) -> Column:
    """The bits as a number; runs of neighbouring bits move together."""
    key, at, i = F.lit(0).cast("long"), 0, 0
    while i < len(bits):
        n = 1
        while i + n < len(bits) and bits[i + n] == bits[i] + n:
            n += 1
        run = F.shiftrightunsigned(fp, bits[i]).bitwiseAND(F.lit((1 << n) - 1).cast("long")) if n < 64 else fp
        key = key.bitwiseOR(F.shiftleft(run, at))
        at, i = at + n, i + n
    return key


def _pairs(fp: Column, bits: list[int], radius: int) -> list[tuple[Column, list[int]]]:
    """A key per pair of bit groups, and the bits it leaves free."""
    groups = _groups(bits, radius + 2)
    out = []
    for pair in combinations(range(radius + 2), 2):
        held = [b for g in pair for b in groups[g]]
        out.append((_key(fp, held), [b for b in bits if b not in held]))
    return out


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b), b < a as rows of a cell's forest, between distinct fingerprints ``fp``."""
    if not 0 <= radius <= 4:
        raise ValueError("radius must be from 0 to 4")
    fp = F.col("fp")
    first = _pairs(fp, list(range(64)), radius)
    cells = F.array(*[F.struct(F.lit(t).alias("t"), k.alias("k")) for t, (k, _) in enumerate(first)])
    keyed = distinct.select("fp", F.inline(cells))
    shared = staged(keyed.groupBy("t", "k").count().where("count > 1"), "simhash-cells")
    members = keyed.join(shared, ["t", "k"])
    wide = None
    for t, (_, free) in enumerate(first):
        finer = F.array(*[
            F.struct(F.lit(u).alias("u"), k.alias("v")) for u, (k, _) in enumerate(_pairs(fp, free, radius))
        ])
        wide = F.when(F.col("t") == t, finer) if wide is None else wide.when(F.col("t") == t, finer)
    plain = F.array(F.struct(F.lit(-1).alias("u"), F.lit(0).cast("long").alias("v")))
    placed = members.select("t", "k", "fp", F.inline(F.when(F.col("count") <= CELL, plain).otherwise(wide)))
    order = ["t", "k", "u", "v"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(columns: list[np.ndarray]) -> pa.RecordBatch:
            change = np.zeros(len(columns[0]), bool)
            for c in columns[:4]:
                change[1:] |= c[1:] != c[:-1]
            values = columns[4]
            label = forest(values.view(np.uint64), np.cumsum(change), radius)
            found = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(values[found]), pa.array(values[label[found]])], ["a", "b"])

        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([batch.column(n).to_numpy(zero_copy_only=False) for n in (*order, "fp")])
            size += batch.num_rows
            if size < PACK:
                continue
            columns = [np.concatenate(c) for c in zip(*held)]
            same = np.ones(size, bool)
            for c in columns[:4]:
                same &= c == c[-1]
            cut = int(np.argmax(same))  # the last cell may go on in the next batch
            if cut:
                yield edges([c[:cut] for c in columns])
            held, size = [[c[cut:] for c in columns]], size - cut
        if size:
            yield edges([np.concatenate(c) for c in zip(*held)])

    return placed.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")


def star_components(edges: DataFrame, purpose: str = "stars") -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node.

    Alternates large-star and small-star steps until nothing changes; each step is
    two aggregations and joins over the edges, staged in the shared folder.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), purpose
    )
    seen = state(now)
    while seen[0]:
        before, both = now, now.union(now.select("b", "a"))
        low = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), purpose)
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = staged(large.where("a <> b").distinct(), purpose)
        least = staged(down.groupBy("a").agg(F.min("b").alias("m")), purpose)
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = staged(small.union(least.select("a", F.col("m").alias("b"))).distinct(), purpose)
        discard(before, low, down, least)
        last, seen = seen, state(now)
        if seen == last:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select("b", "b").distinct())


def component_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, first): each distinct fingerprint and the first document of its component.

    ``first`` is a struct (no_id, doc_id, text_key); its smallest value wins.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    distinct = staged(prints.groupBy("fp").agg(first), "simhash-distinct")
    roots = staged(star_components(staged(links(distinct.select("fp"), radius), "simhash-links")), "simhash-roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, fp, first) of every document."""
    prints = staged(fingerprints(docs, shingle), "simhash-prints")
    return prints.join(staged(component_of(prints, radius), "simhash-components"), "fp")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The input's rows, one per component: the one with the smallest doc_id."""
    prints = staged(fingerprints(docs, shingle), "simhash-prints")
    kept = staged(component_of(prints, radius).select("first.*").distinct(), "simhash-kept")
    # One key of one kind for the join and for equal rows: every text is shuffled once.
    rows = docs.select(F.struct("*").alias("row"), _row_key(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"))
    keys = kept.select(_row_key(F.col("text_key")).alias("key"))
    return rows.join(keys.hint("merge"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def _row_key(text_key: Column) -> Column:
    return F.concat_ws(":", text_key, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id")
    )
