"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

``LineIndex`` keeps three tables in the shared folder: the postings (which document
holds which line key), the exact reference counts per key, and one cuckoo filter
per shard with the fingerprints of the keys that are repeated just now.  Inserting
documents raises counts, deleting them lowers counts; keys that cross the limit
enter or leave the filter of their shard, other keys move nothing.  A shard's update
is one task; with more than ``shard_keys`` repeated keys a shard the number of shards
doubles and their filters are made anew from the exact counts, so a task's share does
not grow with the corpus.

When lines are looked up, a key probes the filters of its own shard and no other, so
false hits do not grow with the shards; the filters have no false negatives, and what
they let through meets the exact counts in a join.  While they take ``FILTER_BYTES``
together they are sent to every task and reject most lines inside the scan; beyond
that the lines are shuffled to their shard's filters and rejected there.  Counts are
combined before they are shuffled, hot keys are joined with adaptive skew handling.

A key is a line without the white space at its ends, A-Z lower-cased; keys of
fewer than ``MIN_CHARS`` code points are left alone.  A key is identified by its
128-bit MD5.  A repeated key stays only in the largest id that holds it.

Defined cases: null and empty texts are one empty line; documents without an id
are returned whole and count for nothing; rows that share an id are one document
for counting and are cleaned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import slices, staged, table, texts_of
from .tokens import mix

MIN_DOCS = 3
MIN_CHARS = 20
SHARDS = 64
#: Repeated keys a shard, on average, beyond which the shards are doubled.
SHARD_KEYS = 1 << 18
FILTER_BYTES = 64 << 20
#: Parts a shard's postings are looked up in when filters are not sent everywhere.
SPREAD = 16
SLOTS = 4
_STRIP = " \t\n\x0b\x0c\r"


class CuckooFilter:
    """16-bit fingerprints in buckets of four; supports deletion of what was inserted."""

    def __init__(self, table: np.ndarray):
        self.table = table  # buckets x SLOTS, 0: free

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 16
        while buckets * SLOTS * 0.8 < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (hashes >> np.uint64(48)).astype(np.uint16)
        return np.maximum(prints, 1), (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, bucket = self._places(hashes)
        other = self._other(prints, bucket)
        return ((self.table[bucket] == prints[:, None]) | (self.table[other] == prints[:, None])).any(axis=1)

    def insert(self, hashes: np.ndarray, tries: int = 200) -> bool:
        """Add all; False, and nothing changed, if there is no room."""
        before = self.table.copy()
        prints, bucket = self._places(hashes)
        rng = np.random.default_rng(5)
        for turn in range(tries):
            if not len(prints):
                return True
            order = np.argsort(bucket, kind="stable")
            prints, bucket = prints[order], bucket[order]
            first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            rank = np.arange(len(bucket)) - np.maximum.accumulate(np.where(first, np.arange(len(bucket)), 0))
            taken = self.table[bucket] != 0
            fits = rank < SLOTS - taken.sum(axis=1)
            slot = np.argsort(taken, axis=1, kind="stable")[np.arange(len(bucket)), np.minimum(rank, SLOTS - 1)]
            self.table[bucket[fits], slot[fits]] = prints[fits]
            prints, bucket = prints[~fits], bucket[~fits]
            if turn and len(prints):  # push one occupant per bucket out
                _, one = np.unique(bucket, return_index=True)
                at = rng.integers(0, SLOTS, len(one))
                out = self.table[bucket[one], at].copy()
                self.table[bucket[one], at] = prints[one]
                prints[one] = out
                bucket[one] = self._other(out, bucket[one])
            else:
                bucket = self._other(prints, bucket)
        self.table = before
        return False

    def delete(self, hashes: np.ndarray) -> np.ndarray:
        """Remove one entry per hash; says which were there."""
        prints, bucket = self._places(hashes)
        found = np.zeros(len(hashes), bool)
        for place in (bucket, self._other(prints, bucket)):
            left = np.flatnonzero(~found)
            while len(left):
                match = self.table[place[left]] == prints[left][:, None]
                has = match.any(axis=1)
                left, slot = left[has], match[has].argmax(axis=1)
                _, one = np.unique(place[left], return_index=True)
                self.table[place[left[one]], slot[one]] = 0
                found[left[one]] = True
                left = np.delete(left, one)
        return found


def _hash_of(keys: list[bytes]) -> np.ndarray:
    return mix(np.frombuffer(b"".join(keys), np.uint64)[::2].copy()) if keys else np.zeros(0, np.uint64)


def line_keys(text: str, least: int) -> list[bytes | None]:
    """The key of every line; None where a line is too short to count."""
    stripped = (line.strip(_STRIP) for line in text.split("\n"))
    return [hashlib.md5(s.encode().lower()).digest() if len(s) >= least else None for s in stripped]


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key: the last four bytes of its MD5, which the fingerprints in the filters do not use."""
    return F.pmod(F.conv(F.hex(F.substring(key, 13, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def shards_of(keys: list[bytes], shards: int) -> np.ndarray:
    """The same inside a task."""
    return np.frombuffer(b"".join(keys), ">u4")[3::4].astype(np.int64) % shards if keys else np.zeros(0, np.int64)


def _filters(bits: list[bytes]) -> list[CuckooFilter]:
    return [CuckooFilter(np.frombuffer(b, np.uint16).reshape(-1, SLOTS)) for b in bits]


def _maybe(filters: list[CuckooFilter], keys: list[bytes]) -> np.ndarray:
    hashes = _hash_of(keys)
    found = np.zeros(len(keys), bool)
    for f in filters:
        found |= f.contains(hashes)
    return found


def postings(docs: DataFrame, least: int, sent=None, shards: int = SHARDS) -> DataFrame:
    """(key, doc) of every document's counted lines; with filters, only those their shard's filters may hold."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {shard: _filters(bits) for shard, bits in sent.value.items()} if sent else None
        for batch in slices(batches):
            keys, owner = [], []
            for doc, text in zip(batch.column("doc").to_pylist(), texts_of(batch.column("text")).to_pylist()):
                own = {k for k in line_keys(text, least) if k}
                keys += own
                owner += [doc] * len(own)
            if filters is not None:
                maybe = np.zeros(len(keys), bool)
                own = shards_of(keys, shards)
                order = np.argsort(own, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                    if len(part) and int(own[part[0]]) in filters:
                        maybe[part] = _maybe(filters[int(own[part[0]])], [keys[i] for i in part.tolist()])
                keys = [k for k, m in zip(keys, maybe.tolist()) if m]
                owner = [d for d, m in zip(owner, maybe.tolist()) if m]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owner, pa.int64())], ["key", "doc"])

    return rows.mapInArrow(find, "key binary, doc long")


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))


def _update(key: tuple, old: pa.Table, changes: pa.Table) -> pa.Table:
    """The filters of one shard after keys have entered (+1) or left (-1)."""
    filters = [CuckooFilter(np.frombuffer(b, np.uint16).reshape(-1, SLOTS).copy()) for b in old.column("bits").to_pylist()]
    keys, signs = changes.column("key").to_pylist(), changes.column("sign").to_numpy()
    hashes = _hash_of(keys)
    leaving = hashes[signs < 0]
    for f in filters:
        leaving = leaving[~f.delete(leaving)]
    entering = hashes[signs > 0]
    if len(entering) and not (filters and filters[-1].insert(entering)):
        room = 2 * len(entering) + 64
        while not (more := CuckooFilter.sized(room)).insert(entering):
            room *= 2
        filters.append(more)
    filters = [f for f in filters if f.table.any()]
    return pa.table({
        "shard": pa.array([key[0].as_py()] * len(filters), pa.int32()),
        "bits": pa.array([f.table.tobytes() for f in filters], pa.binary()),
    })


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame  # key, doc
    refs: DataFrame  # key, n_docs, last_doc
    filters: DataFrame  # shard, bits
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS
    shards: int = SHARDS
    shard_keys: int = SHARD_KEYS

    @classmethod
    def empty(cls, spark: SparkSession, **options) -> LineIndex:
        none = lambda schema: spark.createDataFrame([], schema)
        return cls(none("key binary, doc long"), none("key binary, n_docs long, last_doc long"), none("shard int, bits binary"), **options)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the documents' lines added; lines already known for a document count once."""
        found = postings(docs, self.min_chars).distinct()
        added = staged(found.join(self.postings, ["key", "doc"], "left_anti"), "lines-added")
        more = counted(added).withColumnsRenamed({"n_docs": "m", "last_doc": "l"})
        zero = F.lit(0).cast("long")
        merged = self.refs.join(more, "key", "full").select(
            "key", F.coalesce("n_docs", zero).alias("old_n"),
            (F.coalesce("n_docs", zero) + F.coalesce("m", zero)).alias("n_docs"), F.greatest("last_doc", "l").alias("last_doc"),
        )
        return self._moved(self.postings.union(added), merged)

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index as if the documents with these ids had never been inserted."""
        ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc")).distinct()
        gone = staged(self.postings.join(ids, "doc", "left_semi").select("key").distinct(), "lines-gone")
        rest = staged(self.postings.join(ids, "doc", "left_anti").select("key", "doc"), "lines-rest")
        again = counted(rest.join(gone, "key", "left_semi")).withColumnsRenamed({"n_docs": "m", "last_doc": "l"})
        zero = F.lit(0).cast("long")
        touched = self.refs.join(gone, "key", "left_semi").join(again, "key", "left")
        same = self.refs.join(gone, "key", "left_anti").select("key", F.col("n_docs").alias("old_n"), "n_docs", "last_doc")
        merged = touched.select("key", F.col("n_docs").alias("old_n"), F.coalesce("m", zero).alias("n_docs"), F.col("l").alias("last_doc"))
        return self._moved(rest, same.union(merged))

    def _moved(self, rows: DataFrame, merged: DataFrame) -> LineIndex:
        merged = staged(merged, "lines-refs")
        before, after = F.col("old_n") >= self.min_docs, F.col("n_docs") >= self.min_docs
        shards, repeated = self.shards, merged.where(after).count()
        while repeated > shards * self.shard_keys:
            shards *= 2
        grown = shards > self.shards  # keys change shards: fill new filters
        old = self.filters.where("false") if grown else self.filters
        changes = merged.where(after if grown else before != after).select(
            shard_of(F.col("key"), shards).alias("shard"), "key", F.when(after, 1).otherwise(-1).alias("sign")
        )
        filters = old.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_update, "shard int, bits binary")
        return replace(
            self, postings=rows, refs=merged.where("n_docs > 0").select("key", "n_docs", "last_doc"),
            filters=staged(filters, "lines-filters"), shards=shards,
        )

    def _probed(self, found: DataFrame) -> DataFrame:
        """The postings that the filters of their shard may hold, where filters are too large to be sent everywhere.

        Postings meet their shard's filters in parts of a bounded number of keys' hashes
        (``SPREAD`` parts a shard), so that no task holds a hot shard; the filters are copied
        to those parts, and rows stream past them in slices.
        """
        part = F.pmod(F.xxhash64("key", "doc"), F.lit(SPREAD)).cast("int")
        rows = found.select(shard_of(F.col("key"), self.shards).alias("shard"), part.alias("part"), "key", "doc")
        none = F.lit(None)
        bits = self.filters.select(
            "shard", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"), none.cast("binary").alias("key"),
            none.cast("long").alias("doc"), "bits",
        )
        both = rows.withColumn("bits", none.cast("binary")).unionByName(bits)
        ordered = both.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("bits").isNull())

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, filters = None, []
            for batch in batches:
                shard, part = (batch.column(c).to_numpy() for c in ("shard", "part"))
                cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
                    if lo == hi:
                        continue
                    if (shard[lo], part[lo]) != place:
                        place, filters = (shard[lo], part[lo]), []
                    run = batch.slice(lo, hi - lo)
                    filters += _filters([b for b in run.column("bits").to_pylist() if b is not None])
                    run = run.filter(run.column("key").is_valid())
                    if filters and run.num_rows:
                        kept = run.filter(pa.array(_maybe(filters, run.column("key").to_pylist())))
                        yield kept.select(["key", "doc"])

        return ordered.mapInArrow(probe, "key binary, doc long")

    def removals(self, docs: DataFrame) -> DataFrame:
        """(doc, keys): the line keys that each of the documents loses."""
        size = self.filters.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
        if size <= FILTER_BYTES:
            held = defaultdict(list)
            for r in self.filters.collect():
                held[r.shard].append(r.bits)
            found = postings(docs, self.min_chars, docs.sparkSession.sparkContext.broadcast(dict(held)), self.shards)
        else:
            found = self._probed(postings(docs, self.min_chars))
        repeated = self.refs.where(F.col("n_docs") >= self.min_docs).select("key", "last_doc")
        lost = found.join(repeated, "key").where("doc <> last_doc")
        return lost.groupBy("doc").agg(F.collect_set("key").alias("keys"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept): every text without its repeated lines."""
        rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("doc"), "text")
        joined = rows.join(self.removals(docs), "doc", "left").select("doc_id", "text", "keys")
        kind, least = joined.schema["doc_id"].dataType.simpleString(), self.min_chars

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                n_lines, n_dropped, kept = [], [], []
                for text, keys in zip(texts_of(batch.column("text")).to_pylist(), batch.column("keys").to_pylist()):
                    lines = text.split("\n")
                    stay = lines
                    if keys:
                        lost = set(keys)
                        stay = [line for line, key in zip(lines, line_keys(text, least)) if key not in lost]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                    kept.append("\n".join(stay))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_lines", "n_dropped", "kept"],
                )

        return joined.mapInArrow(cut, f"doc_id {kind}, n_lines long, n_dropped long, kept string")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = LineIndex.empty(spark).insert(docs).clean(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_sql() -> str:
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    keyed AS (
      SELECT r, doc_id, i, l[i] AS line, translate(trim(l[i], {white}), '{capital}', '{small}') AS key
      FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs)),
    repeated AS (
      SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= {MIN_CHARS} AND doc_id IS NOT NULL
      GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
    judged AS (
      SELECT k.*, coalesce(k.doc_id <> p.last_doc, false) AS lost FROM keyed k LEFT JOIN repeated p ON p.key = k.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
    FROM judged GROUP BY r, doc_id"""
