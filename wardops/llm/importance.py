"""Target-distribution importance resampling over hashed word n-grams.

A document is drawn in proportion to how much likelier its n-grams are in a target
corpus than in the corpus itself (Gumbel noise turns the draw without replacement into
a top-k).

Method.  A text is lower-cased (A-Z only), its separators are collapsed to single
spaces, and ``regex.finditer(..., overlapped=True)`` finds at every word start, between
boundary lookarounds, the span of the longest n-gram there; the n-grams that begin at the
same word end where the next words end.  CRC-32 runs over these spans, all spans of a slice side by side, and continues
from an n-gram to the next longer one.  Texts of a slice are set apart by two spaces,
which no n-gram crosses.

Two passes: the first scans each text once and writes its bucket numbers, two bytes a
feature, to the shared folder; bucket counts of both corpora (10,000 numbers) are summed
on the executors.  The second adds up gains.  Ranks come from a range-partitioned sort and
prefix sums over its partitions, so no task sorts all rows; only partitions that hold
drawn rows are numbered.

Odd rows.  Null and empty texts, and texts of separators only, have no features and weight
0.  A null doc_id is hashed as empty text and comes last among ties.  Repeated rows each
count, in the corpus and in the draw; the order between rows equal in score and doc_id is
arbitrary.  Extra columns are ignored.  An empty target leaves the corpus counts alone to
decide; empty documents give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .frames import SLICE_BYTES, crc_sql, slices, staged, table, text_bytes, texts_of

GRAM = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Words longer than this are hashed one by one.
LONG_WORD = 64

#: A-Z lower-cased; every byte that is not an ASCII letter, digit or part of a longer character becomes a space.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(zlib.crc32(b"\x80") ^ zlib.crc32(b"\x00")), _CRC >> 1).astype(np.uint32)


def gram_pattern(gram: int) -> regex.Pattern:
    """Up to ``gram`` words joined by single spaces, between word boundaries."""
    return regex.compile(rb"(?<= )[^ ]++(?: [^ ]++){0,%d}+(?= )" % (gram - 1))


def collapse(text: bytes) -> bytes:
    return b" ".join(text.translate(CLEAN).split())


def _advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Raw CRC-32 registers carried over ``length`` bytes from ``start``, all at once."""
    order = np.argsort(-length, kind="stable")
    sizes, state, place = length[order], state[order], start[order].copy()
    longest = min(int(sizes[0]) if len(sizes) else 0, LONG_WORD)
    left = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), "right")
    for n in left.tolist():
        state[:n] = _CRC[(state[:n] ^ data[place[:n]]) & 255] ^ (state[:n] >> 8)
        place[:n] += 1
    for i in range(int(np.searchsorted(-sizes, -LONG_WORD))):
        rest = data[place[i] : place[i] + sizes[i] - LONG_WORD].tobytes()
        state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def crc_buckets(texts: list[bytes], pattern: regex.Pattern, gram: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram, and the number of words of every text."""
    clean = [collapse(t) for t in texts]
    joined = b" %b " % b"  ".join(clean)
    spans = np.array([m.span() for m in pattern.finditer(joined, overlapped=True)], np.int64).reshape(-1, 2)
    start, upto = spans[:, 0], spans[:, 1]
    first = np.cumsum([1] + [len(c) + 2 for c in clean])
    text_of = np.searchsorted(first, start, "right") - 1
    data = np.frombuffer(joined, np.uint8)
    # A word ends one byte before the next one of its text, or with its text.
    last = np.append(text_of[1:] != text_of[:-1], True) if len(start) else np.zeros(0, bool)
    end = np.where(last, first[text_of + 1] - 2, np.append(start[1:], 0) - 1) if len(start) else start
    state, at = np.full(len(start), 0xFFFFFFFF, np.uint32), start
    live = np.arange(len(start))
    found, owner = [], []
    for n in range(gram):
        stop = end[live + n]
        state = _advance(state, data, at, stop - at)
        found.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        owner.append(text_of[live])
        longer = stop < upto[live]
        live, state, at = live[longer], state[longer], stop[longer]
    words = np.bincount(text_of, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    return np.concatenate(found).astype(np.uint16), np.concatenate(owner), words


def features(frame: DataFrame, keep: list[str], gram: int = GRAM, buckets: int = BUCKETS) -> DataFrame:
    """The columns ``keep``, n_words, n_features and ``found`` (two bytes a feature, its bucket)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit in two bytes")
    kept = [frame.schema[c] for c in keep]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = gram_pattern(gram)
        for batch in slices(batches, limit=SLICE_BYTES // 4):
            data, offsets = text_bytes(texts_of(batch.column("text")))
            raw, cut = data.tobytes(), offsets.tolist()
            bucket, owner, words = crc_buckets([raw[a:b] for a, b in zip(cut, cut[1:])], pattern, gram, buckets)
            bucket = bucket[np.argsort(owner, kind="stable")]
            counts = np.bincount(owner, minlength=batch.num_rows)
            edges = np.concatenate(([0], np.cumsum(counts))).tolist()
            blobs = pa.array([bucket[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(words), pa.array(counts), blobs],
                [*keep, "n_words", "n_features", "found"],
            )

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return frame.select(*keep, "text").mapInArrow(scan, ", ".join([*columns, "n_words long, n_features long, found binary"]))


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows: ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, _ = _blob_buckets(batch.column("found"))
            total += np.bincount(data, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in found.select("found").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def _blob_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a binary column, and each row's first one."""
    data, offsets = text_bytes(column)
    return np.frombuffer(data.tobytes(), np.uint16), offsets // 2


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed corpus share) of each bucket."""
    size = len(corpus)
    every, aimed = float(corpus.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (every + size) / ((s + 1.0) * (aimed + size)))) for s, t in zip(corpus.tolist(), target.tolist())],
        np.int64,
    )


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``found`` with ``weight``, the sum of its features' gains, in place of the features."""
    keep = [c for c in found.columns if c != "found"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, first = _blob_buckets(batch.column("found"))
            total = np.concatenate(([0], np.cumsum(gain[bucket])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.diff(total[first]))], [*keep, "weight"])

    kinds = [f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keep]
    return found.mapInArrow(add, ", ".join([*kinds, "weight long"]))


def drawn(scored: DataFrame, eligible: str, percent: int = PERCENT) -> DataFrame:
    """``scored`` (with doc_id and score) and ``rank`` among the drawn rows, null for others."""
    rows = staged(scored.withColumn("_row", F.monotonically_increasing_id()), "importance-scores")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]
    able = rows.where(eligible)
    take = able.count() * percent // 100
    parts = staged(able.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "importance-order")
    sizes = sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for part, n in sizes:  # one number a partition
        if before < take:
            starts.append((part, before))
        before += n
    null = F.lit(None).cast("long")
    offsets = F.create_map(*[F.lit(x).cast(kind) for pair in starts for x, kind in zip(pair, ("int", "long"))]) if starts else null
    among = F.col("_part").isin([p for p, _ in starts]) if starts else F.lit(False)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + offsets[F.col("_part")] if starts else null
    numbered = parts.where(among).withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    rest = parts.where(~among).withColumn("rank", null)
    others = rows.where(~F.coalesce(F.expr(eligible), F.lit(False))).withColumn("_part", F.lit(0)).withColumn("rank", null)
    return numbered.unionByName(rest).unionByName(others).drop("_row", "_part")


def noise(doc_id: str = "doc_id", seed: int = SEED):
    """Gumbel noise times 1000, rounded down, from a hash of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank (null if not drawn)."""
    found = staged(features(docs, ["doc_id"]), "importance-features")
    gain = gains(bucket_counts(found), bucket_counts(features(target, [])))
    scored = weighted(found, gain).withColumn("score", F.col("weight") + noise(seed=seed))
    return drawn(scored, f"n_words >= {least_words}", percent)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op12_sql() -> str:
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"coalesce(regexp_extract_all(translate(text, '{capital}', '{small}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    follow = [f"lead(a, {k}) OVER (PARTITION BY r ORDER BY i)" for k in range(GRAM)]
    grams = ", ".join(" || ' ' || ".join(follow[:n]) for n in range(1, GRAM + 1))
    cut = f"SELECT r, unnest([{grams}]) AS g FROM (SELECT r, unnest(w) AS a, unnest(range(len(w))) AS i FROM"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    items AS (SELECT row_number() OVER () AS r, {words} AS w FROM benchmark),
    own AS (SELECT * FROM ({cut} docs)) WHERE g IS NOT NULL),
    aim AS (SELECT * FROM ({cut} items)) WHERE g IS NOT NULL),
    bucket AS (
      SELECT g, {crc_sql("h")} % {BUCKETS} AS b FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM own UNION SELECT g FROM aim))),
    corpus AS (SELECT b, count(*) AS s FROM own JOIN bucket USING (g) GROUP BY b),
    target AS (SELECT b, count(*) AS t FROM aim JOIN bucket USING (g) GROUP BY b),
    gain AS (
      SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM own)::DOUBLE + {BUCKETS})
        / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT count(*) FROM aim)::DOUBLE + {BUCKETS}))))::BIGINT AS gain
      FROM corpus LEFT JOIN target USING (b)),
    weights AS (
      SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM own JOIN bucket USING (g) JOIN gain USING (b) GROUP BY r),
    scored AS (
      SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
          / 4294967296::DOUBLE)))::BIGINT AS score
      FROM docs LEFT JOIN weights USING (r)),
    ranked AS (
      SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE n_words >= {LEAST_WORDS}
      QUALIFY rank <= {PERCENT} * count(*) OVER () // 100)
    SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN ranked USING (r)"""
