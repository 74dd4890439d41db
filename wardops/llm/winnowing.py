"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest ``GRAM``-word hash of every ``WINDOW -
GRAM + 1`` neighbouring ones.  Two texts that share ``WINDOW`` words share at
least one fingerprint at the same place of the shared span, so joining the
fingerprints of documents and benchmark items and extending each hit word by word
finds every shared span of that length.  An item of fewer words is one window of
all its words; for the lengths that occur, documents also look up all their runs.

The benchmark side is indexed in slices of about ``SLICE_WORDS`` words, made of
segments of at most ``SEGMENT`` words that overlap by a window less one.  A slice
is what is collected and broadcast at once, so both are bounded whatever the size
of the benchmark; a larger one takes more passes over the documents.  Documents are
never shuffled, and a document's hits never leave its row; hits of several slices
are united per document.

Defined cases: null and empty texts have no words and no hits; items without words
never occur; items with a null id count for hits but are not listed; repeated rows
and ids are judged one by one, repeated item ids are listed once; an empty
benchmark leaves all documents clean; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import filtered, packed, slices, staged, table, texts_of
from .tokens import LETTER_OR_DIGIT, LOWER, gram_hashes, split_words, within_text, word_hashes

WINDOW = 10
GRAM = 5
SLICE_WORDS = 1 << 20
SEGMENT = 1 << 15


def winnow(grams: np.ndarray, whole: np.ndarray, span: int) -> np.ndarray:
    """Places of the smallest hash (rightmost of equals) of each ``span`` neighbouring grams of one text.

    ``whole[i]`` says whether the window of ``span`` grams from i lies in one text.
    """
    n = len(whole)
    best, place = grams[:n].copy(), np.arange(n)
    for j in range(1, span):
        other = grams[j : j + n]
        less = other <= best
        best[less] = other[less]
        place[less] = np.flatnonzero(less) + j
    return np.unique(place[whole])


class Index:
    """Fingerprints and runs of one slice of segments; fits in ``SLICE_WORDS`` words."""

    def __init__(self, segments: list[tuple[str | None, int, np.ndarray]], window: int, gram: int):
        self.window, self.gram = window, gram
        same: dict[bytes, int] = {}
        self.items: list[set] = []  # ids of equal segments
        self.words: list[np.ndarray] = []
        for item, _, words in segments:
            at = same.setdefault(words.tobytes(), len(self.words))
            if at == len(self.words):
                self.words.append(words)
                self.items.append(set())
            self.items[at].add(item)
        prints, owner, place = [], [], []
        self.short: dict[int, dict[int, int]] = {}  # length -> run hash -> segment
        for at, words in enumerate(self.words):
            if len(words) < window:
                self.short.setdefault(len(words), {})[int(gram_hashes(words, len(words))[0])] = at
                continue
            grams = gram_hashes(words, gram)
            spots = winnow(grams, np.ones(len(words) - window + 1, bool), window - gram + 1)
            prints.append(grams[spots])
            owner.append(np.full(len(spots), at))
            place.append(spots)
        if prints:
            order = np.argsort(joined := np.concatenate(prints), kind="stable")
            self.prints, self.owner, self.place = joined[order], np.concatenate(owner)[order], np.concatenate(place)[order]
        else:
            self.prints, self.owner, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def hits(self, words, hashes: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set]]:
        """Per text with hits: its hit word ranges (relative to the text) and the segments found."""
        found: dict[int, tuple[list[tuple[int, int]], set]] = {}

        def add(text: int, low: int, high: int, segment: int) -> None:
            ranges, segments = found.setdefault(text, ([], set()))
            ranges.append((low - int(words.first[text]), high - int(words.first[text])))
            segments.add(segment)

        for length, runs in self.short.items():
            grams, whole = gram_hashes(hashes, length), within_text(words, length)
            wanted = np.sort(np.fromiter(runs, np.uint64, len(runs)))
            for at in np.flatnonzero(_among(grams, wanted) & whole).tolist():
                text = int(np.searchsorted(words.first, at, "right")) - 1
                add(text, at, at + length, runs[int(grams[at])])
        if len(self.prints) and len(hashes) >= self.window:
            grams = gram_hashes(hashes, self.gram)
            spots = winnow(grams, within_text(words, self.window), self.window - self.gram + 1)
            spots = spots[_among(grams[spots], self.prints)]
            done: dict[tuple[int, int], int] = {}  # (segment, diagonal) -> end of the last extended run
            for at in spots.tolist():
                text = int(np.searchsorted(words.first, at, "right")) - 1
                low, high = int(words.first[text]), int(words.first[text + 1])
                left = np.searchsorted(self.prints, grams[at], "left")
                right = np.searchsorted(self.prints, grams[at], "right")
                for k in range(left, right):
                    segment, place = int(self.owner[k]), int(self.place[k])
                    if done.get((segment, at - place), -1) > at:
                        continue
                    own = self.words[segment]
                    back = _equal(own[:place][::-1], hashes[low:at][::-1])
                    ahead = _equal(own[place:], hashes[at:high])
                    done[segment, at - place] = at + ahead
                    if back + ahead >= self.window:
                        add(text, at - back, at + ahead, segment)
        return found


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = min(n, at + step), step * 4
    return n


def _words(texts: pa.Array):
    words = split_words(texts, LETTER_OR_DIGIT)
    return words, word_hashes(words, LOWER)


def segments(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, n, words): word hashes of every item, cut into overlapping segments."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, hashes = _words(texts_of(batch.column("text")))
            items, counts, parts = [], [], []
            for i, item in enumerate(batch.column("item").to_pylist()):
                own = hashes[words.first[i] : words.first[i + 1]]
                for at in range(0, max(len(own) - window + 1, 1) if len(own) else 0, SEGMENT - window + 1):
                    part = own[at : at + SEGMENT]
                    items.append(item)
                    counts.append(len(part))
                    parts.append(part.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(counts, pa.int64()), pa.array(parts, pa.binary())],
                ["item", "n", "words"],
            )

    return rows.mapInArrow(cut, "item string, n long, words binary")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``row`` (the document row without its text), ``text_key``, n_words, ``hits`` (array of word ranges [low, high)), ``items``."""
    found = [_search(docs, index) for index in _indexes(benchmark, window, gram)]
    if len(found) == 1:
        return found[0]
    return _united(docs, [staged(part.where(F.size("hits") > 0), "winnow-hits") for part in found])


def _indexes(benchmark: DataFrame, window: int, gram: int) -> list:
    """Broadcast indexes of all segments, ``SLICE_WORDS`` words or so in each."""
    cut = staged(segments(benchmark, window), "winnow-segments")
    total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    passes = max(1, -(-total // SLICE_WORDS))
    out = []
    for at in range(passes):
        own = cut if passes == 1 else cut.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == at)
        rows = [(r.item, r.n, np.frombuffer(r.words, np.uint64)) for r in own.collect()]
        out.append(benchmark.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Index(rows, window, gram))))
    return out


def _united(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Hits of several passes joined per row; equal rows have equal hits and count once in a pass."""
    whole = packed(docs).select("row", _text_key().alias("text_key"), _count_words().alias("n_words"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    key = F.sha2(F.concat(F.to_json("row"), "text_key").cast("binary"), 256)
    merged = hits.groupBy(key.alias("key")).agg(
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    empty = lambda kind: F.array().cast(kind)
    return whole.withColumn("key", key).join(merged, "key", "left").select(
        "row", "text_key", "n_words", F.coalesce("hits", empty("array<struct<low:long,high:long>>")).alias("hits"),
        F.coalesce("items", empty("array<string>")).alias("items"),
    )


def _count_words():
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # A-Z become a-z before the split
    return F.coalesce(F.regexp_count("text", F.lit(word)), F.lit(0)).cast("long")


def _text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def _search(docs: DataFrame, index) -> DataFrame:
    rows = packed(docs).withColumn("text_key", _text_key())
    kind = rows.schema[0].dataType.simpleString()
    pairs = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(index.value)
        for batch in slices(batches):
            words, hashes = _words(texts_of(batch.column("text")))
            found = known.hits(words, hashes)
            hits, items = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for text, (ranges, segs) in found.items():
                hits[text] = [{"low": a, "high": b} for a, b in _merged(ranges)]
                items[text] = sorted({i for s in segs for i in known.items[s]} - {None})
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text_key"), pa.array(np.diff(words.first)), pa.array(hits, pairs), pa.array(items, pa.list_(pa.string()))],
                ["row", "text_key", "n_words", "hits", "items"],
            )

    schema = f"row {kind}, text_key string, n_words long, hits array<struct<low:long,high:long>>, items array<string>"
    return rows.mapInArrow(search, schema)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows without a hit."""
    indexes = _indexes(benchmark, window, gram)
    for at, index in enumerate(indexes):
        docs = _without_hits(docs, index)
        if at + 1 < len(indexes):  # one index at a time in a worker
            docs = staged(docs, "winnow-clean")
    return docs


def _without_hits(docs: DataFrame, index) -> DataFrame:
    def clean(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
        known = pickle.loads(index.value)
        for piece in pieces:
            words, hashes = _words(texts_of(piece.column("text")))
            mask = np.ones(piece.num_rows, bool)
            mask[list(known.hits(words, hashes))] = False
            yield pa.array(mask)

    return filtered(docs, clean)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    covered = F.aggregate(
        F.array_sort("hits"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda s, h: F.struct(
            (s["n"] + F.greatest(h["high"] - F.greatest(h["low"], s["upto"]), F.lit(0).cast("long"))).alias("n"),
            F.greatest(s["upto"], h["high"]).alias("upto"),
        ),
        lambda s: s["n"],
    )
    return found.select(
        "row.doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op8_sql() -> str:
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"coalesce(regexp_extract_all(translate(text, '{capital}', '{small}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    return f"""
    WITH items AS (SELECT item_id, {words} AS w FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, n, array_to_string(w[a : a + n - 1], ' ') AS k
      FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS a
            FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM items) WHERE n > 0)),
    docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    found AS (
      SELECT r, a, d.n, item_id FROM (
        SELECT r, n, a, array_to_string(w[a : a + n - 1], ' ') AS k
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)) d
      JOIN windows USING (n, k)),
    hits AS (
      SELECT r, list_distinct(flatten(list(range(a, a + n)))) AS places, list_sort(list_distinct(list(item_id::VARCHAR))) AS ids
      FROM found GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
      sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, places IS NOT NULL AS contaminated
    FROM docs LEFT JOIN hits USING (r)"""
