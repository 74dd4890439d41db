"""Repeated passages: a count-min prefilter, then an exact grouping of windows.

A window is ``WINDOW`` consecutive words of one document.  It is charged to the
smallest hash among its ``GRAM``-word grams; equal windows are charged to equal
grams, so the number of documents charged to a gram is never less than the number
of documents that hold the window.  Pass one counts grams per document in a
count-min sketch per task (counters stop at 2); the sketches are merged slice by
slice.  Pass two groups exactly, by 96 hash bits, only windows whose gram is
estimated repeated; an estimate is never too low, so none is lost.

The sketch is sized from the bytes of the input up to ``MAX_WIDTH`` counters a row,
which bounds the broadcast (``DEPTH * MAX_WIDTH / 8`` bytes); a fuller sketch only
passes more windows on to the exact grouping.  Grams found in about a ``HEAVY``-th
of all documents or more are noticed in pass one.  Windows charged to them are
counted first, combined before the shuffle; those in many places, ``OFTEN`` at
most, are broadcast with their first document and decided where the text is read.
All others form small groups and need one shuffle.  Texts are shuffled once, to
meet their removals.

A word is removed if it lies in a window whose words also start in a document with
a smaller id.  Windows are judged on the input, not on what is left.

Defined cases: null and empty texts have no words; a document without an id is
returned whole and removes nothing elsewhere; rows that share an id are judged one
by one and never against each other; texts shorter than a window stay whole; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .frames import slices, staged, table, texts_of
from .tokens import NOT_SPACE, gram_hashes, mix, split_words, within_text, word_hashes

WINDOW = 50
GRAM = 20
DEPTH = 2
MAX_WIDTH = 1 << 28
HEAVY = 256
#: Windows decided from a broadcast table: so many at most, each in so many places at least.
OFTEN = 1 << 20
LEAST_OFTEN = 16
#: Documents of a task that are tallied at once.
TALLY = 4096
_CHUNK = 1 << 16


def anchors(grams: np.ndarray, whole: np.ndarray, span: int) -> np.ndarray:
    """For each window start, the place of its smallest gram (rightmost of equals); -1 outside a text."""
    n = len(whole)
    best, place = grams[:n].copy(), np.arange(n)
    for j in range(1, span):
        other = grams[j : j + n]
        less = other <= best
        best[less] = other[less]
        place[less] = np.flatnonzero(less) + j
    return np.where(whole, place, -1)


def slots(grams: np.ndarray, row: int, width: int) -> np.ndarray:
    return mix(grams + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & (1 << 64) - 1)) & np.uint64(width - 1)


def charged(texts: pa.Array, window: int, gram: int):
    """Words, hashes, grams and anchors of texts."""
    words = split_words(texts, NOT_SPACE)
    hashes = word_hashes(words)
    grams = gram_hashes(hashes, gram)
    return words, hashes, grams, anchors(grams, within_text(words, window), window - gram + 1)


def _sketch_rows(held: list[np.ndarray], docs: int, width: int) -> pa.RecordBatch:
    """Sketch pieces (kind 0) and often seen grams (kind 1) of some documents."""
    grams = np.concatenate(held)
    kind, slot, once, twice, n = [], [], [], [], []
    for row in range(DEPTH):
        found, count = np.unique(slots(grams, row, width), return_counts=True)
        chunk = (found // _CHUNK).astype(np.int64)
        borders = np.flatnonzero(np.concatenate((chunk[1:] != chunk[:-1], [True]))) + 1 if len(chunk) else []
        at = 0
        for end in borders:
            low = (found[at:end] % _CHUNK).astype(np.uint16)
            kind.append(0)
            slot.append(row * (width // _CHUNK) + int(chunk[at]))
            once.append(low.tobytes())
            twice.append(low[count[at:end] > 1].tobytes())
            n.append(0)
            at = end
    seen, count = np.unique(grams, return_counts=True)
    often = count >= max(2, docs / (2 * HEAVY))
    for g, c in zip(seen[often].view(np.int64).tolist(), count[often].tolist()):
        kind.append(1)
        slot.append(g)
        once.append(b"")
        twice.append(b"")
        n.append(c)
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(slot, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary()), pa.array(n, pa.int64())],
        ["kind", "slot", "once", "twice", "n"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one chunk, which come one after the other, united; counters stop at 2."""
    def done(slot: int, twice: np.ndarray) -> pa.RecordBatch:
        bits = np.packbits(twice, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([bits], pa.binary())], ["slot", "bits"])

    now, once, twice = None, np.zeros(_CHUNK, bool), np.zeros(_CHUNK, bool)
    for batch in batches:
        for slot, a, b in zip(*(batch.column(n).to_pylist() for n in ("slot", "once", "twice"))):
            if slot != now:
                if now is not None and twice.any():
                    yield done(now, twice)
                now = slot
                once[:], twice[:] = False, False
            seen = np.frombuffer(a, np.uint16)
            twice[seen[once[seen]]] = True
            once[seen] = True
            twice[np.frombuffer(b, np.uint16)] = True
    if now is not None and twice.any():
        yield done(now, twice)


def sketch(docs: DataFrame, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (DEPTH x width/8) of counters that reached 2, and the sorted heavy grams."""
    texts = docs.where("doc_id IS NOT NULL").select("text")
    stats = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    width = _CHUNK
    while width < min(MAX_WIDTH, stats[0] // 25):  # a gram is charged about every 100 bytes
        width *= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            words, _, grams, place = charged(texts_of(batch.column("text")), window, gram)
            place = np.unique(place[place >= 0])
            text, own = words.text_of[place], grams[place]
            order = np.lexsort((own, text))
            text, own = text[order], own[order]
            again = (text[1:] == text[:-1]) & (own[1:] == own[:-1])
            held.append(np.delete(own, np.flatnonzero(again) + 1))  # once per document
            size += batch.num_rows
            if size >= TALLY:
                yield _sketch_rows(held, size, width)
                held, size = [], 0
        if held:
            yield _sketch_rows(held, size, width)

    found = staged(texts.mapInArrow(count, "kind int, slot long, once binary, twice binary, n long"), "repeats-sketch")
    merged = found.where("kind = 0").select("slot", "once", "twice").repartition("slot").sortWithinPartitions("slot")
    bits = np.zeros((DEPTH, width // 8), np.uint8)
    per_row = width // _CHUNK
    for slot, chunk in merged.mapInArrow(_merge, "slot long, bits binary").collect():  # DEPTH * width / 8 bytes at most
        at = slot % per_row * (_CHUNK // 8)
        bits[slot // per_row, at : at + _CHUNK // 8] = np.frombuffer(chunk, np.uint8)
    heavy = found.where("kind = 1").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= max(16, stats[1] / (2 * HEAVY)))
    grams = [r.slot for r in heavy.select("slot").collect()]  # at most 2 * HEAVY for each gram of an average document
    return bits, np.sort(np.array(grams, np.int64).view(np.uint64))


def _identity(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of every window: a long and an int."""
    more = (gram_hashes(hashes, window, 4) >> np.uint64(32)).astype(np.uint32)
    return gram_hashes(hashes, window, 3).view(np.int64), more.view(np.int32)


class Known:
    """Often repeated windows and the first document of each; at most ``OFTEN`` of them."""

    def __init__(self, w: np.ndarray, x: np.ndarray, least: np.ndarray):
        order = np.lexsort((x, w))
        self.w, self.x, self.least = w[order], x[order], least[order]

    def first(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Place of each window in the table, -1 if it is not there."""
        if not len(self.w):
            return np.full(len(w), -1)
        at = np.minimum(np.searchsorted(self.w, w), len(self.w) - 1)
        found = (self.w[at] == w) & (self.x[at] == x)
        for i in np.flatnonzero((self.w[at] == w) & ~found).tolist():  # equal w, other x
            while at[i] + 1 < len(self.w) and self.w[at[i]] == w[i] and self.x[at[i]] != x[i]:
                at[i] += 1
            found[i] = self.w[at[i]] == w[i] and self.x[at[i]] == x[i]
        return np.where(found, at, -1)


def repeated_windows(docs: DataFrame, sent, often: bool, window: int, gram: int) -> DataFrame:
    """(w, x, doc, place) of windows estimated repeated; place holds the row's tag and the first word.

    ``often``: only those charged to a heavy gram; otherwise all but the known ones.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), _tag().alias("tag"), "text")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, heavy, *table = sent.value
        known = Known(*table)
        width = bits.shape[1] * 8
        for batch in slices(batches):
            words, hashes, grams, place = charged(texts_of(batch.column("text")), window, gram)
            start = np.flatnonzero(place >= 0)
            if not len(start):
                continue
            spots, back = np.unique(place[start], return_inverse=True)
            picked = np.ones(len(spots), bool)
            for row in range(DEPTH):
                slot = slots(grams[spots], row, width)
                picked &= (bits[row][slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            if often:
                picked &= np.isin(grams[spots], heavy)
            start = start[picked[back]]
            w, x = (part[start] for part in _identity(hashes, window))
            if not often:
                new = known.first(w, x) < 0
                start, w, x = start[new], w[new], x[new]
            text = words.text_of[start]
            tag = batch.column("tag").to_numpy()[text].astype(np.int64)
            at = tag << 32 | (start - words.first[:-1][text])
            yield pa.RecordBatch.from_arrays(
                [pa.array(w), pa.array(x), batch.column("doc").take(pa.array(text)), pa.array(at)], ["w", "x", "doc", "place"]
            )

    return rows.mapInArrow(pick, "w long, x int, doc long, place long")


def _tag():
    """31 bits of the text, to tell rows of one id apart."""
    return F.shiftrightunsigned(F.xxhash64("text"), 33).cast("int")


def often_repeated(docs: DataFrame, found: tuple, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w, x, first document) of windows in so many places that at most ``OFTEN`` can be."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
    if not len(found[1]):
        return none
    sent = docs.sparkSession.sparkContext.broadcast((*found, *none))
    counted = repeated_windows(docs, sent, True, window, gram).groupBy("w", "x").agg(
        F.count("*").alias("n"), F.min("doc").alias("least")
    )
    counted = staged(counted.where(F.col("n") >= LEAST_OFTEN), "repeats-often")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = counted.where(F.col("n") >= max(LEAST_OFTEN, -(-total // OFTEN))).select("w", "x", "least").toArrow()
    return tuple(table.column(c).to_numpy() for c in ("w", "x", "least"))


def removals(docs: DataFrame, sent, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, tag, starts): the first words of windows to remove, but for the often repeated ones."""
    rows = repeated_windows(docs, sent, False, window, gram)
    late = rows.withColumn("least", F.min("doc").over(Window.partitionBy("w", "x"))).where("doc > least")
    return late.groupBy("doc", F.shiftright("place", 32).cast("int").alias("tag")).agg(
        F.collect_list(F.col("place").bitwiseAND(F.lit((1 << 32) - 1).cast("long")).cast("int")).alias("starts")
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every text without its repeated passages."""
    found = sketch(docs, window, gram)
    sent = docs.sparkSession.sparkContext.broadcast((*found, *often_repeated(docs, found, window, gram)))
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("doc"), _tag().alias("tag"), "text")
    joined = rows.join(removals(docs, sent, window, gram), ["doc", "tag"], "left").select("doc_id", "doc", "text", "starts")
    kind = joined.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(*sent.value[2:])
        for batch in slices(batches):
            words = split_words(texts_of(batch.column("text")), NOT_SPACE)
            n = len(words.start)
            gone = np.zeros(n + 1, np.int32)
            if len(known.w) and n >= window:
                place = known.first(*_identity(word_hashes(words), window))
                place[~within_text(words, window)] = -1
                start = np.flatnonzero(place >= 0)
                doc = batch.column("doc").fill_null(-(1 << 63)).to_numpy()[words.text_of[start]]
                start = start[doc > known.least[place[start]]]
                gone[start] += 1
                gone[start + window] -= 1
            for i, starts in enumerate(batch.column("starts")):
                if starts.is_valid:
                    at = np.unique(starts.values.to_numpy()) + words.first[i]
                    gone[at] += 1
                    gone[at + window] -= 1
            stay = np.cumsum(gone)[:-1] == 0
            kept = []
            for i in range(batch.num_rows):
                own, left = words.strings(i), stay[words.first[i] : words.first[i + 1]]
                kept.append(b" ".join(own if left.all() else [w for w, s in zip(own, left.tolist()) if s]).decode())
            n_words = np.diff(words.first)
            n_removed = n_words - np.bincount(words.text_of[stay], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_sql() -> str:
    return f"""
    WITH docs AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
    starts AS (
      SELECT r, doc_id, a, md5(array_to_string(w[a : a + {WINDOW - 1}], ' ')) AS k
      FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS a FROM docs WHERE doc_id IS NOT NULL)),
    late AS (
      SELECT r, list(a) AS s FROM (SELECT r, doc_id, a, min(doc_id) OVER (PARTITION BY k) AS least FROM starts)
      WHERE doc_id > least GROUP BY r),
    gone AS (
      SELECT r, list_distinct(flatten(list_transform(s, lambda a: range(a, a + {WINDOW})))) AS g FROM late),
    kept AS (
      SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
        CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k
      FROM docs LEFT JOIN gone USING (r))
    SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""
