"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL.

A text's features are hashed n-grams of two streams over its words: the folded
words themselves (one and two words) and their shapes (one to three words; a shape
tells letter case, digits, symbols, length and whether the word repeats the one
before).  A feature's value is the root of its share of the text's n-grams, so
values do not depend on the text's length.  Weights are learned by
follow-the-regularised-leader with per-coordinate rates; a score is a sparse dot
product through the logistic function.

Training reads at most ``TRAIN_ROWS`` labelled documents, those with the smallest
hashes of their id; their sparse features (at most ``DIMENSIONS`` a document), not
their texts, are what the driver collects.  Scoring is one pass over all documents
without a shuffle; the model travels in a broadcast of fixed size.

Defined cases: null and empty texts have no features and get the score of the
bias; null ids and labels are not learned from; the rows of a repeated id give one
example, the first text by code point; without two classes to learn from every score is the share of label 1 (or
0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import filtered, packed, slices, table, texts_of, training_side
from .tokens import LOWER, NOT_SPACE, Words, gram_hashes, mix, split_words, within_text, word_hashes

BITS = 18
DIMENSIONS = 1 << BITS
TRAIN_ROWS = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.0005, 0.01
WORD_GRAMS = (1, 2)
SHAPE_GRAMS = (1, 2, 3)

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SYMBOL = ~(_LETTER | _DIGIT)


def _counts(words: Words, kind: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(kind[words.data], dtype=np.int32)))
    return total[words.end] - total[words.start]


def shapes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """A small number for each word's look."""
    size = words.end - words.start
    upper, letters = _counts(words, _UPPER), _counts(words, _LETTER)
    digits, symbols = _counts(words, _DIGIT), _counts(words, _SYMBOL)
    repeats = np.zeros(len(size), np.int64)
    repeats[1:] = hashes[1:] == hashes[:-1]
    n = np.diff(words.first)
    repeats[words.first[:-1][n > 0]] = 0
    case = np.where(upper == 0, 0, np.where((upper > 1) & (2 * upper > letters), 2, 1))
    long = np.searchsorted([3, 7, 13, 25], size, "right")
    return ((((case * 2 + (digits > 0)) * 4 + np.minimum(symbols, 3)) * 5 + long) * 2 + repeats).astype(np.uint64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of every distinct n-gram, ordered by text and feature."""
    words = split_words(texts, NOT_SPACE)
    hashes = word_hashes(words, LOWER)
    looks = mix(shapes(words, hashes) + np.uint64(1 << 40)) if len(hashes) else hashes
    text_of = words.text_of
    keys = []
    for stream, sizes in ((hashes, WORD_GRAMS), (looks, SHAPE_GRAMS)):
        for size in sizes:
            grams = mix(gram_hashes(stream, size) + np.uint64(size)) >> np.uint64(64 - BITS)
            whole = within_text(words, size)
            keys.append((text_of[: len(grams)].astype(np.uint64) << np.uint64(BITS) | grams)[whole])
    keys = np.sort(np.concatenate(keys))
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    count = np.diff(np.concatenate((begin, [len(keys)])))
    text = (keys[begin] >> np.uint64(BITS)).astype(np.int64)
    feature = (keys[begin] & np.uint64(DIMENSIONS - 1)).astype(np.int64)
    total = np.bincount(text, count, len(texts))
    return text, feature, np.sqrt(count / total[text]).astype(np.float32)


class Model(NamedTuple):
    bias: float
    weights: np.ndarray  # float32, one per feature

    def scores(self, texts: pa.Array) -> np.ndarray:
        text, feature, value = features(texts)
        margin = self.bias + np.bincount(text, self.weights[feature] * value, len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> Model:
    """Rows are (label, features, values), taken in the given order in every epoch."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        active = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, active)

    for _ in range(epochs):
        for label, feature, value in rows:
            at = np.append(feature, DIMENSIONS)  # the last one is the bias
            x = np.append(value, np.float32(1))
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    w = weight(np.arange(DIMENSIONS + 1))
    return Model(float(w[-1]), w[:-1].astype(np.float32))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(label, order, text) of at most ``rows`` labelled documents of the training side."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(training_side(F.col("doc_id")))
    drawn = known.select("doc_id", F.col("quality").cast("int").alias("label"), order.alias("order"))
    drawn = drawn.orderBy("order", "doc_id").limit(rows)
    texts = docs.select("doc_id", "text")
    drawn = drawn.groupBy("doc_id", "order").agg(F.min("label").alias("label"))  # at most ``rows`` rows
    found = texts.join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id", "label", "order").agg(F.min("text").alias("text")).select("label", "order", "text")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, feature, value = features(texts_of(batch.column("text")))
            borders = np.searchsorted(text, np.arange(batch.num_rows + 1))
            spans = [slice(a, b) for a, b in zip(borders[:-1], borders[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label"), batch.column("order"),
                    pa.array([feature[s].astype(np.int32).tobytes() for s in spans], pa.binary()),
                    pa.array([value[s].tobytes() for s in spans], pa.binary()),
                ],
                ["label", "order", "feature", "value"],
            )

    found = labelled_sample(docs, labels, rows).mapInArrow(
        featurise, "label int, order long, feature binary, value binary"
    ).toArrow()
    learned = sorted(
        (order, label, feature, value)
        for label, order, feature, value in zip(*(found.column(i).to_pylist() for i in range(4)), strict=True)
    )
    examples = [(y, np.frombuffer(f, np.int32), np.frombuffer(v, np.float32)) for _, y, f, v in learned]
    ones = sum(y for y, _, _ in examples)
    if not 0 < ones < len(examples):
        share = ones / len(examples) if examples else 0.5
        return Model(float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), np.zeros(DIMENSIONS, np.float32))
    return train_ftrl(examples)


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (the input row without its text) and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    rows = packed(docs)
    kind = rows.schema[0].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*sent.value)
        for batch in slices(batches):
            scores = known.scores(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores)], ["row", "score"])

    return rows.mapInArrow(score, f"row {kind}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows that score at least ``least``."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def good(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
        known = Model(*sent.value)
        for piece in pieces:
            yield pa.array(known.scores(texts_of(piece.column("text"))) >= least)

    return filtered(docs, good)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("row.doc_id", "score")
    return scored.select(
        "doc_id", (~training_side(F.col("doc_id"))).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
