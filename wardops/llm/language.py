"""Language of code-switched text: a linear-chain conditional random field over words.

Every word gets a label.  Its features are affixes, character bigrams and trigrams
(with marks at both ends), and the word itself if it is in a lexicon of frequent
training words.  Transitions between neighbouring labels are learned with them, by
maximising the likelihood of labelled stretches, some of which switch language.
Forward-backward gives each word's label probabilities; a text's language is the
label with the largest mean, which is its score.

All words of a slice of texts form one chain in which the first word of a text
forgets what came before, so long and short texts are decoded together: products
of transition matrices over blocks, a scan over blocks, then all blocks at once.
With more than ``FEW`` labels such products cost too much; then the texts of a slice
advance together, one word of each at a time, which gives the same probabilities.

Every language of the training side is learned, however many there are.  Training
reads stretches of about ``TRAIN_DOCS`` documents a language, drawn by a hash of their
id, the one with the smallest hash in any case; beyond ``ALL_DOCS`` documents in all
each language gets an equal part of them, but ``LEAST_DOCS`` at least.  ``STRETCHES``
stretches of ``STRETCH`` words of each are what the driver collects.  Work arrays hold
about ``CELLS`` word-label pairs, a longer text is walked in pieces; weights hold
``WEIGHTS`` feature-label pairs, so beyond 256 labels more features share a weight.
Time and the transition matrix grow with the square of the number of labels.
Prediction is one pass over all documents without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is
every text if nothing could be learned; null languages are not learned; equal means
go to the first language by name; repeated rows are predicted alike; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import packed, slices, staged, table, texts_of, training_side
from .tokens import LOWER, Words, mix, split_words, word_hashes

BITS = 17
TRAIN_DOCS = 300
STRETCHES = 6
STRETCH = 24
LONGEST = 64
ALL_DOCS = 4800
LEAST_DOCS = 8
FEW = 8
CELLS = 1 << 22
WEIGHTS = 1 << 25
LEXICON = 4000
EPOCHS = 25
RATE = 0.5
BLOCK = 64
UNKNOWN = "und"

_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: Bytes of words: ASCII letters and all bytes of other characters.
WORD = _ASCII_LETTER | (np.arange(256) >= 128)
#: A text with such a character has a word.
LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"


def word_features(words: Words, which: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray):
    """(word, feature) of the chosen words, ordered by word; ``hashes`` are those of the chosen words."""
    start, size = words.start[which], words.end[which] - words.start[which]
    marked = size + 2
    first = np.concatenate(([0], np.cumsum(marked)))
    owner = np.repeat(np.arange(len(which)), marked)
    inside = np.arange(first[-1]) - first[:-1][owner]
    flat = np.full(first[-1], ord("$"), np.uint64)
    body = (inside > 0) & (inside <= size[owner])
    flat[body] = LOWER[words.data[start[owner[body]] + inside[body] - 1]]
    flat[first[:-1]] = ord("^")
    found, owners = [], []

    def add(kind: int, value: np.ndarray, own: np.ndarray) -> None:
        found.append(mix(value * np.uint64(16) + np.uint64(kind)) >> np.uint64(64 - BITS))
        owners.append(own)

    left = marked[owner] - inside  # bytes from here to the end of the marked word
    for n in (2, 3):
        at = np.flatnonzero(left >= n)
        value = flat[at]
        for j in range(1, n):
            value = value * np.uint64(256) + flat[at + j]
        add(n, value, owner[at])
    for n in (4, 5):  # affixes with their mark
        longer = np.flatnonzero(marked >= n)
        for kind, begin in ((n, first[:-1][longer]), (n + 4, first[1:][longer] - n)):
            value = flat[begin]
            for j in range(1, n):
                value = value * np.uint64(256) + flat[begin + j]
            add(kind, value, longer)
    if len(lexicon):
        known = lexicon[np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)] == hashes
        add(15, hashes[known], np.flatnonzero(known))
    owners, found = np.concatenate(owners), np.concatenate(found).astype(np.int64)
    order = np.argsort(owners, kind="stable")
    return owners[order], found[order]


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # features x languages
    moves: np.ndarray  # from x to
    begin: np.ndarray
    lexicon: np.ndarray  # sorted word hashes


def feature_blocks(words: Words, which: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray, shape: tuple[int, int]):
    """(low, high, owner, feature) of runs of the chosen words; ``shape`` is that of the weights."""
    shift, some = BITS - (shape[0].bit_length() - 1), max(1, CELLS // 16 // shape[1])
    for low in range(0, len(which), some):
        owner, feature = word_features(words, which[low : low + some], hashes[low : low + some], lexicon)
        yield low, min(low + some, len(which)), owner.astype(np.int32), (feature >> shift).astype(np.int32)


def block_scores(weights: np.ndarray, n: int, blocks) -> np.ndarray:
    out = np.empty((n, weights.shape[1]), weights.dtype)
    for low, high, owner, feature in blocks:
        out[low:high] = np.add.reduceat(weights[feature], np.searchsorted(owner, np.arange(high - low)), axis=0)
    return out


def emissions(model: Model, words: Words) -> np.ndarray:
    """The label scores of every word, worked out once per distinct word."""
    hashes = word_hashes(words, LOWER, 5)
    distinct, which, back = np.unique(hashes, return_index=True, return_inverse=True)
    blocks = feature_blocks(words, which, distinct, model.lexicon, model.weights.shape)
    return block_scores(model.weights, len(which), blocks)[back]


def forward_backward(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, begin: np.ndarray):
    """(alpha, beta, e): messages, each scaled to sum 1, and emission factors of a chain with resets."""
    n, labels = scores.shape
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    t, s = np.exp(moves - moves.max()), np.exp(begin - begin.max())
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n
    ee = np.concatenate((e, np.ones((pad, labels)))).reshape(blocks, BLOCK, labels)
    at = np.concatenate((starts, np.ones(pad, bool))).reshape(blocks, BLOCK)

    def step(rows: np.ndarray, j: int) -> np.ndarray:
        """Row vectors (blocks x any x labels) times the matrix of each block's word j."""
        new = np.where(at[:, j, None, None], rows.sum(axis=2, keepdims=True) * s, rows @ t) * ee[:, j, None, :]
        return new / new.sum(axis=(1, 2), keepdims=True)

    product = np.broadcast_to(np.eye(labels), (blocks, labels, labels))
    for j in range(BLOCK):
        product = step(product, j)
    into, back = np.empty((blocks, labels)), np.empty((blocks, labels))
    now = np.full(labels, 1 / labels)
    for b in range(blocks):
        into[b] = now
        now = now @ product[b]
        now /= now.sum()
    now = np.full(labels, 1 / labels)
    for b in range(blocks - 1, -1, -1):
        back[b] = now
        now = product[b] @ now
        now /= now.sum()
    alpha, beta = np.empty((blocks, BLOCK, labels)), np.empty((blocks, BLOCK, labels))
    now = into[:, None, :]
    for j in range(BLOCK):
        now = step(now, j)
        alpha[:, j] = now[:, 0]
    now = back
    for j in range(BLOCK - 1, -1, -1):
        beta[:, j] = now
        weighted = ee[:, j] * now
        now = np.where(at[:, j, None], (weighted @ s)[:, None], weighted @ t.T)
        now /= now.sum(axis=1, keepdims=True)
    return alpha.reshape(-1, labels)[:n], beta.reshape(-1, labels)[:n], e


def step_by_step(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, begin: np.ndarray, into=None, back=None):
    """What ``forward_backward`` gives, by one word of every text at a time.

    ``into`` is the message before a first word that starts no text, ``back`` the one after the last word.
    """
    n, labels = scores.shape
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    t, s = np.exp(moves - moves.max()), np.exp(begin - begin.max())
    first = np.flatnonzero(starts | (np.arange(n) == 0))
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    active = np.searchsorted(-size, -np.arange(size[0] + 1))  # texts with more words than that
    alpha, beta = np.empty((n, labels)), np.full((n, labels), 1 / labels)
    if back is not None:
        beta[-1] = back
    for j in range(size[0]):
        rows = first[: active[j]] + j
        if j:
            before = alpha[rows - 1] @ t
        else:
            before = np.broadcast_to(s, (len(rows), labels)).copy()
            if not starts[0]:
                before[rows == 0] = (np.full(labels, 1 / labels) if into is None else into) @ t
        now = before * e[rows]
        alpha[rows] = now / now.sum(axis=1, keepdims=True)
    for j in range(size[0] - 2, -1, -1):
        rows = first[: active[j + 1]] + j
        now = (e[rows + 1] * beta[rows + 1]) @ t.T
        beta[rows] = now / now.sum(axis=1, keepdims=True)
    return alpha, beta, e


def chain(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, begin: np.ndarray):
    return (forward_backward if scores.shape[1] <= FEW else step_by_step)(scores, starts, moves, begin)


def _shares(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    both = alpha * beta
    return both / both.sum(axis=1, keepdims=True)


def _span(words: Words, low: int, high: int) -> Words:
    return words._replace(start=words.start[low:high], end=words.end[low:high])


def _sum_in_pieces(model: Model, words: Words, low: int, high: int, room: int) -> np.ndarray:
    """The label sums of one long text: a forward pass that keeps one message a piece, then all from the last."""
    cuts = [*range(low, high, room), high]
    into: list = [None]

    def piece(i: int, back=None):
        span = _span(words, cuts[i], cuts[i + 1])
        starts = np.zeros(len(span.start), bool)
        starts[0] = i == 0
        return step_by_step(emissions(model, span), starts, model.moves, model.begin, into[i], back)

    for i in range(len(cuts) - 2):
        into.append(piece(i)[0][-1])
    total, back = np.zeros(len(model.languages)), None
    t = np.exp(model.moves - model.moves.max())
    for i in range(len(cuts) - 2, -1, -1):
        alpha, beta, e = piece(i, back)
        total += _shares(alpha, beta).sum(axis=0)
        back = t @ (e[0] * beta[0])
        back /= back.sum()
    return total


def label_sums(model: Model, words: Words) -> np.ndarray:
    """Each text's label probabilities (texts x languages), summed over its words."""
    n, labels = len(words.first) - 1, len(model.languages)
    sums, room, at = np.zeros((n, labels)), max(1, CELLS // labels), 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(words.first, words.first[at] + room, "right")) - 1)
        low, high = int(words.first[at]), int(words.first[upto])
        if high - low > room and labels > FEW:
            sums[at] = _sum_in_pieces(model, words, low, high, room)
        elif high > low:
            first = words.first[at : upto + 1] - low
            starts = np.zeros(high - low, bool)
            starts[first[:-1][np.diff(first) > 0]] = True
            alpha, beta, _ = chain(emissions(model, _span(words, low, high)), starts, model.moves, model.begin)
            np.add.at(sums, np.repeat(np.arange(at, upto), np.diff(first)), _shares(alpha, beta))
        at = upto
    return sums


def train(languages: list[str], stretches: list[tuple[int, str]], seed: int = 3) -> Model:
    """``stretches``: (language, words joined by spaces); up to three in a row make one training text."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(stretches))
    texts, gold, at = [], [], 0
    while at < len(order):
        some = [stretches[i] for i in order[at : at + int(rng.integers(1, 4))]]
        texts.append(" ".join(t for _, t in some))
        gold.append(some)
        at += len(some)
    words = split_words(pa.array(texts), WORD)
    y = np.concatenate([np.full(len(split_words(pa.array([t]), WORD).start), lang) for some in gold for lang, t in some])
    hashes = word_hashes(words, LOWER, 5)
    distinct, which, back, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    lexicon = np.sort(distinct[np.argsort(-count, kind="stable")[:LEXICON]])
    starts = np.zeros(len(words.start), bool)
    starts[words.first[:-1][np.diff(words.first) > 0]] = True
    labels, n = len(languages), len(y)
    shape = (1 << min(BITS, max(1, (WEIGHTS // labels).bit_length() - 1)), labels)
    kind = np.float64 if labels <= FEW else np.float32
    w, moves, begin = np.zeros(shape, kind), np.zeros((labels, labels)), np.zeros(labels)
    sums = [np.full_like(x, 1e-8) for x in (w, moves, begin)]
    grad = np.zeros_like(w)
    parts, low = [], 0  # runs of whole texts, their distinct words and features
    opening = np.append(np.flatnonzero(starts), n)
    while low < n:
        high = int(max(opening[np.searchsorted(opening, low, "right")], opening[np.searchsorted(opening, low + CELLS // labels, "right") - 1]))
        own, again = np.unique(back[low:high], return_inverse=True)
        parts.append((low, high, again, len(own), list(feature_blocks(words, which[own], distinct[own], lexicon, shape))))
        low = high
    rows = max(1, CELLS // labels)
    for _ in range(EPOCHS):
        grad[:] = 0
        moved, began, t = np.zeros_like(moves), np.zeros_like(begin), np.exp(moves - moves.max())
        for low, high, again, count, blocks in parts:
            alpha, beta, e = chain(block_scores(w, count, blocks)[again], starts[low:high], moves, begin)
            wrong = _shares(alpha, beta)
            gold_of = y[low:high]
            wrong[np.arange(high - low), gold_of] -= 1
            inner = np.flatnonzero(~starts[low:high])
            ahead = e[inner] * beta[inner]
            weight = ((alpha[inner - 1] @ t) * ahead).sum(axis=1, keepdims=True)
            moved += t * ((alpha[inner - 1] / weight).T @ ahead)
            np.subtract.at(moved, (gold_of[inner - 1], gold_of[inner]), 1)
            began += wrong[starts[low:high]].sum(axis=0)
            order = np.argsort(again, kind="stable")
            per_word = np.add.reduceat(wrong[order], np.searchsorted(again[order], np.arange(count)), axis=0)
            for a, _, owner, feature in blocks:
                order = np.argsort(feature, kind="stable")
                found, first = np.unique(feature[order], return_index=True)
                grad[found] += np.add.reduceat(per_word[a + owner[order]], first, axis=0)
        for x, g, total, decay in ((w, grad, sums[0], 1e-6), (moves, moved, sums[1], 0), (begin, began, sums[2], 0)):
            for at in range(0, len(x), rows):
                own = slice(at, at + rows)
                change = g[own] / n + decay * x[own]
                total[own] += change * change
                x[own] -= RATE * change / np.sqrt(total[own])
    return Model(languages, w.astype(np.float32), moves, begin, lexicon)


def stretches_of(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(lang, order, stretches) of the sampled training documents, one row an id; every language has one at least."""
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(training_side(F.col("doc_id")))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = known.where(F.col("text").rlike(LETTER)).select("lang", order.alias("order"), "text")
    scale = 1 << 30
    place = F.pmod("order", F.lit(scale))
    sizes = staged(known.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("least")), "language-sizes")
    each = min(train_docs, max(LEAST_DOCS, ALL_DOCS // max(1, sizes.count())))
    share = F.greatest(F.least(F.lit(scale), F.expr(f"{scale * each} div n") + 1), F.col("least") + 1)
    # One row a language, so the broadcast stays far below the model itself.
    drawn = known.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where(place < F.col("share"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(texts_of(batch.column("text")), WORD)
            out: tuple[list, list, list] = ([], [], [])
            for i, (lang, key) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("order").to_pylist())):
                own = [w[:LONGEST].decode(errors="ignore") for w in words.strings(i)]
                rng = np.random.default_rng(key & (1 << 63) - 1)
                places = rng.integers(0, max(1, len(own) - STRETCH + 1), STRETCHES if len(own) > STRETCH else 1).tolist()
                for column, value in zip(out, (lang, key, sorted(" ".join(own[at : at + STRETCH]) for at in places))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string()))],
                ["lang", "order", "stretches"],
            )

    found = drawn.select("lang", "order", "text").mapInArrow(cut, "lang string, order long, stretches array<string>")
    return found.groupBy("lang", "order").agg(F.min("stretches").alias("stretches"))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """A model, or None if no language can be learned."""
    rows = sorted((r.order, part, r.lang) for r in stretches_of(docs, train_docs).collect() for part in r.stretches)
    languages = sorted({lang for _, _, lang in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    return train(languages, [(number[lang], part) for _, part, lang in rows]) if rows else None


def predict(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and label means (texts x languages) of every text."""
    n = len(texts)
    if model is None:
        return [UNKNOWN] * n, np.zeros(n), np.zeros((n, 0))
    words = split_words(texts, WORD)
    count = np.diff(words.first)
    means = label_sums(model, words) / np.maximum(count, 1)[:, None]
    best = means.argmax(axis=1)
    score = np.clip(means[np.arange(n), best], 0, 1)
    letters = np.add.reduceat(np.append(_ASCII_LETTER[words.data], False).astype(np.int64), np.minimum(words.start, len(words.data))) if len(words.start) else []
    has = np.bincount(words.text_of, letters, n) > 0
    for i in np.flatnonzero(~has & (count > 0)).tolist():
        has[i] = any(c.isalpha() for c in texts[i].as_py())
    return [model.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())], np.where(has, score, 0.0), means


def with_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """``row`` (the input row without its text), lang_pred, score and ``shares`` (language and mean, for code-switched texts)."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model) if model else None)
    rows = packed(docs)
    kind = rows.schema[0].dataType.simpleString()
    pair = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*sent.value) if sent.value else None
        names = known.languages if known else []
        for batch in slices(batches):
            lang, score, means = predict(known, texts_of(batch.column("text")))
            shares = [[{"lang": a, "share": b} for a, b in zip(names, row) if b >= 0.01] for row in means.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(lang, pa.string()), pa.array(score), pa.array(shares, pair)],
                ["row", "lang_pred", "score", "shares"],
            )

    return rows.mapInArrow(label, f"row {kind}, lang_pred string, score double, shares array<struct<lang:string,share:double>>")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = with_language(docs.select("doc_id", "text"), fit(docs))
    return found.select(
        "row.doc_id", (~training_side(F.col("row.doc_id"))).alias("held_out"), "lang_pred", "score", "shares"
    )
