r"""Personal data: exact patterns, and a character tagger that finds further spans.

Base spans come from four patterns (``BASE``), leftmost and non-overlapping per
kind, with a check of what matched.  The tagger is a character-level bidirectional
LSTM whose label scores feed a linear-chain CRF with learned transitions, trained in
numpy on windows labelled with base spans and on copies of them in which each base
span is written another way (``rewritten``): "at" and "dot" spelled out or bracketed,
other separators, full-width characters, digits as words.  Windows are laid, half
overlapping, over the neighbourhood of all characters and words that a span of
these kinds holds: digits and ``@`` of either width, "dot", bracketed "at", five or
more digits in words; the whole text is searched for them.  Each window is decoded by
Viterbi; each character takes its label from the window that holds it most centrally,
and spans are read off the reconciled labels of the text.  A found span is added if
it overlaps no base span, is certain enough (``CERTAIN``) and, read back to its plain
form, passes the check of its kind; base spans always stay.

Training reads at most ``TRAIN_WINDOWS`` windows, those with the smallest hashes
of document and place, those with a span ``FAVOUR`` times as readily; windows are
what the driver collects.  Forms that no pattern labels (``_UNLABELLED``) may be
personal data, so windows that meet one in its original place are not learned from.  Tagging is one pass
over all documents without a shuffle; its work follows the places of a text where
windows are laid.

Defined cases: null and empty texts have no spans; without a base span to learn
from nothing is added; repeated rows and ids are tagged alike; an empty table gives
an empty result.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import packed, slices, table, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

WIDTH = 64
STRIDE = 32
MARGIN = 20
TRAIN_WINDOWS = 4800
#: How many times likelier a window with a span is to be drawn than one without.
FAVOUR = 10
#: Copies of a text with base spans in which they are written another way.
REWRITES = 3
STEPS = 600
BATCH = 96
EMBED = 16
HIDDEN = 24
RATE = 0.01
CERTAIN = 0.95
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
CHARS = 130  # 0: past the end, 1-128: ASCII, 129: any other

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_NUMBER = f"(?:{'|'.join(_NUMBER_WORDS)})"
_SPELLED = rf"[\uFF10-\uFF19\uFF20]|[\[({{] ?(?:at|dot|\.) ?[\])}}]|\bdot\b|\b{_NUMBER}(?:[ -]{_NUMBER}){{4,}}\b"
_ANCHOR = re.compile(f"[0-9@]|{_SPELLED}", re.IGNORECASE)
#: Forms that patterns do not label; what is near them teaches nothing.
_UNLABELLED = re.compile(rf"{_SPELLED}| @ |[0-9](?:[./_]| [/-] |  )[0-9]{{4}}|\+[0-9]+/|\b00[0-9]", re.IGNORECASE)
_AT_WORD = re.compile(r" *[\[({] *(?:at|@) *[\])}] *| +at +| *@ *", re.IGNORECASE)
_DOT_WORD = re.compile(r" *[\[({] *(?:dot|\.) *[\])}] *| +dot +| *\. *", re.IGNORECASE)
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: str) -> bool:
    return 8 <= len(_digits(text)) <= 15


def base_spans(text: str) -> list[Span]:
    """All pattern matches that pass their check, by kind as listed, then start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:  # from each @ outwards, so that long runs without one cost nothing
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (tail := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, tail.end()))
            done = tail.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    for kind, pattern, holds in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(m[0])]
    return out


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where((points >= 0xFF01) & (points <= 0xFF5E), points - 0xFEE0, points)  # full width reads as plain
    return np.where(points < 128, points + 1, 129).astype(np.int16)


def window_starts(text: str) -> list[int]:
    """Starts of the windows that cover every anchor with its neighbourhood."""
    regions: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        low, high = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if regions and low <= regions[-1][1]:
            regions[-1][1] = high
        else:
            regions.append([low, high])
    starts = []
    for low, high in regions:
        spare = WIDTH - (high - low)
        at = max(0, low - max(0, spare) // 2)
        starts.append(at)
        while at + WIDTH < high:
            at += STRIDE
            starts.append(at)
    return starts


def cut_windows(values: np.ndarray, starts: list[int]) -> np.ndarray:
    padded = np.concatenate((values, np.zeros(WIDTH, values.dtype)))
    return padded[np.asarray(starts)[:, None] + np.arange(WIDTH)]


def label_text(length: int, spans: list[Span]) -> np.ndarray:
    """Begin and inside labels; an earlier kind covers a later one."""
    out = np.zeros(length, np.int8)
    for kind, low, high in reversed(spans):
        k = 1 + 2 * KINDS.index(kind)
        out[low:high] = k + 1
        out[low] = k
    return out


class Tagger:
    """Bidirectional LSTM and CRF; ``p`` holds all parameters."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def fresh(cls, seed: int = 11) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        p = {"embed": rng.normal(0, 0.3, (CHARS, EMBED)), "out": draw(2 * HIDDEN, LABELS), "bias": np.zeros(LABELS)}
        for d in "fb":
            p[f"x{d}"], p[f"h{d}"], p[f"b{d}"] = draw(EMBED, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN)
            p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        p["move"] = np.zeros((LABELS, LABELS))
        return cls(p)

    def _run(self, x: np.ndarray, d: str):
        """States of one direction over (batch, time); keeps what learning needs."""
        p, (n, time) = self.p, x.shape
        table = p["embed"] @ p[f"x{d}"] + p[f"b{d}"]
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        states, kept = np.empty((time, n, HIDDEN)), []
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            z = table[x[:, t]] + h @ p[f"h{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, last = h, c
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            states[t] = h
            kept.append((t, i, f, o, g, last, squashed, before))
        return states, kept

    def emissions(self, x: np.ndarray):
        forward, kept_f = self._run(x, "f")
        backward, kept_b = self._run(x, "b")
        both = np.concatenate((forward, backward), axis=2)
        return both @ self.p["out"] + self.p["bias"], both, kept_f, kept_b

    def _messages(self, e: np.ndarray):
        """Scaled forward and backward messages of the CRF over (time, batch, labels)."""
        move = np.exp(self.p["move"])
        w = np.exp(e - e.max(axis=2, keepdims=True))
        alpha, beta = np.empty_like(w), np.empty_like(w)
        alpha[0] = w[0] / w[0].sum(axis=1, keepdims=True)
        for t in range(1, len(w)):
            a = alpha[t - 1] @ move * w[t]
            alpha[t] = a / a.sum(axis=1, keepdims=True)
        beta[-1] = 1 / LABELS
        for t in range(len(w) - 2, -1, -1):
            b = (w[t + 1] * beta[t + 1]) @ move.T
            beta[t] = b / b.sum(axis=1, keepdims=True)
        return alpha, beta, w, move

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean negative log-likelihood of labels y (batch, time)."""
        p, n = self.p, len(x)
        e, both, kept_f, kept_b = self.emissions(x)
        alpha, beta, w, move = self._messages(e)
        wrong = alpha * beta
        wrong /= wrong.sum(axis=2, keepdims=True)
        wrong -= np.eye(LABELS)[y.T]
        pair = alpha[:-1, :, :, None] * move * (w[1:] * beta[1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        moved = pair.sum(axis=(0, 1))
        np.subtract.at(moved, (y[:, :-1], y[:, 1:]), 1)
        g = {"move": moved / n, "bias": wrong.sum(axis=(0, 1)) / n, "out": np.tensordot(both, wrong, ((0, 1), (0, 1))) / n}
        down = wrong @ p["out"].T / n
        g["embed"] = np.zeros_like(p["embed"])
        for d, kept, part in (("f", kept_f, down[:, :, :HIDDEN]), ("b", kept_b, down[:, :, HIDDEN:])):
            per_char, gh = np.zeros((CHARS, 4 * HIDDEN)), np.zeros_like(p[f"h{d}"])
            dh, dc, one = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.eye(CHARS)
            for t, i, f, o, gg, last, squashed, before in reversed(kept):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate((dc * gg * i * (1 - i), dc * last * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - gg**2)), axis=1)
                per_char += one[x[:, t]].T @ dz
                gh += before.T @ dz
                dh, dc = dz @ p[f"h{d}"].T, dc * f
            g[f"x{d}"], g[f"h{d}"], g[f"b{d}"] = p["embed"].T @ per_char, gh, per_char.sum(axis=0)
            g["embed"] += per_char @ p[f"x{d}"].T
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 12) -> Tagger:
        """Adam over shuffled batches, as many steps for few windows as for many; digits and letters are redrawn in a third of the windows."""
        rng = np.random.default_rng(seed)
        first, second, step = {}, {}, 0
        while step < steps:
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                step += 1
                for name, g in self.gradients(redrawn(x[some], rng), y[some]).items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                    second[name] = 0.99 * second.get(name, 0) + 0.01 * g * g
                    self.p[name] -= RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi labels and the probability of each label, (batch, time)."""
        e, *_ = self.emissions(x)
        alpha, beta, _, _ = self._messages(e)
        sure = alpha * beta
        sure /= sure.sum(axis=2, keepdims=True)
        best, back = e[0], np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            paths = best[:, :, None] + self.p["move"]
            back[t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + e[t]
        labels = np.empty(x.shape, np.int8)
        labels[:, -1] = best.argmax(axis=1)
        rows = np.arange(len(x))
        for t in range(len(e) - 1, 0, -1):
            labels[:, t - 1] = back[t][rows, labels[:, t]]
        return labels, np.take_along_axis(sure.transpose(1, 0, 2), labels[:, :, None].astype(np.int64), 2)[:, :, 0]


def redrawn(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A third of the windows with other digits, and with other small letters where an ``@`` and no word marks a span."""
    out = x.copy()
    some = rng.random(len(x)) < 0.3
    marked = (x == ord("@") + 1).any(axis=1)
    for low, high, where in ((49, 58, some), (98, 123, some & marked)):
        at = (x >= low) & (x < high) & where[:, None] & (rng.random(x.shape) < 0.5)
        out[at] = rng.integers(low, high, int(at.sum()))
    return out


def read_spans(labels: np.ndarray) -> list[Span]:
    out, at = [], 0
    while at < len(labels):
        if labels[at] % 2 == 1:
            end = at + 1
            while end < len(labels) and labels[end] == labels[at] + 1:
                end += 1
            out.append((KINDS[(labels[at] - 1) // 2], at, end))
            at = end
        else:
            at += 1
    return out


def plain(kind: str, text: str) -> str:
    """A span in its plain form: full width, spelled-out characters and other separators undone."""
    text = text.translate(_WIDE)
    if kind == "email":
        return _DOT_WORD.sub(".", _AT_WORD.sub("@", text))
    if kind == "ip":
        return _DOT_WORD.sub(".", text)
    if kind == "phone":
        text = re.sub(_NUMBER, lambda m: str(_NUMBER_WORDS.index(m[0].lower())), text, flags=re.IGNORECASE)
        text = re.sub(r"^(?:plus |00)", "+", text)
    return text


def plausible(kind: str, text: str) -> bool:
    read = plain(kind, text)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", read))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", read)) and _is_ip(read)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[\x20./_-]{0,3}[0-9])+", read)) and _is_card(read)
    return bool(re.fullmatch(r"\+[0-9](?:[\x20()./-]{0,3}[0-9])+", read)) and _is_phone(read)


def rewritten(kind: str, text: str, rng: np.random.Generator) -> str:
    """A base span written another way, so that its pattern no longer finds it."""
    def one_of(*forms):
        return forms[int(rng.integers(len(forms)))]

    def widened(value: str) -> str:
        return "".join(chr(ord(c) + 0xFEE0) if c.isdigit() or c in "@." else c for c in value)

    if kind == "email":
        local, domain = text.split("@", 1)
        at, dot = one_of(
            (" at ", " dot "), (" AT ", " DOT "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "),
            ("[at]", "[dot]"), (" [at] ", "."), (" (at) ", "."), ("(at)", "."), (" @ ", " . "), (" @ ", "."), ("\uff20", "\uff0e"),
        )
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return one_of(widened(text), *(text.replace(".", s) for s in (" . ", "[.]", "(.)", " dot ", "[dot]", " (dot) ")))
    digits = _digits(text)
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return one_of(widened(digits), *(s.join(fours) for s in (".", "/", " / ", "_", "  ", " - ")))
    parts = re.findall("[0-9]+", text)
    words = " ".join(_NUMBER_WORDS[int(d)] for d in digits)
    return one_of("+" + "/".join(parts), "00" + " ".join(parts), "00" + "-".join(parts), widened(digits).join(("+", "")), "plus " + words, "\uff0b" + widened(" ".join(parts)))


def with_rewrites(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with every span rewritten, and where the rewritten ones lie; of overlapping spans the first counts."""
    out, moved, at, size = [], [], 0, 0
    for kind, low, high in sorted(spans, key=lambda s: s[1]):
        if low < at:
            continue
        form = rewritten(kind, text[low:high], rng)
        size += low - at
        moved.append((kind, size, size + len(form)))
        size += len(form)
        out += [text[at:low], form]
        at = high
    return "".join([*out, text[at:]]), moved


def more_spans(tagger: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Per text the spans that the tagger adds to the base spans."""
    starts = [window_starts(t) for t in texts]
    flat = [w for t, s in zip(texts, starts) if s for w in (cut_windows(codes(t), s),)]
    if not flat:
        return [[] for _ in texts]
    windows = np.concatenate(flat)
    decoded = [tagger.decode(windows[a : a + 1024]) for a in range(0, len(windows), 1024)]
    labels, sure = (np.concatenate(x) for x in zip(*decoded))
    out, row = [], 0
    middle = WIDTH // 2 - np.abs(np.arange(WIDTH) - (WIDTH - 1) / 2)
    for text, own, known in zip(texts, starts, base):
        taken, chance, central = np.zeros(len(text), np.int8), np.zeros(len(text)), np.full(len(text), -1.0)
        for at in own:
            n = min(WIDTH, len(text) - at)
            closer = np.flatnonzero(middle[:n] > central[at : at + n])
            taken[at + closer], chance[at + closer] = labels[row, closer], sure[row, closer]
            central[at + closer] = middle[closer]
            row += 1
        used = np.zeros(len(text) + 1, bool)
        for _, low, high in known:
            used[low:high] = True
        out.append([
            (kind, low, high) for kind, low, high in read_spans(taken)
            if not used[low:high].any() and chance[low:high].mean() >= CERTAIN and plausible(kind, text[low:high])
        ])
    return out


def training_windows(docs: DataFrame, windows: int = TRAIN_WINDOWS) -> DataFrame:
    """(order, chars, labels) of the windows with the smallest hashes."""
    rows = docs.where(F.col("text").rlike(r"[0-9@]|\bdot\b")).select(F.xxhash64("doc_id", "text").alias("key"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            order, chars, labels = [], [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                rng = np.random.default_rng(key & (1 << 63) - 1)
                spans = base_spans(text)
                versions = [(text, spans), *(with_rewrites(text, spans, rng) for _ in range(REWRITES if spans else 0))]
                unsure = [m.span() for m in _UNLABELLED.finditer(text) if not any(a <= m.start() < b for _, a, b in spans)]
                for version, own in versions:
                    starts = window_starts(version)
                    if unsure:
                        starts = [] if version is not text else [a for a in starts if all(a + WIDTH <= low or a - MARGIN >= high for low, high in unsure)]
                    shift = [max(0, s - int(j)) for s, j in zip(starts, rng.integers(0, MARGIN, len(starts)))]
                    if not shift:
                        continue
                    y = cut_windows(label_text(len(version), own), shift)
                    drawn = rng.integers(0, 1 << 62, len(shift))
                    order += np.where(y.any(axis=1), drawn // FAVOUR, drawn).tolist()
                    chars += [w.astype(np.uint8).tobytes() for w in cut_windows(codes(version), shift)]
                    labels += [w.astype(np.uint8).tobytes() for w in y]
            yield pa.RecordBatch.from_arrays(
                [pa.array(order, pa.int64()), pa.array(chars, pa.binary()), pa.array(labels, pa.binary())], ["order", "chars", "labels"]
            )

    found = rows.mapInArrow(cut, "order long, chars binary, labels binary").dropDuplicates(["chars"])
    return found.orderBy("order", "chars").limit(windows)


def fit(docs: DataFrame, windows: int = TRAIN_WINDOWS) -> Tagger | None:
    rows = training_windows(docs, windows).collect()
    if not any(any(r.labels) for r in rows):
        return None
    matrix = lambda name: np.frombuffer(b"".join(bytes(r[name]) for r in rows), np.uint8).reshape(-1, WIDTH)
    return Tagger.fresh().train(matrix("chars").astype(np.int64), matrix("labels").astype(np.int64))


def with_spans(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``row`` (the input row without its text), ``base`` and ``added``: arrays of (kind, start, end)."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger.p if tagger else None)
    rows = packed(docs)
    kind = rows.schema[0].dataType.simpleString()
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("low", pa.int64()), ("high", pa.int64())]))
    listed = lambda spans: [{"kind": k, "low": a, "high": b} for k, a, b in spans]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tagger(sent.value) if sent.value else None
        for batch in slices(batches):
            texts = texts_of(batch.column("text")).to_pylist()
            at = [i for i, t in enumerate(texts) if _ANCHOR.search(t)]
            some = [texts[i] for i in at]
            base = [base_spans(t) for t in some]
            more = more_spans(known, some, base) if known else [[]] * len(at)
            found, added = [[] for _ in texts], [[] for _ in texts]
            for i, b, m in zip(at, base, more):
                found[i], added[i] = listed(b), listed(m)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(found, arrow), pa.array(added, arrow)], ["row", "base", "added"]
            )

    spans = "array<struct<kind:string,low:long,high:long>>"
    return rows.mapInArrow(find, f"row {kind}, base {spans}, added {spans}")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, fit(docs))
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        keyed = F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("r"), s["low"].alias("low"), s["high"].alias("high"), s["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["low"], s["high"])), ",")

    return found.select(
        "row.doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
    )
