"""Words of many texts at once, as offsets and 64-bit hashes in numpy arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .frames import SLICE_BYTES, text_bytes

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~_SPACE
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
LETTER_OR_DIGIT = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
#: Each byte with A-Z lower-cased.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SAME = np.arange(256, dtype=np.uint8)

_MASK = (1 << 64) - 1


class _Cache(dict):
    """Travels to tasks empty."""

    def __reduce__(self):
        return _Cache, ()


_POWERS = _Cache()


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # index of each text's first word, and the number of words

    @property
    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def strings(self, at: int) -> list[bytes]:
        low, high = self.first[at], self.first[at + 1]
        raw = self.data
        return [raw[a:b].tobytes() for a, b in zip(self.start[low:high].tolist(), self.end[low:high].tolist())]


def split_words(texts: pa.Array, inside: np.ndarray) -> Words:
    """Maximal runs of ``inside`` bytes; words never span two texts."""
    data, offsets = text_bytes(texts)
    if not len(data):
        nothing = np.zeros(0, np.int64)
        return Words(data, nothing, nothing, np.zeros(len(offsets), np.int64))
    full = np.diff(offsets) > 0
    mask = inside[data]
    before = np.concatenate(([False], mask[:-1]))
    before[offsets[:-1][full]] = False
    after = np.concatenate((mask[1:], [False]))
    after[offsets[1:][full] - 1] = False
    start = np.flatnonzero(mask & ~before)
    return Words(data, start, np.flatnonzero(mask & ~after) + 1, np.searchsorted(start, offsets))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def bases(seed: int) -> tuple[int, np.ndarray]:
    """An odd multiplier and a random value for each byte."""
    rng = np.random.default_rng(seed)
    return int(rng.integers(1 << 62)) << 1 | 1, rng.integers(0, _MASK, 256, np.uint64, endpoint=True)


def word_hashes(words: Words, fold: np.ndarray = SAME, seed: int = 1) -> np.ndarray:
    """A hash of each word's bytes, folded by a byte table; long inputs go in stretches."""
    base, values = bases(seed)
    values = values[fold]
    out = np.zeros(len(words.start), np.uint64)
    at = 0
    while at < len(out):
        low = words.start[at]
        upto = max(at + 1, int(np.searchsorted(words.end, low + SLICE_BYTES, "right")))
        high = words.end[upto - 1]
        up, down = _powers(base, int(high - low) + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[words.data[low:high]] * up[: high - low], out=total[1:])
        a, b = words.start[at:upto] - low, words.end[at:upto] - low
        out[at:upto] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        at = upto
    return out


def gram_hashes(hashes: np.ndarray, size: int, seed: int = 2) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words, by first word (runs may span texts)."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    base, _ = bases(seed)
    if size <= 8:
        n = len(hashes) - size + 1
        out = hashes[:n].copy()
        for j in range(1, size):
            out = out * np.uint64(base) + hashes[j : j + n]
        return mix(out)
    step = 1 << 18
    out = np.empty(len(hashes) - size + 1, np.uint64)
    up, down = _powers(base, step + size + 1)
    for at in range(0, len(out), step):
        part = hashes[at : at + step + size - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        n = len(part) - size + 1
        out[at : at + n] = mix((total[size:] - total[:n]) * down[:n])
    return out


def within_text(words: Words, size: int) -> np.ndarray:
    """For each run start of ``gram_hashes``: does the run end in the text it begins in?"""
    n = max(0, len(words.start) - size + 1)
    last = np.repeat(words.first[1:], np.diff(words.first))[:n]
    return np.arange(n) + size <= last
