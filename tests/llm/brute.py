"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash

SPACE = r"[^\x20\x09-\x0D]+"
CAPITALS = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(SPACE, text or "")


def fingerprint(text, size=3):
    w = words((text or "").translate(CAPITALS))
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, radius=2):
    """(doc_id, fingerprint, component) of rows (doc_id, text)."""
    prints = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[find(p)] = min(doc, least.get(find(p), doc))
    return [(doc, f"{p:016x}", least.get(find(p))) for (doc, _), p in zip(rows, prints)]


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(CAPITALS))


def contaminated(rows, items, window=10):
    """doc_id of rows (doc_id, text) that hold a window of an item."""
    runs = {}
    for text in items:
        w = benchmark_words(text)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            runs.setdefault(n, set()).add(tuple(w[a : a + n]))
    out = set()
    for doc, text in rows:
        w = benchmark_words(text)
        if any(tuple(w[a : a + n]) in found for n, found in runs.items() for a in range(len(w) - n + 1)):
            out.add(doc)
    return out


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def holds(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind != "phone" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def span_hash(spans):
    return hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()
