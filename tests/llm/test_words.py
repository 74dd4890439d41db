"""Spelling variants and importance resampling against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus_data import SF

from wardops.llm import importance, spelling
from wardops.llm.frames import table


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def near_pairs(words):
    """All pairs one edit apart, by every deletion."""
    known, found = set(words), set()
    holes = {}
    for w in known:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            holes.setdefault((i, rest), []).append(w)
            if rest in known and rest != w:
                found |= {(w, rest), (rest, w)}
    for group in holes.values():
        found |= set(itertools.permutations(group, 2))
    return found


@pytest.mark.parametrize("seed", range(6))
def test_pivots_are_cheapest_and_disjoint(seed):
    rng = random.Random(seed)
    places = sorted(rng.sample(range(20), 9))
    costs = [rng.randint(0, 9) for _ in places]
    for count in (1, 2, 3):
        sets = [c for c in itertools.combinations(range(9), count) if all(places[b] - places[a] >= 2 for a, b in zip(c, c[1:]))]
        chosen = spelling.pivots(places, costs, count)
        assert all(b - a >= 2 for a, b in zip(chosen, chosen[1:])) and len(chosen) == count
        assert sum(costs[places.index(p)] for p in chosen) == min(sum(costs[i] for i in c) for c in sets)


@pytest.mark.parametrize("letters, longest", [("ab", 9), ("abc", 8), ("aé", 12), ("a", 40)])
def test_near_words_equal_all_pairs(spark, letters, longest):
    """Few letters, so that bigrams repeat and tie within words."""
    rng = random.Random(len(letters) * longest)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, longest))) for _ in range(400)}
    words |= {w[:i] + w[i + 1 :] for w in list(words)[:60] for i in range(len(w)) if len(w) > 5}
    words |= {letters[0] * n for n in (5000, 5001, 5003)} | {letters[0] * 2500 + "z" + letters[0] * 2500}
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long")
    got = {(r.word, r.other) for r in spelling.near_words(frame).collect()}
    assert got == near_pairs(words)
    assert all(edits(a, b) == 1 for a, b in got if len(a) < 50)


def test_roots_of_long_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [(f"v{i}", "w7") for i in range(30)]
    roots = spelling.followed(spark.createDataFrame(links, "word string, form string")).collect()
    assert {r.word: r.root for r in roots} == {w: "w40" for w, _ in links}


def test_variants_follow_forms_by_count(spark):
    texts = ["colour " * 8 + "color " * 4 + "colors " * 2, "colour colours COLORS Straße straße", "colors Strasse " + "straße " * 5]
    docs = spark.createDataFrame([(None, t, 1) for t in texts], "doc_id long, text string, word int")
    kept = [w for t in texts for w in t.lower().split() if zlib.crc32(f":{w}".encode()) % 97]
    n = Counter(w for w in kept if len(w) >= 5)
    n = {w: c for w, c in n.items() if c >= 3}
    near = {w: [o for o in n if (w, o) in near_pairs(n)] for w in n}
    form = {}
    for w, others in near.items():
        best = max(others, key=lambda o: n[o], default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}
    assert got == {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}
    assert got["color"][:2] == ("colour", "colour") and got["colors"][1] in ("colour", "colors")


def test_crc_of_every_ngram():
    texts = ["", "  ", "One", "a-b_c  D", "é—x " + "y" * 300 + " z", "w " * 50, "12 3,4"]
    found, owner, words = importance.crc_buckets([t.encode() for t in texts], importance.gram_pattern(3), 3, 10_000)
    assert words.tolist() == [0, 0, 1, 4, 4, 50, 3] or words.tolist() == [len(importance.collapse(t.encode()).split()) for t in texts]
    for i, text in enumerate(texts):
        own = importance.collapse(text.encode()).split()
        grams = [b" ".join(own[a : a + n]) for n in (1, 2, 3) for a in range(len(own) - n + 1)]
        assert sorted(found[owner == i].tolist()) == sorted(zlib.crc32(g) % 10_000 for g in grams)


def test_draw_ranks_over_many_partitions(spark):
    """Ties in score, equal rows and ineligible rows, with more partitions than one."""
    rng = random.Random(3)
    rows = [(i if i % 11 else None, rng.randint(0, 40), 20 if i % 3 else 5) for i in range(3000)]
    rows += rows[:200]
    frame = spark.createDataFrame(rows, "doc_id long, score long, n_words long").repartition(7)
    got = importance.drawn(frame, "n_words >= 20", 10).collect()
    able = sorted((r for r in rows if r[2] >= 20), key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    take = len(able) * 10 // 100
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, take + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(d, s) for d, s, _ in able[:take]]
    assert Counter((r.doc_id, r.score, r.n_words) for r in got) == Counter(rows)


def test_gains_prefer_target_buckets(spark):
    found = {r.doc_id: r for r in importance.op12_importance(spark, SF).collect()}
    corpus = importance.bucket_counts(importance.features(table(spark, SF, "documents"), ["doc_id"]))
    target = importance.bucket_counts(importance.features(table(spark, SF, "benchmark"), []))
    gain = importance.gains(corpus, target)
    at = int(np.argmax(target))
    size = len(corpus)
    assert gain[at] == math.floor(1000 * math.log((target[at] + 1) * (corpus.sum() + size) / ((corpus[at] + 1) * (target.sum() + size))))
    assert sum(r.n_features for r in found.values()) == corpus.sum()
