"""Every query against its SQL or a plain version, on test data and on odd rows."""

from __future__ import annotations

import hashlib
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from corpus_data import SF
from pyspark.sql import functions as F

from wardops.llm import lines, mixing, neighbours, pii, quality, registry, sharding, simhash, substrings, winnowing
from wardops.llm.frames import table


def rows_of(frame, columns=None):
    return sorted(map(tuple, frame.select(columns or frame.columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
@pytest.mark.parametrize("where", ["data", "edge"])
def test_query_equals_sql(spark, duck, edge_dir, name, where):
    folder = {"data": SF, "edge": edge_dir}[where]
    frame = registry.QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    found = duck(folder).sql(registry.SQL[name])
    assert sorted(found.columns) == columns
    assert rows_of(frame, columns) == sorted(found.project(", ".join(columns)).fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert registry.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", ["op4_language", "op9_quality", "op10_mixing"])
def test_one_row_per_document(spark, edge_dir, name):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id")
    assert rows_of(registry.QUERIES[name](spark, edge_dir).select("doc_id")) == rows_of(docs)


@pytest.mark.parametrize("where", ["data", "edge"])
def test_simhash_equals_all_pairs(spark, edge_dir, where):
    folder = {"data": SF, "edge": edge_dir}[where]
    docs = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    assert rows_of(simhash.op6_simhash(spark, folder)) == sorted(brute.components(docs), key=repr)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    values = np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, k))) for k in (0, 1, 2, 3, 4) for _ in range(2)])
    cell = np.sort(rng.integers(0, 3, len(values)))
    found = {tuple(sorted((int(i), int(j)))) for a, b in simhash.near_links(values, cell, radius) for i, j in zip(a, b)}
    n = range(len(values))
    assert found == {(i, j) for i in n for j in n if i < j and cell[i] == cell[j] and (int(values[i]) ^ int(values[j])).bit_count() <= radius}


def test_wide_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 2)
    rng = np.random.default_rng(1)
    near = [int(0x1234 << 48) ^ sum(1 << int(b) for b in rng.integers(0, 40, 3)) for _ in range(60)]
    prints = spark.createDataFrame([(i, "", v) for i, v in enumerate(sorted(set(near)))], "doc_id long, text_key string, fp long")
    got = {r.fp: r["first"].doc_id for r in simhash.component_of(prints).collect()}
    ids = {r.fp: r.doc_id for r in prints.collect()}
    root = {v: v for v in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in ids:
        for b in ids:
            if (a ^ b).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {v: min(ids[u] for u in ids if find(u) == find(v)) for v in ids}


def test_neighbours_in_small_blocks(spark, duck, monkeypatch):
    for name, value in (("BLOCK", 70), ("QUERY_BLOCK", 7), ("TILE", 32)):
        monkeypatch.setattr(neighbours, name, value)
    assert rows_of(neighbours.op1_neighbours(spark, SF)) == sorted(duck(SF).sql(registry.SQL["op1_neighbours"]).fetchall(), key=repr)


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 16)) * rng.lognormal(0, 3, (50, 1)), rng.normal(size=(60, 16))
    got = neighbours.nearest_in_cell(np.arange(50), a, np.arange(100, 160), b, 5)
    for q in range(50):
        best = np.argsort(-(b @ a[q]), kind="stable")[:5]
        assert {c for i, c, _ in got if i == q} >= {100 + int(j) for j in best}


def test_lookup_table_is_balanced_and_stable():
    full, less = sharding.lookup_table(sharding.SHARDS), sharding.lookup_table(sharding.SHARDS[1:])
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1
    moved = sum(a != 0 and sharding.SHARDS[a] != sharding.SHARDS[1:][b] for a, b in zip(full, less))
    assert moved < 0.25 * len(full)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "b"], 10)


def test_sharding_keeps_every_column_and_needs_no_python(spark, edge_dir):
    placed = sharding.assign_shards(spark.read.parquet(f"{edge_dir}/documents.parquet"))
    assert {"text", "lang", "key", "row"} <= set(placed.columns)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange hash", plan)


def test_line_index_can_be_undone(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    first, second = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    start = lines.LineIndex.empty(spark, shards=5).insert(first)
    both = start.insert(second)
    whole = lines.LineIndex.empty(spark, shards=5).insert(docs)
    assert rows_of(both.refs) == rows_of(whole.refs)
    assert rows_of(both.clean(docs)) == rows_of(whole.clean(docs))
    back = both.delete(second)
    assert rows_of(back.refs) == rows_of(start.refs)
    assert rows_of(back.clean(first)) == rows_of(start.clean(first))
    again = both.insert(second)
    assert rows_of(again.refs) == rows_of(both.refs)


def test_line_shards_grow_with_the_repeated_keys(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    plain = lines.LineIndex.empty(spark, shards=5).insert(docs)
    small = lines.LineIndex.empty(spark, shards=1, shard_keys=3)
    grown = small.insert(docs.where("doc_id % 2 = 0")).insert(docs.where("doc_id % 2 = 1"))
    assert grown.shards * 3 >= grown.refs.where("n_docs >= 3").count() > 3
    assert grown.filters.select("shard").distinct().count() > 1
    assert rows_of(grown.clean(docs)) == rows_of(plain.clean(docs))


def test_line_filters_are_only_a_shortcut(spark, edge_dir, monkeypatch):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    index = lines.LineIndex.empty(spark).insert(docs)
    want = rows_of(index.clean(docs))
    monkeypatch.setattr(lines, "FILTER_BYTES", -1)
    assert rows_of(index.clean(docs)) == want


def test_shards_agree_inside_and_outside_tasks(spark):
    keys = [hashlib.md5(str(n).encode()).digest() for n in range(500)]
    frame = spark.createDataFrame([(k,) for k in keys], "key binary")
    for shards in (1, 64, 1000):
        outside = {bytes(r.key): r.s for r in frame.select("key", lines.shard_of(F.col("key"), shards).alias("s")).collect()}
        assert [outside[k] for k in keys] == lines.shards_of(keys, shards).tolist()


@pytest.mark.parametrize("sent", [True, False])
def test_false_hits_do_not_grow_with_the_shards(spark, monkeypatch, sent):
    """A line that is not repeated meets the filters of one shard, however many there are."""
    text = F.concat(F.lit("a line that stands in three documents "), F.col("line"))
    lone = F.concat(F.lit("a line that stands in one document "), F.col("id"))
    copies = spark.range(9000).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 3).alias("line")).select("doc_id", text.alias("text"))
    alone = spark.range(20_000).select((F.col("id") + 9000).alias("doc_id"), lone.alias("text"))
    docs = copies.union(alone).repartition(4)
    if not sent:
        monkeypatch.setattr(lines, "FILTER_BYTES", -1)
    for shards in (4, 512):
        index = lines.LineIndex.empty(spark, shards=shards).insert(docs)
        bits = {}
        for r in index.filters.collect():
            bits.setdefault(r.shard, []).append(r.bits)
        found = (
            lines.postings(docs, 20, spark.sparkContext.broadcast(bits), shards) if sent else index._probed(lines.postings(docs, 20))
        )
        through = found.select("doc").distinct().count()
        assert 9000 <= through <= 9000 + 20_000 * 0.01


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, np.uint64))
    found = lines.CuckooFilter.sized(len(keys))
    assert found.insert(keys) and found.contains(keys).all()
    assert found.contains(rng.integers(0, 1 << 63, 20_000, np.uint64)).mean() < 0.01
    assert found.delete(keys[::2]).all() and found.contains(keys[1::2]).all()
    assert found.delete(keys[1::2]).all() and not found.table.any()
    assert not lines.CuckooFilter.sized(1).insert(keys)


def test_passages_by_every_way(spark, duck, monkeypatch):
    want = sorted(duck(SF).sql(registry.SQL["op5_substrings"]).fetchall(), key=repr)
    for change in ({"HEAVY": 4, "LEAST_OFTEN": 3}, {"MAX_WIDTH": 1 << 16, "HEAVY": 10**9}):
        with monkeypatch.context() as m:
            for name, value in change.items():
                m.setattr(substrings, name, value)
            assert rows_of(substrings.op5_substrings(spark, SF)) == want


def test_winnowing_in_many_slices(spark, edge_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{edge_dir}/{t}.parquet") for t in ("documents", "benchmark"))

    def found():
        rows = winnowing.contamination(docs, items).select("row.doc_id", "text_key", "n_words", F.sort_array("items"), "hits").collect()
        return sorted((repr(r[:3]), r[3], sorted({i for h in r.hits for i in range(h.low, h.high)})) for r in rows)

    want = found()
    assert any(r[1] for r in want)
    monkeypatch.setattr(winnowing, "SLICE_WORDS", 20)
    monkeypatch.setattr(winnowing, "SEGMENT", 25)
    assert found() == want


def test_pii_base_spans(spark, edge_dir):
    for folder in (SF, edge_dir):
        texts = table(spark, folder, "documents").select("doc_id", "text").collect()
        want = []
        for r in texts:
            spans = brute.base_spans(r.text)
            want.append((r.doc_id, *(sum(k == s[0] for s in spans) for k in pii.KINDS), brute.span_hash(spans)))
        got = pii.op7_pii(spark, folder)
        assert rows_of(got.drop("spans")) == sorted(want, key=repr)
        bases = {(r.doc_id, "%s:%d:%d" % s) for r in texts for s in brute.base_spans(r.text)}
        assert bases <= {(r.doc_id, s) for r in got.collect() for s in r.spans.split(",")}


def test_pii_tagger_finds_held_out_spans(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    side = F.col("doc_id") % 2 == 0
    tagger = pii.fit(docs.where(side))
    texts = [r.text for r in docs.where(~side).where(F.col("text").rlike("[0-9@]")).limit(300).collect()]
    base = [set(pii.base_spans(t)) for t in texts]
    found = [set(s) for s in pii.more_spans(tagger, texts, [[] for _ in texts])]
    hit, total, extra = (sum(map(len, x)) for x in ([a & b for a, b in zip(base, found)], base, [b - a for a, b in zip(base, found)]))
    assert hit >= 0.6 * total and extra <= 0.05 * total


def test_rewritten_spans_pass_their_check_and_escape_the_patterns():
    rng = np.random.default_rng(4)
    for kind, span in (("email", "a.b+c@mail-7.example.com"), ("ip", "10.0.255.3"), ("card", "4111 1111 1111 1111"), ("phone", "+44 (20) 7946-0958")):
        forms = {pii.rewritten(kind, span, rng) for _ in range(200)}
        assert len(forms) >= 6
        for form in forms:
            text, [(_, low, high)] = pii.with_rewrites(f"write {span} now", [(kind, 6, 6 + len(span))], np.random.default_rng(len(form)))
            assert text[:low] == "write " and text[high:] == " now"
            assert pii.plausible(kind, form) and (kind, 0, len(form)) not in pii.base_spans(form), form
            assert pii.window_starts(f"some words, then {form} and more")
    for kind, span in (("email", "at noon dot"), ("ip", "300 dot 1 dot 1 dot 1"), ("card", "4111.1111.1111.1112"), ("phone", "plus one two"), ("email", "end.\nthe [at] b.com")):
        assert not pii.plausible(kind, span)


def test_pii_tagger_finds_planted_spans_of_other_forms(spark):
    """Held out: other documents, other draws; nothing is found in texts without personal data."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    tagger = pii.fit(docs.where("doc_id % 2 = 0"))
    texts = [r.text for r in docs.where("doc_id % 2 = 1").where("text IS NOT NULL").collect()]
    rng = np.random.default_rng(99)
    planted = [pii.with_rewrites(t, spans, rng) for t in texts if (spans := pii.base_spans(t)) for _ in range(2)]
    found = pii.more_spans(tagger, [t for t, _ in planted], [pii.base_spans(t) for t, _ in planted])
    hit, total = sum(len(set(f) & set(own)) for f, (_, own) in zip(found, planted)), sum(len(own) for _, own in planted)
    wrong = sum(len(set(f) - set(own)) for f, (_, own) in zip(found, planted))
    assert total > 500 and hit >= 0.9 * total and wrong <= 0.02 * total
    clean = [t for t in texts if not pii.base_spans(t)]
    assert not any(pii.more_spans(tagger, clean, [[] for _ in clean]))


def test_pii_adds_planted_spans_in_the_query(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    rng = np.random.default_rng(7)
    some = [(r.doc_id, *pii.with_rewrites(r.text, spans, rng)) for r in docs.where("doc_id % 20 = 1 AND text IS NOT NULL").collect() if (spans := pii.base_spans(r.text))]
    planted = spark.createDataFrame([(d, t) for d, t, _ in some], docs.schema)
    rest = docs.join(planted.select("doc_id"), "doc_id", "left_anti")
    rest.unionByName(planted).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: set(r.spans.split(",")) for r in pii.op7_pii(spark, str(tmp_path)).collect()}
    want = [(d, "%s:%d:%d" % s) for d, _, spans in some for s in spans]
    assert len(want) > 20 and sum(s in got[d] for d, s in want) >= 0.9 * len(want)


def test_pii_gradient():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger.fresh()
    tagger.p["move"] = rng.normal(0, 0.3, tagger.p["move"].shape)
    x, y = rng.integers(0, pii.CHARS, (2, pii.WIDTH)), rng.integers(0, pii.LABELS, (2, pii.WIDTH))

    def loss():
        e, *_ = tagger.emissions(x)
        total = 0.0
        for b in range(len(x)):
            a, gold = e[0, b], e[0, b, y[b, 0]]
            for t in range(1, pii.WIDTH):
                a = np.log(np.exp(a[:, None] + tagger.p["move"]).sum(0)) + e[t, b]
                gold += tagger.p["move"][y[b, t - 1], y[b, t]] + e[t, b, y[b, t]]
            total += np.log(np.exp(a - a.max()).sum()) + a.max() - gold
        return total / len(x)

    g = tagger.gradients(x, y)
    for name, at in (("embed", (int(x[0, 5]), 3)), ("xb", (2, 50)), ("hf", (4, 80)), ("out", (30, 2)), ("move", (1, 4)), ("bf", (5,))):
        kept = tagger.p[name][at]
        tagger.p[name][at] = kept + 1e-5
        up = loss()
        tagger.p[name][at] = kept - 1e-5
        down = loss()
        tagger.p[name][at] = kept
        assert abs(g[name][at] - (up - down) / 2e-5) < 1e-4


def test_language_accuracy_on_held_out(spark):
    from wardops.llm import language

    folder = "/root/testdata/sf0.1"
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    got = language.op4_language(spark, folder).join(docs, "doc_id").where("held_out AND lang IS NOT NULL")
    right, total, low, high = got.agg(
        F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")
    ).first()
    assert right >= 0.97 * total and 0 <= low and high <= 1


def test_language_of_odd_texts(spark, edge_dir):
    from wardops.llm import language

    got = {r.doc_id: r for r in language.op4_language(spark, edge_dir).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (4, 5, 6, 18))
    assert all(got[d].lang_pred in ("en", "de") for d in (1, 7, 11, 17))


def test_language_chain_equals_one_by_one():
    from wardops.llm import language

    rng = np.random.default_rng(4)
    scores, moves, begin = rng.normal(size=(150, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    starts = np.zeros(150, bool)
    starts[[0, 7, 8, 140]] = True
    a, b, _ = language.forward_backward(scores, starts, moves, begin)
    got = a * b / (a * b).sum(axis=1, keepdims=True)
    borders = [0, 7, 8, 140, 150]
    for low, high in zip(borders, borders[1:]):
        e, t = np.exp(scores[low:high]), np.exp(moves)
        f, r = [np.exp(begin) * e[0]], [np.ones(3)]
        for i in range(1, high - low):
            f.append(f[-1] @ t * e[i])
        for i in range(high - low - 1, 0, -1):
            r.insert(0, t @ (e[i] * r[0]))
        both = np.array(f) * np.array(r)
        assert np.allclose(got[low:high], both / both.sum(axis=1, keepdims=True))


def test_quality_on_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    got = quality.op9_quality(spark, folder).join(labels, "doc_id").where("held_out")
    good, kept, bad, gone = got.agg(
        F.sum("quality"), F.sum(F.col("quality") * F.col("predicted")), F.sum(1 - F.col("quality")),
        F.sum((1 - F.col("quality")) * (1 - F.col("predicted"))),
    ).first()
    assert kept >= 0.99 * good and gone >= 0.9 * bad


def test_quality_scores_are_sparse_dot_products():
    texts = pa.array(["a b a", "", "Ab!! Ab!! cd"])
    text, feature, value = quality.features(texts)
    assert np.allclose(np.bincount(text, value**2, 3), [1, 0, 1], atol=1e-5)
    model = quality.Model(0.5, np.linspace(-1, 1, quality.DIMENSIONS).astype(np.float32))
    margins = [0.5 + float(model.weights[feature[text == i]] @ value[text == i]) for i in range(3)]
    assert np.allclose(model.scores(texts), 1 / (1 + np.exp(-np.array(margins))), atol=1e-6)


def test_targets_by_hand():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200, 250 / 3, 500 / 3]
    assert mixing.targets([10, 1000, 0], [3, 1, 2]) == [20.0, 1495.0, 0.0]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [3, 1]) == [0, 0]


def test_split_quotas_are_exact():
    out = mixing.split_quotas([100, 7, 0, 53], 16)
    assert out.sum(axis=0).tolist() == [100, 7, 0, 53] and (out >= 0).all()
    assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 4


@pytest.mark.parametrize("where", ["data", "edge"])
def test_mix(spark, edge_dir, where):
    folder = {"data": SF, "edge": edge_dir}[where]
    docs = table(spark, folder, "documents")
    got = mixing.op10_mixing(spark, folder)
    assert rows_of(got) == rows_of(mixing.op10_mixing(spark, folder))
    texts = sorted((r.doc_id, len(brute.words(r.text))) for r in docs.collect() if r.doc_id is not None)
    assert sorted((r.doc_id, r["size"]) for r in got.collect() if r.doc_id is not None) == texts
    assert got.where("taken < 0 OR taken > 2 * size").count() == 0
    by = docs.select("doc_id", "source").distinct().join(got, "doc_id") if where == "data" else None
    if by is not None:
        for r in by.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("m")).collect():
            assert abs(r.n - r.t) <= max(0.5 * r.m, 0.02 * r.t)
    rows = mixing.mixed(docs)
    assert rows.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == got.agg(F.sum("taken")).first()[0]
    assert set(docs.columns) <= set(rows.columns)


def test_language_learns_every_label(spark, tmp_path):
    from wardops.llm import language

    rng, rows = np.random.default_rng(5), []
    for i in range(70):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(25)]
        for j in range(6 if i < 65 else 3 * (i - 64)):
            rows.append((100 * i + j, " ".join(rng.choice(words, 40)), f"l{i:02d}"))
    rows += [(9000, rows[0][1] + " " + "漢" * 30, "zz"), (9001, "漢字" * 40, "zz"), (9002, "漢字" * 50, "zz"), (9003, "漢字" * 45, "zz")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = table(spark, str(tmp_path), "documents")
    seen = {r.lang for r in docs.where(language.training_side(F.col("doc_id"))).select("lang").distinct().collect()}
    model = language.fit(docs)
    assert len(seen) > 64 and set(model.languages) == seen
    got = {r.doc_id: r.lang_pred for r in language.with_language(docs, model).select("row.doc_id", "lang_pred").collect()}
    assert sum(got[d] == lang for d, _, lang in rows if lang in seen) >= 0.97 * len(rows)


def test_language_chains_agree(monkeypatch):
    from wardops.llm import language

    rng = np.random.default_rng(6)
    scores, moves, begin = rng.normal(size=(150, 5)), rng.normal(size=(5, 5)), rng.normal(size=5)
    starts = np.zeros(150, bool)
    starts[[0, 7, 8, 140]] = True
    for one, other in zip(language.forward_backward(scores, starts, moves, begin), language.step_by_step(scores, starts, moves, begin)):
        assert np.allclose(one / one.sum(axis=1, keepdims=True), other / other.sum(axis=1, keepdims=True))
    texts = pa.array([" ".join(rng.choice(["ab", "cde", "fgh", "xyz"], n)) for n in (3, 0, 90, 1, 17)])
    weights = rng.normal(size=(1 << language.BITS, 5)).astype(np.float32)
    model = language.Model(list("abcde"), weights, moves, begin, np.zeros(0, np.uint64))
    whole = language.predict(model, texts)[2]
    monkeypatch.setattr(language, "FEW", 1)
    monkeypatch.setattr(language, "CELLS", 50)
    assert np.allclose(language.predict(model, texts)[2], whole)


def test_targets_over_a_table(spark):
    for sizes in ([100, 100, 100], [10, 1000, 0], [0, 0], [5, 9, 1, 400, 3, 80, 1000, 2]):
        frame = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "number long, source_size long")
        got = [r.target for r in mixing.with_targets(frame, mixing.WEIGHTS).orderBy("number").collect()]
        assert np.allclose(got, mixing.targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]))


def test_mix_of_many_sources(spark, monkeypatch):
    from collections import Counter

    rows = [(i, f"host{i % 6000:05d}" if i % 5 else "hot", "w " * (1 + i % 7)) for i in range(12_000)] + [(-1, None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size = mixing.word_count(F.col("text"))
    plain = [tuple(map(str, r)) for r in mixing.with_placements(docs, size, mixing.row_key()).collect()]
    assert len(plain) == len(rows)
    monkeypatch.setattr(mixing, "PLAN_ROWS", 10)
    got = mixing.with_placements(docs, size, mixing.row_key()).collect()
    assert sorted(tuple(map(str, r)) for r in got) == sorted(plain)
    of, taken, wanted = Counter(), Counter(), {}
    for r in got:
        of[r.row.source] += r["size"]
        taken[r.row.source] += r["size"] * len(r.placements)
        wanted[r.row.source] = (r.target, r.source_size)
    names = sorted(of, key=lambda s: (s is None, s or ""))
    expected = mixing.targets([of[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    assert len(names) > 4096 and all(wanted[s][1] == of[s] for s in names)
    assert np.allclose([wanted[s][0] for s in names], expected)
    assert all(abs(taken[s] - t) <= 7 for s, t in zip(names, expected))


def test_group_quotas_add_up():
    drawn = np.random.default_rng(1).integers(0, 300, 50)
    groups = [drawn[:20], drawn[20:]]
    split = mixing.split_quotas([int(g.sum()) for g in groups], 16, of=(0, 1))
    for i, g in enumerate(groups):
        out = mixing.split_quotas(g, 16, of=(i,), wanted=split[:, i])
        assert (out.sum(axis=1) == split[:, i]).all() and (out.sum(axis=0) == g).all() and (out >= 0).all()
    assert (mixing.split_quotas(drawn, 16) == mixing.split_quotas(drawn, 16, wanted=mixing.split_quotas(drawn, 16).sum(axis=1))).all()
    big = mixing.split_quotas([10**9, 7, 10**9], 16)
    assert big.sum(axis=0).tolist() == [10**9, 7, 10**9] and (big >= 0).all()


def test_mix_follows_the_splitting_tree(spark, tmp_path):
    from collections import defaultdict

    rows = [(i, "ab"[i % 3 // 2], "w " * (1 + i % 7), None) for i in range(12_000)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = table(spark, str(tmp_path), "documents")
    block, part = mixing._block(mixing.row_key(), mixing.SEED)
    at = {r.doc_id: (r.source, r.block, r.part) for r in docs.select("doc_id", "source", block.alias("block"), part.alias("part")).collect()}
    got = mixing.op10_mixing(spark, str(tmp_path)).collect()
    copies = sorted((r.doc_id, s, p) for r in got for s, p in zip(r.shards, r.places, strict=True))
    mix = mixing.mixed(docs).select("doc_id", "mix_shard", "mix_place").collect()
    assert copies == sorted(map(tuple, mix)) and len({p for _, _, p in copies}) == len(copies)
    sizes, parts, target, found = {}, defaultdict(lambda: defaultdict(int)), {}, {}
    for r in got:
        source, b, p = at[r.doc_id]
        target[source] = r.target
        sizes.setdefault(source, np.zeros(mixing.BLOCKS, np.int64))[b] += r["size"]
        parts[source, b][p] += r["size"]
        found[source, b] = max(found.get((source, b), []), r.shards, key=len)
    drawn = []
    for i, source in enumerate("ab"):
        assert sizes[source].min() > 0
        whole, left, partial = mixing.choose_blocks(sizes[source], target[source], i)
        drawn.append(len(whole) + bool(partial and mixing.choose_parts(parts[source, partial[1]], left)))
    counts = np.zeros((mixing.SHARDS, 2), np.int64)
    for (source, _), shards in found.items():
        for shard in shards:
            counts[shard, "ab".index(source)] += 1
    assert (counts == mixing.split_quotas(drawn, mixing.SHARDS)).all()
