"""The pipeline, stage by stage, against plain versions."""

from __future__ import annotations

from collections import Counter

import brute
from corpus_data import SF

import corpus_pipeline as pipeline
from wardops.llm import mixing, quality, sharding
from wardops.llm.frames import staged, table


def _kept(spark, folder):
    docs = table(spark, folder, "documents")
    found = {}
    for name, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), "test-pipeline")
        found[name] = docs
    return found


def ids(frame):
    return Counter(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_against_plain_versions(spark):
    found = _kept(spark, SF)
    good = Counter(r.doc_id for r in quality.op9_quality(spark, SF).where("predicted = 1").collect())
    assert ids(found["quality"]) == good
    rows = [(r.doc_id, r.text) for r in found["quality"].collect()]
    assert ids(found["simhash"]) == Counter({c for _, _, c in brute.components(rows)})
    rows = [(r.doc_id, r.text) for r in found["simhash"].collect()]
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    assert ids(found["decontamination"]) == Counter({d for d, _ in rows} - brute.contaminated(rows, items))
    rows = found["decontamination"].collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += len(brute.words(r.text))
    for r in found["mixing"].collect():
        taken[r.source] += len(brute.words(r.text))
    names = sorted(sizes)
    wanted = mixing.targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    assert all(abs(taken[s] - t) <= 0.05 * t for s, t in zip(names, wanted))
    assert max(ids(found["mixing"]).values()) <= 2 and ids(found["mixing"]).keys() <= {r.doc_id for r in rows}
    owners = sharding.lookup_table(sharding.SHARDS)
    last = found["sharding"].collect()
    assert ids(found["sharding"]) == ids(found["mixing"])
    assert all(r.shard == sharding.SHARDS[owners[sharding._hash60(str(r.doc_id)) % sharding.SLOTS]] for r in last)
    columns = table(spark, SF, "documents").columns
    assert all(found[n].columns == columns for n, _ in pipeline.STAGES[:-1])


def test_odd_and_empty_tables(spark, edge_dir, empty_dir):
    found = _kept(spark, edge_dir)
    columns = set(table(spark, edge_dir, "documents").columns)
    assert all(set(found[n].columns) == columns for n, _ in pipeline.STAGES[:-1])
    assert found["sharding"].count() == found["mixing"].count()
    assert all(f.count() == 0 for f in _kept(spark, empty_dir).values())


def test_run_gives_the_last_stage(spark):
    assert {"doc_id", "text", "shard"} <= set(pipeline.run(spark, "/root/testdata/sf0.001").columns)
