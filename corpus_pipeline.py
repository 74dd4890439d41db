"""From raw documents to mixed, sharded training text.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before
it kept.  All but the last return the columns of ``documents``; the last adds
``slot`` and ``shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardops.llm import mixing, quality, sharding, simhash, winnowing
from wardops.llm.frames import prepare, staged, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = table(prepare(spark), sf_dir, "labels")
    return quality.keep_good(docs, labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every group of near copies."""
    prepare(spark)
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span with the benchmark."""
    return winnowing.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies (0, 1 or 2) of every document as the mix takes."""
    prepare(spark)
    return mixing.mixed(docs).drop("mix_shard", "mix_place")


def place_on_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The slot and shard of every row."""
    prepare(spark)
    return sharding.assign_shards(docs)


STAGES = [
    ("quality", reject_low_quality),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place_on_shards),
]

#: The classifier and the fingerprints have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
