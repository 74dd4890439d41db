from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from corpus_data import CLASHES, ITEM, PASSAGE, TABLES, documents  # noqa: E402


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """Tables with nulls, empties, long texts, ties, repeated rows and clashing names."""
    from pyspark.sql import functions as F

    folder = str(tmp_path_factory.mktemp("edge"))
    clash = lambda frame: frame.withColumns({c: F.lit(7) for c in CLASHES})
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    clash(docs).coalesce(3).write.parquet(f"{folder}/documents.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(20 * i, [1.0, float(i % 3), 0.5]) for i in range(12)] + [(3, [1.0, 0.0, 0.5])] * 2 + [
        (5, None), (7, []), (9, [0.0, 0.0, 0.0]), (11, [nan, 1.0, 1.0]), (13, [inf, 0.0, 0.0]), (15, [None, 1.0, 1.0]),
        (None, [1.0, 1.0, 1.0]), (40, [9.0, 9.0, 9.0]), (17, [1.0, 2.0]), (1, [2.0, 0.0, 1e-30])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    frame.withColumns({c: F.lit(7) for c in ("id", "v", "dim", "qb", "cb", "score", "rank")}).write.parquet(f"{folder}/embeddings.parquet")
    items = [(1, ITEM), (2, "short item"), (3, None), (4, ""), (2, "short item"), (5, PASSAGE), (6, f"x {PASSAGE}")]
    clash(spark.createDataFrame(items, "item_id long, text string")).write.parquet(f"{folder}/benchmark.parquet")
    pages = [(1, "http://a.example/x", "<article>Same text</article>")] * 2 + [
        (2, None, "<p>no address"), (3, "http://a.example", None), (4, "not a url", ""), (None, "http://b.example", "<p>no id")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    frame.withColumns({c: F.lit(7) for c in ("host", "wrapper", "wrappers", "text", "n_chars", "pages", "parts", "bucket")}).write.parquet(f"{folder}/pages.parquet")
    labels = [(i, i % 2, 0) for i in range(1, 20)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, edge_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in TABLES:
        spark.read.parquet(f"{edge_dir}/{name}.parquet").where("1 = 0").write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="session")
def duck():
    def connect(folder):
        con = duckdb.connect()
        for name in TABLES:
            path = f"{folder}/{name}.parquet"
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path if Path(path).is_file() else path + '/*.parquet'}'")
        return con

    return connect
