from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from wardops import local_session

    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bridge(spark, tmp_path_factory):
    """The bridged tables, written once so that tests plan and run quickly."""
    from harness import SMALL
    from wardops import Tables
    from wardops.sources.bridge import bridge_tables

    folder = tmp_path_factory.mktemp("bridge")
    stored = {}
    for name, table in bridge_tables(spark, SMALL).items():
        table.coalesce(1).write.parquet(f"{folder}/{name}")
        stored[name] = spark.read.schema(table.schema).parquet(f"{folder}/{name}")
    return Tables(stored)
