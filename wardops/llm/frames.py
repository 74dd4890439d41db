"""Reading tables, staging frames in the shared folder, and slicing Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardops.session import shared_folder

#: Rows handed to a Python worker at once; texts may be long.
BATCH_ROWS = 512
#: Text bytes worked on at once inside a worker; arrays of several numbers a byte are made of them.
SLICE_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on: small Arrow batches, adaptive skew joins."""
    for key, value in {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read back: computed once, lineage cut."""
    path = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of staged frames that nothing reads any more."""
    for frame in frames:
        jvm = frame.sparkSession._jvm
        for folder in {name.rsplit("/", 1)[0] for name in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns but the text) and ``text``, for work that gives no text back."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(None).cast("int").alias("none")]
    return docs.select(F.struct(*others).alias("row"), "text")


def filtered(docs: DataFrame, wanted: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Array]]) -> DataFrame:
    """The rows that ``wanted`` marks; ``wanted`` is given slices and yields one boolean array for each.

    A text goes to a worker once, and only kept rows come back.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.RecordBatch] = []

        def watched() -> Iterator[pa.RecordBatch]:
            for piece in slices(batches):
                seen.append(piece)
                yield piece

        for mask in wanted(watched()):
            yield seen.pop().filter(mask)

    return docs.mapInArrow(keep, docs.schema)


def training_side(doc_id: Column) -> Column:
    """True for rows a model may learn from: crc32(doc_id as text) mod 3 is not 1 (null id: as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (a null text counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a null-free array, and the offsets of each text in them."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with few text bytes each (a longer text stands alone)."""
    for batch in batches:
        sizes = np.diff(text_bytes(texts_of(batch.column(column)))[1])
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def over_texts(frame: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``work`` applied to slices of a frame that has a column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            yield work(piece)

    return frame.mapInArrow(run, schema)


def crc_sql(code: str) -> str:
    """DuckDB SQL for the CRC-32 of the bytes that a column holds as hex digits, four bits at a time, the low half of each byte first."""
    table = [zlib.crc32(bytes([i << 4])) ^ zlib.crc32(b"\0") for i in range(16)]
    halves = f"list_transform(range(length({code})), lambda i: ('0x' || substr({code}, xor(i, 1) + 1, 1))::BIGINT)"
    step = f"xor(state >> 4, {table}[xor(state & 15, half) + 1])"
    return f"xor(list_reduce({halves}, lambda state, half: {step}, 4294967295::BIGINT), 4294967295)"
