"""Apply a change rule to commands as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wardops.changes.core import Changes
from wardops.streaming.store import DeltaStore
from wardops.tables import Tables

Rule = Callable[[DataFrame, Tables], Changes]


def start_rule(
    commands: DataFrame, rule: Rule, store: DeltaStore, checkpoint: str, **trigger
) -> StreamingQuery:
    """Start the stream; ``trigger`` defaults to working off what is there.

    The rule is the same function a batch job calls.  It sees the tables as
    left by all earlier micro-batches.  With ``command_marks`` among the tables the
    store keeps (``guarded``), rules where the last command wins go by sequence
    number, not by arrival.
    """
    def apply(batch: DataFrame, epoch: int) -> None:
        before = store.current(before=epoch)
        batch.persist()  # a rule has several outputs; do not read the source for each
        try:
            store.append(epoch, rule(batch, before), before)
        finally:
            batch.unpersist()

    return (
        commands.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stored_table(folder: str, name: str) -> str:
    """A table's path as a glob, which a stream can read as one file or as a folder of part files."""
    return f"{folder.rstrip('/')}/{{{name}.parquet}}"
