"""Table states for streams: an unchanged base plus changed rows per epoch.

Every micro-batch writes only the rows it touched, into a folder named by its
epoch.  The highest id given in each table is written last and commits the epoch:
readers take committed epochs only, all tables of an epoch or none.  Running an
epoch again (after a lost executor or a restart) overwrites what was not committed
and leaves a committed epoch as it is, so each change counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wardops.changes.core import Changes, with_defaults
from wardops.operators.numbering import gives_ids, highest_id, id_mark
from wardops.operators.pruning import PARTITION_COLUMNS
from wardops.operators.rewrite import updated, with_rows
from wardops.schemas import KEYS
from wardops.session import Stage, keep
from wardops.tables import Tables

REMOVED = "_removed"
MARKS = "_id_marks"


class DeltaStore:
    """``stage`` takes a rule's updates before they meet the table they change, which most rules read already."""

    def __init__(self, spark: SparkSession, root: str, base: Tables, writes: list[str], stage: Stage = keep):
        self.spark, self.root, self.base, self.writes, self.stage = spark, root.rstrip("/"), base, writes, stage
        for name in writes:
            # An empty first folder, so that there is always something to read.
            empty = spark.createDataFrame([], self._schema(name)).limit(0)
            empty.write.mode("overwrite").parquet(self._folder(name, -1))
        self._commit(-1, {name: id_mark(base, name) for name in self._numbered()})

    def _numbered(self) -> list[str]:
        return [name for name in self.writes if gives_ids(name, self.base[name])]

    def _commit(self, epoch: int, last_ids: dict[str, DataFrame]) -> None:
        """The last write of an epoch: the highest ids of the tables it touched, and a row without a table."""
        marks = self.spark.range(1).select(F.lit("").alias("table_name"), F.lit(0).cast("long").alias("last_id"))
        for name, last in last_ids.items():
            marks = marks.unionByName(last.select(F.lit(name).alias("table_name"), "last_id"))
        marks.coalesce(1).write.mode("overwrite").parquet(self._folder(MARKS, epoch))

    def _marks(self) -> DataFrame:
        """(table_name, last_id, epoch) of committed epochs."""
        return self.spark.read.schema("table_name string, last_id long, epoch long").parquet(f"{self.root}/{MARKS}")

    def _committed(self) -> Column:
        """Is the row's epoch committed; epochs are committed in order."""
        return F.col("epoch") <= self._marks().agg(F.max("epoch")).scalar()

    def _table(self, name: str) -> DataFrame:
        return self.base[name].drop(*PARTITION_COLUMNS)

    def _schema(self, name: str) -> T.StructType:
        fields = [T.StructField(f.name, f.dataType, True) for f in self._table(name).schema.fields]
        return T.StructType([*fields, T.StructField(REMOVED, T.BooleanType(), True)])

    def _folder(self, name: str, epoch: int) -> str:
        return f"{self.root}/{name}/epoch={epoch}"

    def changed_rows(self, name: str, before: int | None = None) -> DataFrame:
        """The latest state of every row touched so far."""
        schema = self._schema(name)
        columns = [f.name for f in schema.fields]
        deltas = self.spark.read.schema(
            T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
        ).parquet(f"{self.root}/{name}").filter(self._committed())
        if before is not None:
            deltas = deltas.filter(F.col("epoch") < before)
        key = KEYS[name]
        if key not in columns:
            return deltas.select(*columns)  # a table without key is only appended to
        # Column by column: what a query does not read is not grouped, and short values are hashed, not sorted.
        latest = [F.max_by(c, "epoch").alias(c) for c in columns if c != key]
        return deltas.groupBy(key).agg(*latest).select(*columns)

    def current(self, before: int | None = None) -> Tables:
        """All tables as they stand, or as they stood before an epoch."""
        merged = {}
        for name in self.writes:
            changed = self.changed_rows(name, before)
            kept = self._table(name)
            if KEYS[name] in kept.columns:
                kept = kept.join(changed.select(KEYS[name]), KEYS[name], "left_anti")
            merged[name] = kept.unionByName(changed.filter(~F.col(REMOVED)).drop(REMOVED))
        marks = self._marks() if before is None else self._marks().filter(F.col("epoch") < before)
        last = {name: marks.filter(F.col("table_name") == name).select("last_id") for name in self._numbered()}
        return self.base.replace(**merged).marked(last)

    def append(self, epoch: int, changes: Changes, t: Tables) -> None:
        """Write and commit an epoch, unless it is committed already."""
        if not self._marks().filter(F.col("epoch") == epoch).isEmpty():
            return
        inserts = dict(changes.inserts)
        if changes.audit is not None:
            inserts["audit_logs"] = changes.audit_rows(t)
        for name in changes.touched():
            if name not in self.writes:
                raise ValueError(f"rule changes {name}, which this store does not keep")
            self._delta(name, changes, inserts, t).write.mode("overwrite").parquet(
                self._folder(name, epoch)
            )
        numbered = [name for name in changes.touched() if name in self._numbered()]
        self._commit(epoch, {name: highest_id(name, self._written(name, epoch)) for name in numbered})

    def _written(self, name: str, epoch: int) -> DataFrame:
        return self.spark.read.schema(self._schema(name)).parquet(self._folder(name, epoch))

    def _delta(self, name: str, changes: Changes, inserts: dict, t: Tables) -> DataFrame:
        key, table = KEYS[name], t[name]
        delta = table.limit(0).withColumn(REMOVED, F.lit(False))
        if name in changes.updates:
            rows = updated(table, key, self.stage(changes.updates[name]), only_touched=True)
            delta = delta.unionByName(rows.withColumn(REMOVED, F.lit(False)))
        if name in inserts:
            rows = with_rows(table.limit(0), with_defaults(name, inserts[name]))
            delta = delta.unionByName(rows.withColumn(REMOVED, F.lit(False)))
        if name in changes.deletes:
            rows = table.join(changes.deletes[name].select(key), key, "left_semi")
            delta = delta.unionByName(rows.withColumn(REMOVED, F.lit(True)))
        return delta
