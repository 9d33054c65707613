"""A document cluster on Parquet: a versioned snapshot and a change log, which other clusters may subscribe to.

A batch of updates is held against the snapshot; what wins goes to the change log first and into the next version of
the snapshot then, so a batch that comes again after a failure finds nothing to change, or finishes what was begun.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.buckets import Buckets
from . import docstore

#: what names a document
DOCUMENT = ("table", "key")


class Cluster:
    def __init__(self, spark: SparkSession, path: str, name: str = "cluster"):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name

    def _snapshot(self) -> Buckets:
        return Buckets(self.spark, f"{self.path}/snapshot")

    def snapshot(self) -> DataFrame:
        """The latest version of every column of every document."""
        found = self._snapshot().read()
        return found if found is not None else self.spark.createDataFrame([], docstore.LONG)

    def changes(self) -> DataFrame:
        """The change log: each update that made a difference, once."""
        have = self._snapshot().touched()
        if not have:
            return self.spark.createDataFrame([], docstore.LONG + ", version int")
        return self.spark.read.schema(docstore.LONG + ", version int").parquet(f"{self.path}/changes").where(F.col("version") <= max(have))

    def put_batch(self, updates: DataFrame) -> int:
        """Apply updates (docstore.LONG, with `seq` where their order of arrival is known); the number of changes.  Only the buckets of their documents are read and written."""
        held = self._snapshot()
        version, columns = max(held.touched(), default=-1) + 1, [c.split()[0] for c in docstore.LONG.split(", ")]
        touched = [r[0] for r in updates.select(held.bucket(DOCUMENT).alias("b")).distinct().collect()]  # as many as there are buckets, at most
        before = held.read(touched)
        before = before.select(*columns) if before is not None else self.spark.createDataFrame([], docstore.LONG)
        won = docstore.change_log(updates, before)
        won.select(*columns).write.mode("overwrite").partitionBy("table").parquet(f"{self.path}/changes/version={version}")
        made = self.spark.read.schema(docstore.LONG).parquet(f"{self.path}/changes/version={version}")
        held.write(docstore.merge(before.unionByName(made.select(*columns))).select(*columns), DOCUMENT, touched, version)
        return made.count()

    def put(self, table: str, key: Iterable[object], document: dict, ts: int, uuid: str = "") -> int:
        """One document: scalars are columns, a dict of dicts is a relation of child documents by id."""
        import json

        def cells(doc: dict, path: tuple[str, ...]):
            for k, v in doc.items():
                if isinstance(v, dict):
                    for child, inner in v.items():
                        yield from cells(inner, (*path, k, str(child)))
                else:
                    yield (table, [str(x) for x in key], [*path, k], json.dumps(v), ts, uuid)

        return self.put_batch(self.spark.createDataFrame(list(cells(document, ())), docstore.LONG))

    def get(self, table: str, *key: object) -> dict | None:
        """A point read: path to value, or None."""
        import json

        found = docstore.get(self.snapshot(), table, [str(k) for k in key]).collect()
        return {"/".join(r["path"]): json.loads(r["value"]) for r in found} or None

    def take_from(self, other: Cluster, since: int = -1) -> int:
        """A subscription's turn: the other cluster's changes after version `since`, with their own ts and uuid."""
        return self.put_batch(other.changes().where(F.col("version") > since).drop("version"))

    def stream(self, updates: DataFrame, checkpoint: str):
        """Apply a stream of updates batch by batch."""
        return updates.writeStream.foreachBatch(lambda rows, _: self.put_batch(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
