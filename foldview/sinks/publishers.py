"""Publishers: what receives a view's changes.

A publisher gets a micro-batch as a DataFrame that holds each key once, its last version, with _op U or D.  Batches may
come again after a failure: `batch_id` makes writes idempotent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemes import json_records
from .buckets import NUMBER, Buckets


class Publisher(Protocol):
    def write(self, table: str, ids: Sequence[str], rows: DataFrame, batch_id: int) -> None: ...


def last_of_each(rows: DataFrame, ids: Sequence[str], seq: str | Sequence[str]) -> DataFrame:
    """The last row of each id in a batch."""
    by = [seq] if isinstance(seq, str) else list(seq)
    rest = [c for c in rows.columns if c not in ids]
    if not ids:
        return rows.groupBy(F.lit(1).alias("_all")).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r")).select("_r.*")
    return rows.groupBy(*ids).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r")).select(*ids, "_r.*")


def is_delete(rows: DataFrame, ids: Sequence[str], ignore: Sequence[str] = ("_op", "_changed")):
    """A row deletes when all that is not an id is null (so always, where there is nothing else)."""
    out = F.lit(True)
    for c in rows.columns:
        if c not in ids and c not in ignore:
            out &= F.col(c).isNull()
    return out


class ParquetTable:
    """Upserts and deletes on a Parquet folder: each batch writes the next version of the buckets of ids that it touches.

    Versions go on where an earlier run ended: batch ids of a new checkpoint begin at 0 again, so each run of a stream
    (`begin`, by its checkpoint) has versions of its own above those that it finds.
    """

    def __init__(self, spark, path: str, number: int = NUMBER):
        self.spark, self.path, self.number, self.base = spark, path.rstrip("/"), number, {}

    def _buckets(self, table: str) -> Buckets:
        return Buckets(self.spark, f"{self.path}/{table}", self.number)

    def begin(self, table: str, checkpoint: str) -> None:
        """Number the batches of this checkpoint from the first version that was free when it was first seen."""
        name, held = hashlib.sha256(checkpoint.encode()).hexdigest()[:16], self._buckets(table)
        runs = dict(x.split("-") for x in held._names("runs"))
        if name not in runs:
            runs[name] = str(max(held.touched(), default=-1) + 1)
            fs, mark = held._at("runs", f"{name}-{runs[name]}")
            fs.create(mark).close()
        self.base[table] = int(runs[name])

    def read(self, table: str) -> DataFrame | None:
        return self._buckets(table).read()

    def write(self, table, ids, rows, batch_id):
        held, version = self._buckets(table), self.base.get(table, 0) + batch_id
        rows = rows.persist()
        try:
            touched = [r[0] for r in rows.select(held.bucket(ids).alias("b")).distinct().collect()]  # as many as there are buckets, at most
            new = rows.where(~is_delete(rows, ids)).drop("_op", "_changed")
            old = held.read(touched, version)
            if old is not None:
                on = F.lit(True)
                for k in ids:
                    on &= F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
                kept = old.alias("o").join(rows.select(*ids).alias("n"), on, "left_anti") if ids else old.limit(0)
                new = kept.unionByName(new)
            if touched:
                held.write(new, ids, touched, version)
        finally:
            rows.unpersist()


class KeyValue:
    """A store of cells: row key is the ids joined by '/', '{}' without ids; a JSON cell for each field, or a row delete.

    `put(table, row, cells)` and `delete(table, row)` are given; each executor's partition makes its own client.
    """

    def __init__(self, client: Callable[[], object]):
        self.client = client

    @staticmethod
    def cells(ids: Sequence[str], rows: DataFrame) -> DataFrame:
        """row, gone and cells: what `write` sends."""
        key = F.concat_ws("/", *[F.col(i).cast("string") for i in ids]) if ids else F.lit("{}")
        fields = [c for c in rows.columns if c not in ids and c not in ("_op", "_changed")]
        cell = lambda f: F.expr(f"regexp_extract(to_json(struct(`{f}` as v), map('ignoreNullFields', 'false')), '(?s)^.{{5}}(.*).$', 1)")
        cells = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*map(cell, fields))) if fields else F.create_map().cast("map<string,string>")
        return rows.select(key.alias("row"), is_delete(rows, ids).alias("gone"), cells.alias("cells"))

    def write(self, table, ids, rows, batch_id):
        make = self.client

        def send(part):
            store = make()
            for r in part:
                store.delete(table, r["row"]) if r["gone"] else store.put(table, r["row"], dict(r["cells"] or {}))

        self.cells(ids, rows).foreachPartition(send)


class HttpDocuments:
    """Documents over HTTP: _id is the JSON list of table and ids, type the table; update handlers replace or delete.

    A request that raises is sent again after `pause` seconds, `tries` times in all; then the batch fails and comes again.
    """

    def __init__(self, post: Callable[[str, str, str], None], tries: int = 3, pause: float = 5.0):
        self.post, self.tries, self.pause = post, tries, pause

    @staticmethod
    def requests(table: str, ids: Sequence[str], rows: DataFrame) -> DataFrame:
        """id, gone and body: what `write` sends."""
        fields = [c for c in rows.columns if c not in ("_op", "_changed")]
        doc = F.to_json(F.array(F.lit(table), *[F.col(i).cast("string") for i in ids]))
        body = F.to_json(F.struct(doc.alias("_id"), F.lit(table).alias("type"), *fields), {"ignoreNullFields": "false"})
        return rows.select(doc.alias("id"), is_delete(rows, ids).alias("gone"), body.alias("body"))

    def write(self, table, ids, rows, batch_id):
        post, tries, pause = self.post, self.tries, self.pause

        def send(part):
            import time

            for r in part:
                for left in reversed(range(tries)):
                    try:
                        post("delete" if r["gone"] else "replace", r["id"], r["body"])
                        break
                    except Exception:
                        if not left:
                            raise
                        time.sleep(pause)

        self.requests(table, ids, rows).foreachPartition(send)


class KafkaTopic:
    """A topic of changes: key the JSON list of the ids, value by default the row as a JSON object, whose nulls delete.

    `text` gives another value, an expression such as ``concat(word, ' ', n)``.  `save` writes the messages; by default
    Spark's Kafka writer, which must be on the class path.
    """

    def __init__(self, servers: str, topic: str, text: str | None = None, save: Callable[[DataFrame], None] | None = None):
        self.servers, self.topic, self.text, self.save = servers, topic, text, save

    def messages(self, ids: Sequence[str], rows: DataFrame) -> DataFrame:
        """topic, key and value.  With `text`, a deleted row's value is null."""
        plain = rows.drop("_op", "_changed")
        if self.text is None:
            return json_records(plain, ids).select(F.lit(self.topic).alias("topic"), "key", "value")
        key = F.to_json(F.array(*[F.col(i).cast("string") for i in ids])) if ids else F.lit("[]")
        return plain.select(F.lit(self.topic).alias("topic"), key.alias("key"), F.when(~is_delete(plain, ids), F.expr(self.text).cast("string")).alias("value"))

    def write(self, table, ids, rows, batch_id):
        out = self.messages(ids, rows)
        if self.save:
            self.save(out)
        else:
            out.write.format("kafka").option("kafka.bootstrap.servers", self.servers).save()


def counter(rows: DataFrame, field: str) -> DataFrame:
    """A dashboard counter: {"value": n}, 0 for null."""
    return rows.select(F.to_json(F.struct(F.coalesce(field, F.lit(0)).alias("value"))).alias("body"))


def leaderboard(rows: DataFrame, field: str, label: str, value: str) -> DataFrame:
    """A dashboard leaderboard from a top-n list: [{"name", "values"}]."""
    return rows.select(F.to_json(F.transform(F.coalesce(field, F.array()), lambda x: F.struct(x[label].alias("name"), F.array(x[value]).alias("values")))).alias("board"))


class Print:
    """The last row of each batch, and rows a second where asked for."""

    def __init__(self, label: str, stats: bool = False, out: Callable[[str], None] = print):
        self.label, self.stats, self.out, self.since = label, stats, out, None

    def write(self, table, ids, rows, batch_id):
        import time

        rows = rows.persist()
        try:
            tail = rows.tail(1)
            rate = ""
            if self.stats:
                now = time.monotonic()
                rate = f" {rows.count() / max(now - self.since, 1e-9):.0f} op/s" if self.since else ""
                self.since = now
            self.out(f"{self.label} {table}: {tail[0].asDict(True) if tail else {}}{rate}")
        finally:
            rows.unpersist()


def publish(engine, name: str, publisher: Publisher, checkpoint: str | None = None, every: str | None = None):
    """A view to a publisher.  A stream ends with what is available now, or goes on with a batch `every` so often."""
    view = engine.plan(name)[-1]
    table = f"{engine.namespace}.{name}" if engine.namespace else name
    if not any(s.df.isStreaming for s in engine.sources.values()):
        rows = engine.batch(name)
        publisher.write(table, view.keys, rows.withColumns({"_changed": F.lit(True), "_op": F.when(is_delete(rows, view.keys), "D").otherwise("U")}), 0)
        return None
    if checkpoint and hasattr(publisher, "begin"):
        publisher.begin(table, checkpoint)
    out = engine.stream(name).where("_changed")

    def each(rows: DataFrame, batch_id: int) -> None:
        publisher.write(table, view.keys, rows, batch_id)

    writer = out.writeStream.outputMode("update").foreachBatch(each)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def publish_all(engine, names: Sequence[str], publisher: Publisher, checkpoint: str | None = None) -> list:
    """Many views to one publisher: a query for each."""
    return [publish(engine, n, publisher, f"{checkpoint}/{n}" if checkpoint else None) for n in names]
