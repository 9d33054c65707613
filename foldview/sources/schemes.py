"""Schemes: from message bytes or text to declared fields, as Column expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META = ("topic", "hostname", "port", "partition", "offset", "nextOffset")


class Scheme:
    """`apply` turns a message column into fields; rows of which `drop` holds are left out."""

    fields: tuple[str, ...]

    def apply(self, df: DataFrame, value: str = "value", meta: Sequence[str] = ()) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class StringScheme(Scheme):
    """UTF-8 bytes as one field, str."""

    fields: tuple[str, ...] = ("str",)

    def apply(self, df, value="value", meta=()):
        return df.select(*meta, F.col(value).cast("string").alias("str"))


@dataclass(frozen=True)
class JsonScheme(Scheme):
    """An object's fields, given as DDL (``id long, name string``); an absent field is null, broken JSON is dropped."""

    ddl: str

    def apply(self, df, value="value", meta=()):
        parsed = F.from_json(F.col(value).cast("string"), f"{self.ddl}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
        return df.select(*meta, parsed.alias("_r")).where("_r is not null and _r._bad is null").select(*meta, "_r.*").drop("_bad")


@dataclass(frozen=True)
class TupleScheme(Scheme):
    """A JSON array's elements by position, given as DDL."""

    ddl: str

    def apply(self, df, value="value", meta=()):
        from pyspark.sql.types import StructType

        parts = F.from_json(F.col(value).cast("string"), "array<string>")
        named = [F.get("_a", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(StructType.fromDDL(self.ddl))]
        return df.select(*meta, parts.alias("_a")).where("_a is not null").select(*meta, *named)


@dataclass(frozen=True)
class KeyedScheme(Scheme):
    """Another scheme whose rows need all key fields."""

    inner: Scheme
    keys: tuple[str, ...]

    def apply(self, df, value="value", meta=()):
        return self.inner.apply(df, value, meta).dropna(subset=list(self.keys))


@dataclass(frozen=True)
class PathScheme(Scheme):
    """Fields by dotted JSON paths, of type string; where `delete` leads to an id, the message deletes that record.

    Broken JSON and messages without an id are dropped.
    """

    key: str
    paths: tuple[tuple[str, str], ...]
    delete: str | None = "delete.status.id_str"

    def apply(self, df, value="value", meta=()):
        text = F.col(value).cast("string")
        at = lambda p: F.get_json_object(text, "$." + p)
        gone = at(self.delete) if self.delete else F.lit(None).cast("string")
        named = [(F.coalesce(gone, at(p)) if f == self.key else F.when(gone.isNull(), at(p))).alias(f) for f, p in self.paths]
        return df.select(*meta, *named).where(F.col(self.key).isNotNull())


@dataclass(frozen=True)
class MetaScheme(Scheme):
    """Another scheme's fields behind where the message came from; the inner scheme may drop it."""

    inner: Scheme
    meta: tuple[str, ...] = META

    def apply(self, df, value="value", meta=()):
        return self.inner.apply(df, value, (*meta, *[m for m in self.meta if m in df.columns]))


@dataclass(frozen=True)
class StaticHosts:
    """Brokers as "host:port" with so many partitions each, numbered on from broker to broker."""

    hosts: tuple[str, ...]
    per_host: int = 1

    @property
    def count(self) -> int:
        return len(self.hosts) * self.per_host

    def place(self, partition: Column) -> tuple[Column, Column, Column]:
        """The host, port and own partition number that a topic's partition has; null beyond the last broker."""
        named = [h.partition(":") for h in self.hosts]
        at = F.floor(partition / self.per_host).cast("int")
        return F.get(F.array(*[F.lit(h) for h, _, _ in named]), at), F.get(F.array(*[F.lit(int(p or 9092)) for _, _, p in named]), at), F.pmod(partition, F.lit(self.per_host)).cast("int")


@dataclass(frozen=True)
class KafkaOptions:
    """Reader options of a Kafka topic; what brokers, offsets and back-pressure were set by."""

    servers: str
    topic: str
    starting: str = "earliest"
    max_offsets: int | None = None
    fail_on_loss: bool = True
    partitions: int | None = None
    hosts: StaticHosts | None = None

    def resumed(self, stored: Mapping[int, int], force: bool = False) -> KafkaOptions:
        """Where a reader without a checkpoint begins: at the offsets it has stored, by partition, and at the end (HEAD) of those without; `force` begins all at `starting`."""
        if force:
            return self
        numbers = range(max([self.hosts.count if self.hosts else 0, *(p + 1 for p in stored)]))
        at = {str(p): stored.get(p, -1) for p in numbers}
        return replace(self, starting=json.dumps({self.topic: at}) if at else "latest")

    def options(self) -> dict[str, str]:
        out = {"kafka.bootstrap.servers": self.servers, "subscribe": self.topic, "startingOffsets": self.starting, "failOnDataLoss": str(self.fail_on_loss).lower()}
        if self.max_offsets:
            out["maxOffsetsPerTrigger"] = str(self.max_offsets)
        if self.partitions:
            out["minPartitions"] = str(self.partitions)
        return out

    def stream(self, spark: SparkSession) -> DataFrame:
        """The topic with its metadata columns and `nextOffset`; needs Spark's Kafka package."""
        return spark.readStream.format("kafka").options(**self.options()).load().withColumn("nextOffset", F.col("offset") + 1)

    def batch(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("kafka").options(**(self.options() | {"endingOffsets": "latest"})).load().withColumn("nextOffset", F.col("offset") + 1)


def file_drops(spark: SparkSession, path: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """A folder of JSON files as a stream: a feeder for tests and for hand-over by files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).json(path)


def ticks(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A heartbeat: one column, ts in milliseconds."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.unix_millis("timestamp").alias("ts"))


def json_records(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows as messages: `key` (JSON list of the ids) and `value` (JSON object with nulls, which delete)."""
    missing = [i for i in ids if i not in df.columns]
    if missing:
        raise ValueError(f"id fields {missing} are mandatory")
    return df.select(F.to_json(F.array(*[F.col(i).cast("string") for i in ids])).alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
