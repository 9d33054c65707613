"""Versioned buckets of rows in a Parquet folder.

Rows belong to a bucket by hash of their ids.  A write makes a new version of the buckets it touches and leaves the
others as they are, so a small batch does not rewrite a large table.  A version counts once its list of touched buckets
is there, which is made last; a version that is written again replaces itself.  Of each bucket the last two versions
stay (the one before the newest is what a batch that comes again starts from), older ones are deleted.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NUMBER = 64
_LIST = "_touched-"


class Buckets:
    def __init__(self, spark: SparkSession, path: str, number: int = NUMBER):
        self.spark, self.path, self.number = spark, path.rstrip("/"), number
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _at(self, *parts: str):
        p = self._path("/".join((self.path, *parts)))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, *parts: str) -> list[str]:
        fs, p = self._at(*parts)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def touched(self) -> dict[int, list[int]]:
        """The buckets of each finished version."""
        out = {}
        for v in sorted(int(n[2:]) for n in self._names() if n.startswith("v=")):
            for name in self._names(f"v={v}"):
                if name.startswith(_LIST):
                    out[v] = [int(x) for x in name[len(_LIST) :].split("-") if x]
        return out

    def newest(self, below: int | None = None) -> dict[int, int]:
        """The last version of each bucket."""
        return {b: v for v, held in self.touched().items() if below is None or v < below for b in held}

    def bucket(self, ids: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in ids]), F.lit(self.number)).cast("int") if ids else F.lit(0)

    def schema(self) -> StructType | None:
        have = self.spark.read.text(f"{self.path}/schema").collect() if self._names("schema") else []
        return StructType.fromJson(__import__("json").loads(have[0][0])) if have else None

    def read(self, only: Iterable[int] | None = None, below: int | None = None) -> DataFrame | None:
        """The rows of the buckets (of all), or None where nothing was ever written."""
        wanted = None if only is None else set(only)
        places = [f"v={v}/_b={b}" for b, v in self.newest(below).items() if wanted is None or b in wanted]
        there = [f"{self.path}/{p}" for p in places if self._names(p)]  # a bucket that lost all its rows has no folder
        kind = self.schema()
        if kind is None:
            return None
        return self.spark.read.schema(kind).parquet(*there) if there else self.spark.createDataFrame([], kind)

    def write(self, rows: DataFrame, ids: Sequence[str], buckets: Iterable[int], version: int) -> None:
        """The rows of these buckets, whole, as a version."""
        buckets = sorted(set(buckets))
        if not self._names("schema"):
            self.spark.createDataFrame([(rows.schema.json(),)], "s string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema")
        fs, place = self._at(f"v={version}")
        fs.delete(place, True)
        # one file for each bucket, not one for each bucket and task
        rows.withColumn("_b", self.bucket(ids)).repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/v={version}")
        fs, done = self._at(f"v={version}", _LIST + "-".join(map(str, buckets)))
        fs.create(done).close()
        self._forget(buckets)

    def _forget(self, buckets: Iterable[int]) -> None:
        held = self.touched()
        for b in buckets:
            for v in sorted(v for v, own in held.items() if b in own)[:-2]:
                fs, old = self._at(f"v={v}", f"_b={b}")
                fs.delete(old, True)
