"""Shared helpers: table access, the shared work folder, and Arrow/numpy word hashing.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is the class
``[^\\x20\\x09-\\x0D]+`` on UTF-8 text.  All hashing here is seeded by fixed constants,
so every executor, attempt and run gives the same values.
"""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable, work_dir

U64 = np.uint64
#: bytes of text that one vectorised step works on; bounds the memory of a Python worker
STEP_BYTES = 1 << 20


#: bytes of an Arrow batch, so that a batch of very long texts takes no more memory than one of short ones
BATCH_BYTES = 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(spark: SparkSession) -> SparkSession:
    """Limit this session's Arrow batches by bytes; a smaller limit of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    reachable(spark)
    have = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get(key).lower())
    if not have or int(have[1]) << 10 * " kmg".index(have[2].replace("b", "") or " ") > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named _0, _1, … by place: names that no other column can clash with, whatever df's are."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def needed(df: DataFrame, **kinds: str) -> DataFrame:
    """The columns of these very names, cast to their kinds; df may have others that differ in case alone, or with dots."""
    plain = numbered(df)
    return plain.select(*[F.col(f"_{df.columns.index(c)}").cast(k).alias(c) for c, k in kinds.items()])


def with_texts(df: DataFrame, plain: DataFrame) -> DataFrame:
    """plain, which is df numbered with another text, under df's names; n_chars, where there is one, follows the text."""
    if "n_chars" in df.columns:
        n, text = f"_{df.columns.index('n_chars')}", f"_{df.columns.index('text')}"
        plain = plain.withColumn(n, F.coalesce(F.length(text), F.lit(0)).cast(df.schema.fields[df.columns.index("n_chars")].dataType))
    return plain.toDF(*df.columns)


#: settled stages of this process that are not discarded yet
_written: list[str] = []


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside drop their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, None)
    if before is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)


def settled(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{work_dir(bounded(spark))}/foldview-{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foldview_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written.remove(path)


def discard(spark: SparkSession, *stages: DataFrame) -> None:
    """Delete settled stages that nothing will read any more."""
    for stage in stages:
        _delete(spark, stage._foldview_path)


def settled_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The settled result of make; what was settled on the way there is deleted."""
    before = set(_written)
    out = settled(spark, make(), name)
    for path in [p for p in _written if p not in before and p != out._foldview_path]:
        _delete(spark, path)
    return out


def clear(spark: SparkSession) -> None:
    """Delete all settled stages of this process: to be called when no result that reads them is needed any more."""
    for path in list(_written):
        _delete(spark, path)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix, element by element."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_BYTE = splitmix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0xD1342543DE82EF95
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.empty(max(n, STEP_BYTES), dtype=U64)
            have[0] = 1
            have[1:] = U64(base)
            have = np.multiply.accumulate(have)
        if len(have) <= 4 * STEP_BYTES:
            _powers[base] = have
    return have[:n]


class Words:
    """The words of some documents: hash, byte range and the first word's index of each document."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(raw)
        solid = ~_SPACE[raw]
        begins = solid.copy()
        if n:
            begins[1:] &= ~solid[:-1]
            inner = offsets[1:-1][offsets[1:-1] < n]
            begins[inner] = solid[inner]
            ends = solid.copy()
            ends[:-1] &= ~solid[1:]
            last = offsets[1:-1][offsets[1:-1] > 0] - 1
            ends[last] = solid[last]
            self.start = np.flatnonzero(begins)
            self.end = np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.empty(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            table_ = _BYTE[_LOWER] if lower else _BYTE
            total = np.empty(n + 1, dtype=U64)
            total[0] = 0
            np.cumsum(table_[raw] * _power(_R, n) if n else np.empty(0, U64), out=total[1:])
            self.hash = splitmix((total[self.end] - total[self.start]) * _power(_R_INV, n + 1)[self.start] + (self.end - self.start).astype(U64)) if n else np.empty(0, U64)
        #: word index at which each document begins; one more than documents
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words inside one document, and the word index it starts at."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.empty(0, U64), np.empty(0, np.int64)
        ok = np.ones(m, dtype=bool)
        for back in range(1, k):
            cut = self.first[1:-1] - back
            ok[cut[(cut >= 0) & (cut < m)]] = False
        # a document shorter than k words must not let a run cross two borders
        at = np.flatnonzero(ok)
        with np.errstate(over="ignore"):
            acc = np.zeros(len(at), dtype=U64)
            for j in range(k):
                acc = acc * U64(0x9E3779B97F4A7C15) + self.hash[at + j]
                acc ^= acc >> U64(29)
        return splitmix(acc), at


def string_chunks(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about `step` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + step, side="right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
