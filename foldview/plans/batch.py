"""Views as DataFrame queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.mappers import column
from ..functions.reducers import FoldExpr, PyFold, TopN
from ..operators.ordering import sort_key
from .spec import MapSpec, ViewSpec

#: parts in which a key is folded by expressions
PARTS = 32


def latest(df: DataFrame, ids: Sequence[str], seq: str | Sequence[str]) -> DataFrame:
    """The last version of each record: an aggregate, so a record's history is never gathered."""
    by = [seq] if isinstance(seq, str) else list(seq)
    rest = [c for c in df.columns if c not in ids]
    picked = df.groupBy(*ids).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_last"))
    return picked.select(*ids, "_last.*")


def defined(values: Sequence[str], ids: Sequence[str]) -> Column:
    """A record counts when all its declared values that are not ids are there; otherwise it is deleted for this map."""
    out = F.lit(True)
    for v in values:
        if v not in ids:
            out &= F.col(v).isNotNull()
    return out


def mapped(df: DataFrame, m: MapSpec, number: int, arity: int) -> DataFrame:
    """_doc (source and ids) and the emitted values of one map."""
    missing = [c for c in (*m.source.ids, *m.values) if c not in df.columns]
    if missing:
        raise ValueError(f"{m.source.name} has no column {', '.join(missing)}")
    df = df.where(defined(m.values, m.source.ids))
    doc = F.struct(F.lit(m.name or str(number)).alias("src"), F.to_json(F.array(*[F.col(i).cast("string") for i in m.source.ids]) if m.source.ids else F.array().cast("array<string>")).alias("id"))
    return m.mapper.rows(df.select(doc.alias("_doc"), *dict.fromkeys((*m.values, *m.source.ids))), m.values, arity)


def emitted(view: ViewSpec, sources: dict[str, DataFrame]) -> DataFrame:
    """All maps of a view under one another: _doc, keys, values."""
    names = (*view.keys, *view.values)
    out: DataFrame | None = None
    for i, m in enumerate(view.maps):
        df = mapped(sources[m.source.name or ""], m, i, len(names))
        df = df.select("_doc", *[F.col(f"_{k}").alias(n) for k, n in enumerate(names)])
        out = df if out is None else out.unionByName(df)
    assert out is not None
    return out


def _top(df: DataFrame, keys: list[str], value: str, r: TopN) -> DataFrame:
    """Rank tuples, equal ones alike, keep n ranks of each key and of equal ones one: Spark limits each partition's groups before the one shuffle."""
    by = F.col("_x").asc() if r.ascending else F.col("_x").desc()
    rows = df.select(*keys, F.explode(value).alias("_x"))
    kept = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy(*keys).orderBy(by))).where(F.col("_r") <= r.n).distinct()
    listed = F.sort_array(F.collect_list(F.struct("_r", "_x")))
    return kept.groupBy(*keys).agg(F.transform(listed, lambda x: x["_x"]).alias(value))


def reduced(df: DataFrame, view: ViewSpec) -> DataFrame:
    keys, values, r = list(view.keys), list(view.values), view.reducer
    if view.partitions and keys:
        df = df.repartition(view.partitions, *keys)
    if not keys:  # one global row, and none while there is no document
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    if isinstance(r, TopN) and len(values) == 1:
        out = _top(df, keys, values[0], r)
    elif isinstance(r, FoldExpr):
        kinds = StructType([df.schema[v] for v in values])

        def folded(df: DataFrame, by: list[str]) -> DataFrame:
            lists = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_doc", *values))).alias("_l"))
            lists = lists.withColumn("_rows", F.transform("_l", lambda x: F.struct(*[x[v].alias(v) for v in values])))
            return lists.select(*by, F.get("_l", F.lit(0))["_doc"].alias("_doc"), r.over("_rows", kinds).alias("_v")).select(*by, "_doc", "_v.*")

        # a key's documents are folded in parts first, so that no key is listed whole
        out = folded(folded(df.withColumn("_part", F.pmod(F.xxhash64("_doc"), F.lit(PARTS))), [*keys, "_part"]), keys).select(*keys, *values)
    elif isinstance(r, PyFold):
        out = _py(df, keys, values, r, tuple(view.keys))
    else:
        out = df.groupBy(*keys).agg(*r.aggregates(values))
    return out.drop("_all") if not view.keys else out


def _py(df: DataFrame, keys: list[str], values: list[str], r: PyFold, own: tuple[str, ...]) -> DataFrame:
    """Sorted partitions are folded row by row in document order, before the shuffle and after it: only one group's total is held."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([df.schema[c] for c in (*keys, "_doc", *values)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, first, rows = None, None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            for x in batch.to_pylist():
                k, v = tuple(x[c] for c in keys), tuple(x[c] for c in values)
                if total is not None and k == key:
                    total = r.step(k if own else (), total, v)
                else:
                    if total is not None:
                        rows.append((*key, first, *total))
                    key, total, first = k, v, x["_doc"]
            if len(rows) > 5000:
                yield flush()
                rows.clear()
        if total is not None:
            rows.append((*key, first, *total))
        yield flush()

    df = df.select(*keys, "_doc", *values).sortWithinPartitions(*keys, "_doc").mapInArrow(run, schema)
    return df.repartition(*keys).sortWithinPartitions(*keys, "_doc").mapInArrow(run, schema).select(*keys, *values)


def formatted(df: DataFrame, view: ViewSpec) -> DataFrame:
    """Formats see the value columns alone; one null among them makes all formatted values null."""
    if not view.formats:
        return df
    if len(view.formats) < len(view.format_values):
        raise ValueError(f"{len(view.formats)} formats for {len(view.format_values)} columns")
    there = F.lit(True)
    for v in view.values:
        there &= F.col(v).isNotNull()
    made = [F.when(there, column(f)).alias(n) for f, n in zip(view.formats, view.format_values)]
    return df.select(*view.keys, *made)


def lower(view: ViewSpec, sources: dict[str, DataFrame]) -> DataFrame:
    return formatted(reduced(emitted(view, sources), view), view)


__all__ = ["defined", "emitted", "latest", "lower", "mapped", "reduced", "sort_key"]
