"""The builder: ``engine.map(values, source, mapper).map(...).red(values, into, reducer).fmt(values, ...)``.

The same description runs in batch (`batch`), as a stateful stream (`stream`), or is sent to a publisher (`publish`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.mappers import Emit, Expr, Mapper, SelectAll
from ..functions.reducers import FoldExpr, Reducer
from ..session import reachable
from . import batch
from .schema import parse, parse_signature
from .spec import MapSpec, ViewSpec, ordered


@dataclass(frozen=True)
class Source:
    df: DataFrame
    ids: tuple[str, ...]
    seq: tuple[str, ...] = ()


class Mapped:
    """A view with sources but no reducer yet."""

    def __init__(self, engine: Engine, maps: tuple[MapSpec, ...] = (), partitions: int | None = None):
        self.engine, self.maps, self.partitions = engine, maps, partitions

    def map(self, values: str, source: str, mapper: Mapper | str | Sequence[Expr] | None = None) -> Mapped:
        if mapper is None:
            mapper = SelectAll()
        elif not isinstance(mapper, Mapper):
            mapper = Emit(*([x.strip() for x in mapper.split(";")] if isinstance(mapper, str) else mapper))
        return Mapped(self.engine, (*self.maps, MapSpec(parse_signature(values).values, parse(source), mapper)), self.partitions)

    def name(self, name: str) -> Mapped:
        """Name the last source: documents of maps with one name are one document."""
        return Mapped(self.engine, (*self.maps[:-1], replace(self.maps[-1], name=name)), self.partitions)

    def parallelism(self, n: int) -> Mapped:
        """Shuffle partitions between these maps and their reduction in batch; without it Spark deals tasks by the size of data."""
        return Mapped(self.engine, self.maps, n)

    def red(self, values: str, into: str, reducer: Reducer | str) -> View:
        head = parse(into)
        if isinstance(reducer, str):
            reducer = FoldExpr(*[x.strip() for x in reducer.split(";")])
        spec = ViewSpec(head.name or "", head.ids, parse_signature(values).values, self.maps, reducer, partitions=self.partitions)
        return self.engine._add(spec)


class View:
    """A registered view; each refinement replaces it under its name."""

    def __init__(self, engine: Engine, spec: ViewSpec):
        self.engine, self.spec = engine, spec

    def fmt(self, values: str, *formats: Expr) -> View:
        return self.engine._add(replace(self.spec, formats=tuple(formats), format_values=parse_signature(values).values))

    def reducers(self, n: int) -> View:
        """Shuffle partitions of this view's reduction."""
        return self.engine._add(replace(self.spec, partitions=n))

    def salted(self, n: int) -> View:
        """Fold hot keys of a stream in n buckets first; a no-op in batch, where partial aggregation does that."""
        return self.engine._add(replace(self.spec, salts=n))

    def batch(self) -> DataFrame:
        return self.engine.batch(self.spec.name)


class Engine:
    """Sources and views; a namespace goes before the names of what is registered for SQL (with _) and published (with a dot)."""

    def __init__(self, spark: SparkSession, namespace: str = ""):
        self.spark, self.namespace = reachable(spark), namespace
        self.sources: dict[str, Source] = {}
        self.views: dict[str, ViewSpec] = {}

    def source(self, declaration: str, df: DataFrame, seq: str | Sequence[str] = ()) -> Engine:
        """Declare records: ``users(id)``; with `seq`, rows are versions and the last one of each id counts."""
        head = parse(declaration)
        for c in head.ids:
            if c not in df.columns:
                raise ValueError(f"{head.name} has no column {c}")
        self.sources[head.name or ""] = Source(df, head.ids, (seq,) if isinstance(seq, str) else tuple(seq))
        return self

    def map(self, values: str, source: str, mapper: Mapper | str | Sequence[Expr] | None = None) -> Mapped:
        return Mapped(self).map(values, source, mapper)

    def _add(self, spec: ViewSpec) -> View:
        if spec.name in self.sources:
            raise ValueError(f"{spec.name} is a source")
        self.views[spec.name] = spec
        return View(self, spec)

    def plan(self, *names: str) -> list[ViewSpec]:
        """Views in the order to build them in; unknown names and cycles raise."""
        for n in names:
            if n not in self.views:
                raise ValueError(f"no view {n}")
        out = ordered(self.views, names)
        for v in out:
            for m in v.maps:
                if m.source.name not in self.sources and m.source.name not in self.views:
                    raise ValueError(f"{v.name} maps {m.source.name}, which is neither a source nor a view")
        return out

    def batch(self, name: str) -> DataFrame:
        """The view's rows: keys and values."""
        frames = {n: batch.latest(s.df, s.ids, s.seq) if s.seq and s.ids else s.df for n, s in self.sources.items()}
        for v in self.plan(name):
            frames[v.name] = batch.lower(v, frames)
        return frames[name]

    def register(self, *names: str) -> None:
        """Views as temporary SQL views, for spark.sql."""
        for n in names or tuple(self.views):
            self.batch(n).createOrReplaceTempView(f"{self.namespace}_{n}" if self.namespace else n)

    def stream(self, name: str) -> DataFrame:
        """The view's changelog: keys, values, _changed, _op; see streaming.stateful."""
        from ..streaming.stateful import lower

        return lower(self, name)

    def publish(self, name: str, publisher, checkpoint: str | None = None, every: str | None = None):
        """Send a view to a publisher: all rows at once in batch, changes when a source streams: of all that is there, or without an end at intervals such as "5 seconds"."""
        from ..sinks.publishers import publish

        return publish(self, name, publisher, checkpoint, every)
