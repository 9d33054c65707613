"""Mappers: descriptions of the rows that one record emits, as Column expressions.

A mapper is given the record's declared fields as columns and says which rows of emitted values there are.  `PyMap`
is the way out for opaque Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Expr = Column | str


def column(e: object) -> Column:
    """A Column as it is, a string as a SQL expression, anything else as a literal."""
    return e if isinstance(e, Column) else F.expr(e) if isinstance(e, str) else F.lit(e)


class Mapper:
    def rows(self, df: DataFrame, fields: Sequence[str], arity: int) -> DataFrame:
        """_doc and the emitted values as _0 … _{arity-1}."""
        raise NotImplementedError

    def listed(self, fields: Sequence[str], arity: int) -> Column:
        """What one record emits as an array of structs _0 … _{arity-1}: the form that keeps a record's rows together."""
        raise TypeError(f"{type(self).__name__} has no column form, which a stream needs")


def _emitted(values: Sequence[Column], arity: int) -> list[Column]:
    if len(values) < arity:
        raise ValueError(f"{len(values)} values are emitted where keys and values need {arity}")
    return [v.alias(f"_{i}") for i, v in enumerate(values[:arity])]  # further values are dropped


class Emit(Mapper):
    """One row of expressions, where `when` holds."""

    def __init__(self, *values: Expr, when: Expr | None = None):
        self.values, self.when = values, when

    def rows(self, df, fields, arity):
        df = df if self.when is None else df.where(column(self.when))
        return df.select("_doc", *_emitted([column(v) for v in self.values], arity))

    def listed(self, fields, arity):
        row = F.array(F.struct(*_emitted([column(v) for v in self.values], arity)))
        return row if self.when is None else F.when(column(self.when), row).otherwise(F.slice(row, 1, 0))


class EmitAll(Mapper):
    """Several rows of each record, in one pass: an array of structs is exploded."""

    def __init__(self, *emits: Emit):
        self.emits = emits

    def rows(self, df, fields, arity):
        return df.select("_doc", F.explode(self.listed(fields, arity)).alias("_e")).select("_doc", "_e.*")

    def listed(self, fields, arity):
        return F.concat(*[e.listed(fields, arity) for e in self.emits])


class FlatMap(Mapper):
    """A row for each element of an array; the element goes by `name` in the emitted expressions."""

    def __init__(self, array: Expr, name: str, emit: Emit):
        self.array, self.name, self.emit = array, name, emit

    def rows(self, df, fields, arity):
        return self.emit.rows(df.withColumn(self.name, F.explode(column(self.array))), fields, arity)

    def listed(self, fields, arity):
        columns = [v for v in (*self.emit.values, *([] if self.emit.when is None else [self.emit.when]), self.array) if not isinstance(v, str)]
        if columns:
            raise TypeError("a flat map in a stream takes SQL expressions, so that the element has its name")
        row = f"named_struct({', '.join(f"'_{i}', {v}" for i, v in enumerate(self.emit.values[:arity]))})"
        kept = self.array if self.emit.when is None else f"filter({self.array}, {self.name} -> {self.emit.when})"
        return F.expr(f"transform({kept}, {self.name} -> {row})")


class SelectAll(Mapper):
    """The declared fields by position."""

    def rows(self, df, fields, arity):
        return Emit(*[F.col(f) for f in fields]).rows(df, fields, arity)

    def listed(self, fields, arity):
        return Emit(*[F.col(f) for f in fields]).listed(fields, arity)


class Count(Mapper):
    """The group's fields and one."""

    def __init__(self, *group: str):
        self.group = group

    def rows(self, df, fields, arity):
        return self._emit().rows(df, fields, arity)

    def listed(self, fields, arity):
        return self._emit().listed(fields, arity)

    def _emit(self) -> Emit:
        return Emit(*[F.col(g) for g in self.group], F.lit(1).cast("long"))


class TopNMapper(Mapper):
    """The keys and a list of one tuple of the fields (of all declared ones if none are named)."""

    def __init__(self, *fields: str, keys: Sequence[str] = ()):
        self.fields, self.keys = fields, keys

    def rows(self, df, fields, arity):
        return self._emit(fields).rows(df, fields, arity)

    def listed(self, fields, arity):
        return self._emit(fields).listed(fields, arity)

    def _emit(self, fields: Sequence[str]) -> Emit:
        return Emit(*[F.col(k) for k in self.keys], F.array(F.struct(*(self.fields or fields))))


class PyMap(Mapper):
    """Opaque Python: a function from a record (dict) to emitted tuples, over Arrow batches; `types` are those of the values."""

    def __init__(self, function: Callable[[dict], Iterable[tuple]], *types: str):
        self.function, self.types = function, types

    def rows(self, df, fields, arity):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        if len(self.types) < arity:
            raise ValueError(f"{len(self.types)} values are emitted where keys and values need {arity}")
        schema = StructType([df.schema["_doc"], *StructType.fromDDL(", ".join(f"_{i} {t}" for i, t in enumerate(self.types[:arity]))).fields])
        arrow, function = to_arrow_schema(schema), self.function

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(r["_doc"], *e[:arity]) for r in batch.to_pylist() for e in function({f: r[f] for f in fields})]
                cols = list(zip(*out)) or [[]] * (arity + 1)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

        return df.select("_doc", *fields).mapInArrow(run, schema)

    def listed(self, fields, arity, there=None):
        """One call for a record, over Arrow batches; none for a record that is not there."""
        if len(self.types) < arity:
            raise ValueError(f"{len(self.types)} values are emitted where keys and values need {arity}")
        function, names = self.function, list(fields)

        def run(record):
            return None if record is None else [tuple(e[:arity]) for e in function({f: record[i] for i, f in enumerate(names)})]

        kind = f"array<struct<{', '.join(f'_{i}: {t}' for i, t in enumerate(self.types[:arity]))}>>"
        record = F.struct(*fields)
        emitted = F.udf(run, kind, useArrow=True)(record if there is None else F.when(there, record))
        return F.coalesce(emitted, F.array().cast(kind))
