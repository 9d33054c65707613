"""Views as stateful streams: a chain of transformWithState operators that emit only what changed.

Stage M remembers what each document emitted last; a new version emits its values anew and nulls under keys it has left.
Maps of one source share it.  Stage R keeps every document's value under its view key and emits the key's new row.  A running total
is kept as long as the reducer can take old values out of it; where it cannot (the largest value is gone, an opaque
function) the key's values are folded again.  A view with salts folds each key in buckets first, which bounds what one
update of a hot key has to read.  Folds in SQL expressions always have buckets: their stage keeps and emits a bucket's
values, which the expressions fold outside of it.

Both stages are keyed by groups, of documents and of view keys: Spark hands a stage its rows one at a time, cell by cell, and
makes an Arrow batch for each of its keys.  So rows travel as pickled lists, one for each group and task (`_dealt`), and become
columns again only where SQL reads them (`_columns`).  State is kept in pickled chunks of some hundred documents (`Packed`,
`Keyed`), as a call to the state store costs more than a chunk's pickling; an update reads and writes the chunks that it touches.

Rows of one document inside a micro-batch are put in order by the source's `seq`.  A view that is a source of another
numbers the rows of each key as it makes them.  Output: keys, values, _changed, _op (U or D), in update mode.
"""

from __future__ import annotations

import datetime
import math
import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DataType, LongType, StringType, StructField, StructType

from ..functions.mappers import PyMap, column
from ..functions.reducers import FoldExpr, PyFold, Reducer
from ..plans import batch
from ..plans.spec import ViewSpec


#: buckets of a fold in expressions
BUCKETS = 16
#: groups of a source's documents, and of a view's keys; checkpoints depend on it
GROUPS = 1024
#: rows, and bytes, that a task holds before it hands them on
HELD, HELD_BYTES = 200_000, 64 << 20


def plain(x: Any) -> Any:
    """Rows and lists of them as tuples, to compare and keep."""
    if isinstance(x, dict):
        x = tuple(x.values())
    return tuple(plain(v) for v in x) if isinstance(x, (Row, list, tuple)) else x


def same(x: Any) -> Any:
    """A plain key as what grouping in SQL tells apart: one zero, one NaN, instants whatever their zone."""
    if isinstance(x, tuple):
        return tuple(map(same, x))
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else x + 0.0
    return x.astimezone(datetime.timezone.utc) if isinstance(x, datetime.datetime) and x.tzinfo else x


def one_zero(x: Any) -> Any:
    """A plain key as grouping in SQL gives it back."""
    return tuple(map(one_zero, x)) if isinstance(x, tuple) else x + 0.0 if isinstance(x, float) else x


def values(column: pa.Array) -> list:
    """A column's plain values, worked off by leaves."""
    kind = column.type
    if pa.types.is_struct(kind):
        out: list = list(zip(*map(values, column.flatten()))) if kind.num_fields else [()] * len(column)
        return [x if there else None for x, there in zip(out, column.is_valid().to_pylist())] if column.null_count else out
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        flat, at, out = values(column.flatten()), 0, []
        for n in column.value_lengths().to_pylist():
            out.append(None if n is None else tuple(flat[at : at + n]))
            at += n or 0
        return out
    if pa.types.is_integer(kind) and not column.null_count:
        return column.to_numpy().tolist()
    return [plain(x) for x in column.to_pylist()] if pa.types.is_nested(kind) else column.to_pylist()


def array(given: list, kind: pa.DataType) -> pa.Array:
    """Plain values as a column."""
    if pa.types.is_struct(kind) and kind.num_fields:
        fields = [array([None if v is None else v[i] for v in given], f.type) for i, f in enumerate(kind)]
        return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pa.array([v is None for v in given], pa.bool_()))
    if pa.types.is_list(kind):
        ends = [0]
        for v in given:
            ends.append(ends[-1] + len(v or ()))
        flat = array([x for v in given for x in v or ()], kind.value_type)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=kind, mask=pa.array([v is None for v in given], pa.bool_()))
    return pa.array(given, kind)


class Packed:
    """The documents of a state's key, and something kept beside them: one pickled value while there are few, chunks by hash when there are many.

    `open` it for the key whose turn it is, `close` it when that is done.  One chunk is held at a time, so documents are
    best worked off in the order of `placed`.
    """

    def __init__(self, handle: Any, most: int = 256, weight: Callable[[Any], int] = lambda value: 1):
        self.head = handle.getValueState("head", "v binary")
        self.chunks = handle.getMapState("chunks", "n int", "v binary")
        self.most, self.weight = most, weight

    def open(self) -> Any:
        held = self.head.get()
        self.kept, self.count, self.level, self.chunk = pickle.loads(held[0]) if held else (None, 0, 0, {})
        self.at, self.changed = (None, False) if self.level else (0, False)
        return self.kept

    def _place(self, doc: tuple) -> int:
        return zlib.crc32(repr(doc).encode()) & ((1 << self.level) - 1) if self.level else 0

    def placed(self, docs: Iterable[tuple]) -> Iterable[tuple]:
        return sorted(docs, key=self._place) if self.level else docs

    def _read(self, place: int) -> dict[tuple, Any]:
        return pickle.loads(self.chunks.getValue((place,))[0])

    def _write(self, place: int, chunk: dict[tuple, Any]) -> None:
        self.chunks.updateValue((place,), (pickle.dumps(chunk, 5),))

    def _turn(self, place: int | None) -> None:
        if place != self.at:
            if self.changed:
                self._write(self.at, self.chunk)
            self.at, self.changed, self.chunk = place, False, {} if place is None else self._read(place)

    def get(self, doc: tuple) -> Any:
        self._turn(self._place(doc))
        return self.chunk.get(doc)

    def put(self, doc: tuple, value: Any) -> None:
        """None takes the document out."""
        self._turn(self._place(doc))
        self.count += (0 if value is None else self.weight(value)) - (self.weight(self.chunk[doc]) if doc in self.chunk else 0)
        if value is not None:
            self.chunk[doc], self.changed = value, True
        elif doc in self.chunk:
            del self.chunk[doc]
            self.changed = True

    def items(self) -> Iterator[tuple[tuple, Any]]:
        for place in range(1 << self.level):
            self._turn(place)
            yield from self.chunk.items()

    def close(self, kept: Any = None) -> None:
        if self.count > self.most << self.level:
            old, self.level = self.level, (2 * self.count // self.most).bit_length()
            for place in range(1 << old):
                self._turn(place)
                parts: dict[int, dict[tuple, Any]] = {k: {} for k in range(place, 1 << self.level, 1 << old)}
                for doc, value in self.chunk.items():
                    parts[self._place(doc)][doc] = value
                self.changed = False
                for k, chunk in parts.items():
                    self._write(k, chunk)
            self.at, self.chunk = None, {}
        elif self.level:
            self._turn(None)
        self.head.update((pickle.dumps((kept, self.count, self.level, {} if self.level else self.chunk), 5),))


class _Own:
    """The states of one key among others of its kind, for `Packed`."""

    def __init__(self, heads: Any, chunks: Any, key: tuple):
        self.heads, self.chunks, self.key = heads, chunks, repr(key).encode()

    def getValueState(self, *_: Any) -> _Own:
        return self

    getMapState = getValueState

    def get(self) -> tuple | None:
        return self.heads.getValue((self.key,))

    def update(self, value: tuple) -> None:
        self.heads.updateValue((self.key,), value)

    def getValue(self, n: tuple) -> tuple | None:
        return self.chunks.getValue((self.key, *n))

    def updateValue(self, n: tuple, value: tuple) -> None:
        self.chunks.updateValue((self.key, *n), value)


class _Few:
    """A key's documents in memory, used as `Packed` is."""

    def __init__(self, documents: dict[tuple, Any]):
        self.documents = documents
        self.get, self.items = documents.get, documents.items

    @property
    def count(self) -> int:
        return len(self.documents)

    def placed(self, docs: Iterable[tuple]) -> Iterable[tuple]:
        return docs

    def put(self, doc: tuple, value: Any) -> None:
        if value is None:
            self.documents.pop(doc, None)
        else:
            self.documents[doc] = value


class Keyed:
    """A group's keys: what is kept of each and its documents, which have states of their own where a key has many.

    `keys` are opened and closed for a group, and in between each of them in turn.
    """

    def __init__(self, handle: StatefulProcessorHandle, most: int = 256):
        self.keys = Packed(handle, 8 * most, lambda entry: 1 + entry[2])
        self.own = handle.getMapState("own", "k binary", "v binary"), handle.getMapState("own_chunks", "k binary, n int", "v binary")
        self.most = most

    def open(self, key: tuple) -> tuple[Any, Packed | _Few]:
        """What is kept, and the documents."""
        kept, few, _ = self.keys.get(key) or (None, {}, 0)
        if few is not None:
            return kept, _Few(few)
        documents = Packed(_Own(*self.own, key), self.most)
        return documents.open(), documents

    def close(self, key: tuple, kept: Any, documents: Packed | _Few) -> None:
        if isinstance(documents, _Few) and documents.count > self.most:
            few, documents = documents, Packed(_Own(*self.own, key), self.most)
            documents.open()
            for doc, value in few.items():
                documents.put(doc, value)
            self.keys.put(key, (None, None, 0))
        if isinstance(documents, _Few):
            self.keys.put(key, (kept, documents.documents, documents.count))
        else:
            documents.close(kept)


PICKLED, DEALT = "_rows binary", "_group int, _rows binary"
Turn = Callable[[tuple], tuple[int, tuple] | None]


def _group(x: Any) -> int:
    return zlib.crc32(repr(x).encode()) % GROUPS


def _dealt(df: DataFrame, turn: Turn) -> DataFrame:
    """Pickled rows by group from pickled rows, or from rows of columns; `turn` gives a row's group and what goes there, or None."""
    pickled = df.columns == ["_rows"]

    def out(groups: dict[int, list]) -> Iterator[pa.RecordBatch]:
        numbers, cells, size = [], [], 0
        for n, held in groups.items():
            numbers.append(n)
            cells.append(pickle.dumps(held, 5))
            size += len(cells[-1])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(cells, pa.binary())], names=["_group", "_rows"])
                numbers, cells, size = [], [], 0
        if numbers:
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(cells, pa.binary())], names=["_group", "_rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list] = {}
        n = size = 0
        for batch in batches:
            parts = map(pickle.loads, batch.column(0).to_pylist()) if pickled else [zip(*map(values, batch.columns))]
            for rows in parts:
                for row in rows:
                    to = turn(row)
                    if to is not None:
                        groups.setdefault(to[0], []).append(to[1])
                        n += 1
            size += batch.nbytes
            if n > HELD or size > HELD_BYTES:
                yield from out(groups)
                groups, n, size = {}, 0, 0
        yield from out(groups)

    return df.mapInArrow(run, DEALT)


def _columns(df: DataFrame, kind: StructType) -> DataFrame:
    """Pickled rows as columns."""
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                cols = zip(*pickle.loads(cell.as_py()))
                yield pa.RecordBatch.from_arrays([array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


class _Stage(StatefulProcessor):
    """Takes a group's pickled rows and gives pickled rows."""

    def made(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        one, held = Row("_rows"), []
        for row in self.made(x for r in rows for x in pickle.loads(r["_rows"])):
            held.append(row)
            if len(held) == 10_000:
                yield one(pickle.dumps(held, 5))
                held = []
        if held:
            yield one(pickle.dumps(held, 5))

    def close(self) -> None:
        pass


class Diff(_Stage):
    """Of documents (id, seq, rows): the rows that each one's newest version emits (map, keys, values), against what was emitted before.

    Gives map, id, seq, gone, keys, values.
    """

    def __init__(self, n_keys: int, n_values: int):
        self.n_keys, self.n_values = n_keys, n_values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.documents = Packed(handle, 1024)

    def made(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        newest: dict[tuple, tuple[tuple, tuple]] = {}
        for name, seq, emitted in rows:
            doc = (name,)
            if doc not in newest or seq > newest[doc][0]:
                newest[doc] = (seq, emitted or ())
        self.documents.open()
        n, nulls = self.n_keys + 1, (None,) * self.n_values
        for doc in self.documents.placed(newest):
            (seq, emitted), last = newest[doc], self.documents.get(doc) or ((), ())
            if last[0] > seq:
                continue
            self.documents.put(doc, (seq, emitted))
            if last[1]:
                kept = {r[:n] for r in emitted}
                for k in dict.fromkeys(r[:n] for r in last[1] if r[:n] not in kept):
                    yield k[0], *doc, seq, True, *k[1:], *nulls
            for r in emitted:
                yield r[0], *doc, seq, False, *r[1:]
        self.documents.close()


class _ByKey(_Stage):
    """Takes rows of map, id, seq, gone, keys, values; works off the keys of a group in turn."""

    def __init__(self, n_keys: int):
        self.n_keys = n_keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = Keyed(handle)

    def joined(self, key: tuple, a: Any, b: Any) -> Any:
        """Two values of one version of a document."""
        raise NotImplementedError

    def one(self, value: tuple) -> Any:
        return value

    def turn(self, key: tuple, newest: dict[tuple, tuple[tuple, Any]], kept: Any, documents: Packed | _Few) -> tuple[Any, tuple]:
        """What is kept from now on, and the key's new row, from (version, value or None) of each document's newest version."""
        raise NotImplementedError

    def made(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        keys: dict[tuple, tuple[tuple, dict[tuple, tuple[tuple, Any]]]] = {}
        for source, name, at, gone, *rest in rows:
            key, doc = tuple(rest[: self.n_keys]), (source, name)
            k = same(key)
            if k not in keys:
                keys[k] = one_zero(key), {}
            key, newest = keys[k]
            value, have = None if gone else self.one(tuple(rest[self.n_keys :])), newest.get(doc)
            if have is None or at > have[0] or (at == have[0] and have[1] is None):
                newest[doc] = (at, value)
            elif at == have[0] and value is not None:
                newest[doc] = (at, self.joined(key, have[1], value))
        self.state.keys.open()
        for k in self.state.keys.placed(keys):
            key, newest = keys[k]
            kept, documents = self.state.open(k)
            kept, row = self.turn(key, newest, kept, documents)
            self.state.close(k, kept, documents)
            yield *key, *row
        self.state.keys.close()


class Gather(_ByKey):
    """Of each key and bucket every document's values, and what they were, in the order of documents; and a version."""

    def joined(self, key: tuple, a: Any, b: Any) -> Any:
        return (*a, *b)

    def one(self, value: tuple) -> Any:
        return (value,)

    @staticmethod
    def _listed(documents: Packed | _Few) -> tuple:
        return tuple(x for _, v in sorted(documents.items(), key=lambda x: x[0]) for x in v)

    def turn(self, key, newest, kept, documents):
        version, was = (kept or 0) + 1, self._listed(documents)
        for doc in documents.placed(newest):
            documents.put(doc, newest[doc][1])
        return version, (self._listed(documents), was, (version,))


class Fold(_ByKey):
    """Of each key (and bucket) every document's value, and the total; gives values, version, whether they changed, operation."""

    def __init__(self, reducer: Reducer, n_keys: int, n_own: int, n_values: int, final: bool):
        super().__init__(n_keys)
        self.reducer, self.n_own, self.n_values, self.final = reducer, n_own, n_values, final

    def joined(self, key: tuple, a: tuple | None, b: tuple) -> tuple:
        if a is None:
            return b
        return plain(self.reducer.step(key[: self.n_own], a, b) if isinstance(self.reducer, PyFold) else self.reducer.fold(a, b))

    def _refold(self, key: tuple, documents: Packed | _Few) -> tuple | None:
        total = None
        held = documents.items()
        for _, v in sorted(held, key=lambda x: x[0]) if isinstance(self.reducer, PyFold) else held:
            total = self.joined(key, total, v)
        return total

    def turn(self, key, newest, kept, documents):
        before, version = kept or (None, 0)
        total, exact, added = before, self.reducer.inverse is not None, []
        for doc in documents.placed(newest):
            old, value = documents.get(doc), newest[doc][1]
            documents.put(doc, value)
            if value is not None:
                added.append(value)
            if exact and old is not None:
                total = plain(self.reducer.inverse(total, old))
                exact = total is not None
        if not documents.count:
            total = None
        elif exact:
            total = None if documents.count == len(added) else total
            for v in added:
                total = self.joined(key, total, v)
        else:
            total = self._refold(key, documents)
        # the key's rows are numbered as they are made: what reads this view must take the last one, whatever its documents' order
        version += 1
        shown = [None if t is None else plain(self.reducer.finish(t)) if self.final else t for t in (before, total)]
        out = (None,) * self.n_values if shown[1] is None else shown[1]
        return (total, version), (*out, (version,), shown[0] != shown[1], "D" if shown[1] is None else "U")


def _longs(c, kind: DataType):
    """A seq column as a long that sorts alike."""
    return F.unix_micros(c.cast("timestamp")) if kind.typeName().startswith("timestamp") else c.cast("long")


def _listed(view: ViewSpec, number: int) -> Column:
    """What one map of a view emits for a record: an array of structs _src, keys, values."""
    m, names = view.maps[number], [*view.keys, *view.values]
    there = batch.defined(m.values, m.source.ids)
    if isinstance(m.mapper, PyMap):
        rows = m.mapper.listed(m.values, len(names), there)
    else:
        emitted = m.mapper.listed(m.values, len(names))
        rows = F.when(there, emitted).otherwise(F.slice(emitted, 1, 0))
    return F.transform(rows, lambda r: F.struct(F.lit(m.name or str(number)).alias("_src"), *[r[f"_{i}"].alias(n) for i, n in enumerate(names)]))


def _staged(df: DataFrame, stage: _Stage) -> DataFrame:
    return df.groupBy("_group").transformWithState(stage, PICKLED, "Update", "None")


def _diffed(df: DataFrame, view: ViewSpec, numbers: list[int], seq: list[str], kind: StructType) -> DataFrame:
    """Maps of one source through stage M: pickled rows _src, _id, _seq, _gone, keys, values."""
    own = view.maps[numbers[0]].source.ids
    order = F.col("_seq") if seq == ["_seq"] else F.array(*[_longs(F.col(c), df.schema[c].dataType) for c in seq])
    ids = F.array(*[F.col(c).cast("string") for c in own]) if own else F.array().cast("array<string>")
    rows = [_listed(view, i) for i in numbers]
    rows = (F.concat(*rows) if len(rows) > 1 else rows[0]).cast(ArrayType(kind))
    one = df.select(F.to_json(ids).alias("_id"), order.alias("_seq"), rows.alias("_emitted"))
    return _staged(_dealt(one, lambda r: (_group(r[0]), r)), Diff(len(view.keys), len(view.values)))


def _alike(view: ViewSpec, frames: dict[str, DataFrame]) -> list[list[int]]:
    """The numbers of maps that can share a stage M: of one source and its ids, with rows of one type."""
    alike: dict[tuple, list[int]] = {}
    for i, m in enumerate(view.maps):
        kind = frames[m.source.name or ""].select(_listed(view, i).alias("_r")).schema["_r"].dataType
        alike.setdefault((m.source.name, m.source.ids, kind.simpleString()), []).append(i)
    return list(alike.values())


def lower_view(view: ViewSpec, frames: dict[str, DataFrame], seqs: dict[str, list[str]]) -> DataFrame:
    """keys, values, _seq, _changed, _op."""
    keys, names, parts, kind, staged = list(view.keys), list(view.values), None, None, []
    for numbers in _alike(view, frames):
        staged.append((name := view.maps[numbers[0]].source.name or "", numbers))
        row = frames[name].select(F.explode(_listed(view, numbers[0])).alias("_r")).select("_r.*")
        kind = row if kind is None else kind.unionByName(row)
    for name, numbers in staged:
        one = _diffed(frames[name], view, numbers, seqs[name], kind.schema)
        parts = one if parts is None else parts.union(one)
    own, n = [StructField(k, kind.schema[k].dataType) for k in keys], len(keys)
    kinds = StructType([StructField(v, kind.schema[v].dataType) for v in names])
    version, salt = StructField("_seq", ArrayType(LongType())), StructField("_salt", LongType())
    folded = [version, StructField("_changed", BooleanType()), StructField("_op", StringType())]

    def fold(dealt: DataFrame, by: list[StructField], final: bool) -> DataFrame:
        return _staged(dealt, Fold(view.reducer, len(by), n, len(names), final))

    def by_expressions(dealt: DataFrame, by: list[StructField]) -> DataFrame:
        rows = [StructField("_rows", ArrayType(kinds)), StructField("_was", ArrayType(kinds))]
        gathered = _columns(_staged(dealt, Gather(len(by))), StructType([*by, *rows, version]))
        now, was = (view.reducer.over(c, kinds) for c in ("_rows", "_was"))
        gone = F.size("_rows") == 0
        named = [f.name for f in by]
        return gathered.select(*named, "_seq", now.alias("_v"), (~now.eqNullSafe(was)).alias("_changed"), F.when(gone, "D").otherwise("U").alias("_op")).select(*named, "_v.*", "_seq", "_changed", "_op")

    def to_key(r: tuple) -> tuple[int, tuple]:
        return _group(same(r[4 : 4 + n])), r

    def to_bucket(r: tuple) -> tuple[int, tuple]:
        key = (*r[4 : 4 + n], zlib.crc32(repr(r[:2]).encode()) % salts)
        return _group(same(key)), (*r[:4], *key, *r[4 + n :])

    def from_bucket(r: tuple) -> tuple[int, tuple] | None:
        """A bucket is a document of its key."""
        *row, at, changed, op = r
        return to_key(("", str(row[n]), at, op == "D", *row[:n], *row[n + 1 :])) if changed else None

    expressions = isinstance(view.reducer, FoldExpr)
    salts = max(view.salts, BUCKETS) if expressions else view.salts
    if salts > 1:
        split = _dealt(parts, to_bucket)
        dealt = _dealt(by_expressions(split, [*own, salt]) if expressions else fold(split, [*own, salt], False), from_bucket)
    else:
        dealt = _dealt(parts, to_key)
    out = by_expressions(dealt, own) if expressions else _columns(fold(dealt, own, True), StructType([*own, *kinds.fields, *folded]))
    if view.formats:
        there = F.lit(True)
        for v in names:
            there &= F.col(v).isNotNull()
        out = out.select(*keys, *[F.when(there, column(f)).alias(n) for f, n in zip(view.formats, view.format_values)], "_seq", "_changed", "_op")
    return out


def lower(engine, name: str) -> DataFrame:
    """All views below `name` as one streaming query."""
    frames, seqs = {}, {}
    for n, s in engine.sources.items():
        frames[n], seqs[n] = s.df, list(s.seq)
    for v in engine.plan(name):
        for m in v.maps:
            if not seqs[m.source.name or ""]:
                raise ValueError(f"{m.source.name} streams and needs a seq column that orders its versions")
        frames[v.name] = lower_view(v, frames, seqs)
        seqs[v.name] = ["_seq"]
    return frames[name].drop("_seq")
