"""Messages of a document cluster: updates, and changes with the document they lead to.

An update is {"table", "key", "value", "ts", "uuid"}, a change {"table", "key", "update", "ts", "uuid", "snapshot"}; key is
a list of text, value, update and snapshot are documents: objects whose members are columns, or relations (objects of
child documents by id).  In long form a document is one row a column (`docstore.LONG`).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPDATE = "table string, key array<string>, value variant, ts long, uuid string"
CHANGE = "table string, key array<string>, update variant, ts long, uuid string, snapshot variant"
#: relations within relations, two levels of names each
DEPTH = 8


def columns_of(document: str, depth: int = DEPTH) -> Column:
    """An object (variant) as array<struct<path, value>>: its columns in long form, values as JSON text.

    An object without members has no columns.  Objects nested deeper than `depth` names raise.
    """
    inner = "startswith(schema_of_variant(c.value), 'OBJECT')"
    entry = "transform(map_entries(cast(c.value as map<string,variant>)), e -> struct(concat(c.path, array(e.key)) as path, e.value as value))"
    cells = f"array(struct(cast(array() as array<string>) as path, {document} as value))"
    for _ in range(depth):
        cells = f"flatten(transform({cells}, c -> if({inner}, {entry}, array(c))))"
    too_deep = f"raise_error('a document has more than {depth} names on the way to a column')"
    return F.expr(f"transform({cells}, c -> if({inner}, cast({too_deep} as struct<path:array<string>,value:string>), struct(c.path as path, coalesce(to_json(c.value), 'null') as value)))")


def _read(messages: DataFrame, schema: str, value: str, meta: Sequence[str]) -> DataFrame:
    text = F.col(value).cast("string")
    return messages.select(*meta, F.from_json(text, schema).alias("_m")).where("_m.table is not null and _m.key is not null and _m.ts is not null")


def updates(messages: DataFrame, value: str = "value", meta: Sequence[str] = ()) -> DataFrame:
    """Update messages (bytes or text) in long form.  Broken ones, and those without table, key or ts, are dropped; an absent uuid is ''."""
    found = _read(messages, UPDATE, value, meta).where("startswith(schema_of_variant(_m.value), 'OBJECT')")
    cells = found.select(*meta, "_m.table", "_m.key", F.explode(columns_of("_m.value")).alias("_c"), "_m.ts", "_m.uuid")
    return cells.select(*meta, "table", "key", "_c.path", "_c.value", "ts", F.coalesce("uuid", F.lit("")).alias("uuid"))


def changes(messages: DataFrame, value: str = "value", meta: Sequence[str] = ()) -> DataFrame:
    """Change messages, a row each: table, key, update and snapshot as array<struct<path, value>>, timestamp, uuid."""
    part = lambda name: F.when(F.expr(f"startswith(schema_of_variant(_m.{name}), 'OBJECT')"), columns_of(f"_m.{name}")).alias(name)
    return _read(messages, CHANGE, value, meta).select(*meta, "_m.table", "_m.key", part("update"), F.col("_m.ts").alias("timestamp"), F.coalesce("_m.uuid", F.lit("")).alias("uuid"), part("snapshot"))


def nested(cells: Sequence[dict]) -> str:
    """Columns in long form as one JSON object; a name cannot be a column and a relation at once."""
    out: dict = {}
    for cell in sorted(cells, key=lambda c: list(c["path"])):
        at = out
        for name in cell["path"][:-1]:
            at = at.setdefault(name, {})
            if not isinstance(at, dict):
                raise ValueError(f"{'/'.join(cell['path'])} lies below a column")
        at[cell["path"][-1]] = json.loads(cell["value"]) if cell["value"] is not None else None
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def _document(cells: pd.Series) -> pd.Series:
    return cells.map(lambda c: nested(c) if c is not None else "{}")


def _cells() -> Column:
    return F.collect_list(F.struct("path", "value"))


def _message(members: dict[str, Column]) -> Column:
    parts = [F.concat(F.lit(("{" if i == 0 else ",") + json.dumps(name) + ":"), F.coalesce(text, F.lit("null"))) for i, (name, text) in enumerate(members.items())]
    return F.concat(*parts, F.lit("}"))


def _quoted(c: str) -> Column:
    return F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def update_messages(rows: DataFrame) -> DataFrame:
    """Long form as update messages: `key` (JSON of table and key) and `value`; what has one table, key, ts and uuid is one message."""
    made = rows.groupBy("table", "key", "ts", "uuid").agg(_cells().alias("cells")).withColumn("doc", _document("cells"))
    return made.select(_key(), _message({"table": _quoted("table"), "key": _quoted("key"), "value": F.col("doc"), "ts": F.col("ts").cast("string"), "uuid": _quoted("uuid")}).alias("value"))


def change_messages(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Changes in long form as change messages, each with its document as the snapshot has it now."""
    made = rows.groupBy("table", "key", "ts", "uuid").agg(_cells().alias("cells"))
    now = snapshot.groupBy("table", "key").agg(_cells().alias("now"))
    made = made.join(now, ["table", "key"], "left").withColumns({"doc": _document("cells"), "whole": _document("now")})
    return made.select(_key(), _message({"table": _quoted("table"), "key": _quoted("key"), "update": F.col("doc"), "ts": F.col("ts").cast("string"), "uuid": _quoted("uuid"), "snapshot": F.col("whole")}).alias("value"))


def _key() -> Column:
    return F.to_json(F.concat(F.array("table"), "key")).alias("key")
