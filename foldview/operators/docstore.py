"""Versioned documents: column by column the last write wins.

A document in long form is one row a column: table, key (list), path (list: relation, child id, …, column), value (JSON
text), ts, uuid.  Of one column the larger (ts, value) wins, so merging is associative, commutative and idempotent, and
any order of updates gives the same document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LONG = "table string, key array<string>, path array<string>, value string, ts long, uuid string"
ID = ("table", "key", "path")


def _rank(value: str = "value"):
    """JSON scalars in universal order: null, booleans, numbers, strings without regard to case."""
    v = F.col(value)
    number = v.try_cast("double")
    kind = F.when(v.isNull() | (v == "null"), 0).when(v.isin("true", "false"), 1).when(number.isNotNull(), 2).otherwise(3)
    return F.struct(kind.alias("kind"), F.when(kind == 1, F.when(v == "true", 1.0).otherwise(0.0)).otherwise(F.when(kind == 2, number)).alias("number"), F.when(kind == 3, F.lower(v)).alias("text"), F.when(kind == 3, -F.ascii(F.substring(v, -2, 1))).alias("case"))


def merge(updates: DataFrame) -> DataFrame:
    """The winning version of each column: one aggregate, so a document's history is never gathered."""
    return updates.groupBy(*ID).agg(F.max_by(F.struct("value", "ts", "uuid"), F.struct(F.col("ts"), _rank(), F.col("value"), F.col("uuid"))).alias("w")).select(*ID, "w.*")


def change_log(updates: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """The updates that change a document, in the order of (ts, uuid) arrival given by `seq` or ts: no-ops are left out.

    With a snapshot, only what wins over it is a change.
    """
    seq = ["seq"] if "seq" in updates.columns else ["ts", "uuid"]
    seen = Window.partitionBy(*ID).orderBy(*seq).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.struct(F.col("ts"), _rank(), F.col("value"))
    x = updates.withColumn("_rank", rank)
    if snapshot is not None:
        base = snapshot.select(*ID, F.struct(F.col("ts"), _rank(), F.col("value")).alias("_base"))
        x = x.join(base, list(ID), "left")
    else:
        x = x.withColumn("_base", F.lit(None).cast(x.schema["_rank"].dataType))
    x = x.withColumn("_before", F.greatest(F.max("_rank").over(seen), F.col("_base")) if snapshot is not None else F.max("_rank").over(seen))
    return x.where(F.col("_before").isNull() | (F.col("_rank") > F.col("_before"))).drop("_rank", "_base", "_before")


def subscribe(own: DataFrame, other: DataFrame) -> DataFrame:
    """A cluster's updates after it has taken another's changes; both sides converge, since no-ops make no change."""
    return merge(own.select(*ID, "value", "ts", "uuid").unionByName(other.select(*ID, "value", "ts", "uuid")))


def get(snapshot: DataFrame, table: str, key: list[str]) -> DataFrame:
    """A point read: the document's columns, if it is there."""
    return snapshot.where((F.col("table") == table) & (F.col("key") == F.array(*[F.lit(k) for k in key])))


def documents(snapshot: DataFrame) -> DataFrame:
    """table, key, doc and timestamps: maps from a column's path, joined by '/', to its value and its ts."""
    entries = F.sort_array(F.collect_list(F.struct(F.array_join("path", "/").alias("path"), "value", "ts")))
    x = snapshot.groupBy("table", "key").agg(entries.alias("e"))
    pick = lambda f: F.map_from_entries(F.transform("e", lambda c: F.struct(c["path"], c[f])))
    return x.select("table", "key", pick("value").alias("doc"), pick("ts").alias("timestamps"))


def as_json(snapshot: DataFrame) -> DataFrame:
    """table, key and the top-level columns as one JSON object (values are JSON already)."""
    own = snapshot.where(F.size("path") == 1)
    parts = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), F.get("path", F.lit(0)), F.lit('":'), F.coalesce("value", F.lit("null"))))), ",")
    return own.groupBy("table", "key").agg(F.concat(F.lit("{"), parts, F.lit("}")).alias("json"))


def flat(df: DataFrame, table: str, key: list[str], ts: str, uuid: str | None = None, prefix: tuple[str, ...] = ()) -> DataFrame:
    """Rows as updates in long form: one for each column that is neither key nor ts; `prefix` puts them under a relation."""
    columns = [c for c in df.columns if c not in (*key, ts, uuid)]
    head = [F.lit(p) if not p.startswith("$") else F.col(p[1:]).cast("string") for p in prefix]
    keys = [k for k in key if f"${k}" not in prefix]
    cells = F.explode(F.array(*[F.struct(F.array(*head, F.lit(c)).alias("path"), F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}).alias("j")) for c in columns]))
    x = df.select(F.lit(table).alias("table"), F.array(*[F.col(k).cast("string") for k in keys]).alias("key"), F.col(ts).cast("long").alias("ts"), (F.col(uuid).cast("string") if uuid else F.lit("")).alias("uuid"), cells.alias("c"))
    return x.select("table", "key", "c.path", F.expr("substring(c.j, 6, length(c.j) - 6)").alias("value"), "ts", "uuid")
