"""Changelogs of views in batch: what each update of a record makes of the rows it concerns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by(seq: str | Sequence[str]) -> list[str]:
    return [seq] if isinstance(seq, str) else list(seq)


def moved_keys(updates: DataFrame, ids: Sequence[str], seq: str | Sequence[str], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every update of a record as row changes: its new value under its key, nulls under a key it has left.

    A version whose values or keys have a null deletes the record.
    """
    order = Window.partitionBy(*ids).orderBy(*_by(seq))
    now = F.when(~F.array_contains(F.array(*[F.col(c).isNull() for c in (*keys, *values)]), True), F.struct(*keys, *values))
    x = updates.select(*ids, *_by(seq), now.alias("_now")).withColumn("_before", F.lag("_now").over(order))
    gone = F.col("_before").isNotNull() & (F.col("_now").isNull() | ~F.struct(*[F.col(f"_before.{k}") for k in keys]).eqNullSafe(F.struct(*[F.col(f"_now.{k}") for k in keys])))
    key = lambda side: [F.col(f"{side}.{k}").alias(k) for k in keys]
    left = x.where(gone).select(*ids, *_by(seq), *key("_before"), *[F.lit(None).cast(updates.schema[v].dataType).alias(v) for v in values])
    came = x.where("_now is not null").select(*ids, *_by(seq), *key("_now"), *[F.col(f"_now.{v}").alias(v) for v in values])
    return came.unionByName(left)


def changes(versions: DataFrame, keys: Sequence[str], seq: str | Sequence[str], values: Sequence[str]) -> DataFrame:
    """Of a view's row versions, those that differ from the one before, with _op U or D (all values null)."""
    order = Window.partitionBy(*keys).orderBy(*_by(seq))
    now = F.struct(*values)
    empty = F.lit(True)
    for v in values:
        empty &= F.col(v).isNull()
    x = versions.withColumn("_first", F.lag(F.lit(1)).over(order).isNull()).withColumn("_before", F.lag(now).over(order))
    # a deletion counts only after a value
    differs = F.when(F.col("_first"), ~empty).otherwise(~F.col("_before").eqNullSafe(now))
    return x.where(differs).drop("_first", "_before").withColumn("_op", F.when(empty, "D").otherwise("U"))


def difference(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What turns one state of a view into the next: upserted rows with _op U, vanished keys with nulls and _op D."""
    values = [c for c in after.columns if c not in keys]
    a, b = before.select(*keys, F.struct(*values).alias("_a")), after.select(*keys, F.struct(*values).alias("_b"))
    on = F.lit(True)
    left, right = a.alias("l"), b.alias("r")
    for k in keys:
        on &= F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    both = left.join(right, on, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], F.col("_b.*"), F.when(F.col("_b").isNull(), "D").otherwise("U").alias("_op"))


def prefix_sums(updates: DataFrame, ids: Sequence[str], seq: str | Sequence[str], key: str, value: str, blocks: int = 256) -> DataFrame:
    """Each update's key and the sum of its documents' latest values after it: a default stream in batch."""
    order = Window.partitionBy(*ids).orderBy(*_by(seq))
    now = F.when(F.col(key).isNotNull() & F.col(value).isNotNull(), F.struct(key, value))
    x = updates.select(*ids, *_by(seq), now.alias("_n")).withColumn("_b", F.lag("_n").over(order))
    plus = x.where("_n is not null").select(*_by(seq), F.col(f"_n.{key}").alias(key), F.col(f"_n.{value}").alias("d"), F.lit(1).alias("c"))
    minus = x.where("_b is not null").select(*_by(seq), F.col(f"_b.{key}").alias(key), (-F.col(f"_b.{value}")).alias("d"), F.lit(-1).alias("c"))
    each = plus.unionByName(minus).groupBy(key, *_by(seq)).agg(F.sum("d").alias("d"), F.sum("c").alias("c"))
    # a key's updates are added up in blocks of its order, and blocks' totals before them: no key is one task's
    first = _by(seq)[0]
    kind = each.schema[first].dataType.typeName()
    number = F.unix_micros(F.col(first).cast("timestamp")) if kind.startswith("timestamp") else F.col(first).cast("long")
    if kind in ("byte", "short", "integer", "long", "timestamp", "timestamp_ntz"):
        lo, hi = each.agg(F.min(number), F.max(number)).first()
        width = max(((hi or 0) - (lo or 0)) // blocks + 1, 1)
        each = each.withColumn("_block", F.floor((number - F.lit(lo)) / F.lit(width)).cast("long"))
    else:
        each = each.withColumn("_block", F.lit(0).cast("long"))
    run = Window.partitionBy(key, "_block").orderBy(*_by(seq)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = each.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_b")).agg(F.sum("d").alias("_d"), F.sum("c").alias("_c"))
    totals = totals.select("_key", "_b", F.sum("_d").over(before).alias("_d"), F.sum("_c").over(before).alias("_c"))
    inner = each.select(key, "_block", *_by(seq), F.sum("d").over(run).alias("_sum"), F.sum("c").over(run).alias("_n"))
    joined = inner.join(totals, (F.col(key) == F.col("_key")) & F.col("_block").eqNullSafe(F.col("_b")))
    total, n = (F.col(x) + F.coalesce(y, F.lit(0)) for x, y in (("_sum", "_d"), ("_n", "_c")))
    return joined.select(key, *_by(seq), F.when(n > 0, total).alias("total"))
