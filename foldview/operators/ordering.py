"""A total order over values of different types: null, booleans, numbers, strings, lists.

Strings compare without regard to case, and equal ones of one length by the case of their last character, lower case
first.  Columns are typed, so a key is a struct whose first field ranks the type.
"""

from __future__ import annotations

from functools import cmp_to_key

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType


def sort_key(c: Column, kind: DataType) -> Column:
    """A column that sorts as `compare` does, for a column of the given type."""
    if isinstance(kind, BooleanType):
        return F.struct(F.when(c.isNull(), 0).otherwise(1).alias("t"), c.cast("int").alias("v"))
    if isinstance(kind, NumericType):
        return F.struct(F.when(c.isNull(), 0).otherwise(2).alias("t"), c.cast("double").alias("v"))
    if isinstance(kind, StringType):
        return F.struct(F.when(c.isNull(), 0).otherwise(3).alias("t"), F.lower(c).alias("v"), (-F.ascii(F.right(c, F.lit(1)))).alias("case"))
    if isinstance(kind, ArrayType):
        return F.struct(F.when(c.isNull(), 0).otherwise(4).alias("t"), F.transform(c, lambda x: sort_key(x, kind.elementType)).alias("v"))
    raise TypeError(f"{kind.simpleString()} has no universal order")


def _rank(x: object) -> int:
    return 0 if x is None else 1 if isinstance(x, bool) else 2 if isinstance(x, (int, float)) else 3 if isinstance(x, str) else 4 if isinstance(x, (list, tuple)) else 9


def compare(a: object, b: object) -> int:
    """Negative, zero or positive, for plain Python values."""
    if _rank(a) == 9 or _rank(b) == 9:
        raise TypeError(f"no universal order for {a!r} and {b!r}")
    if _rank(a) != _rank(b):
        return _rank(a) - _rank(b)
    sign = lambda x, y: (x > y) - (x < y)
    if isinstance(a, str):
        return sign(a.lower(), b.lower()) or (-sign(a[-1:], b[-1:]) if len(a) == len(b) else 0)
    if isinstance(a, (list, tuple)):
        return next((c for c in map(compare, a, b) if c), 0) or len(a) - len(b)
    return 0 if a is None else sign(float(a), float(b))


universal = cmp_to_key(compare)
