"""Reducers: associative, commutative folds of value tuples, as aggregates.

Each gives Column aggregates for batch (partial aggregation comes with them) and a Python fold of two tuples, which the
stateful stream uses.  A value that stands alone in its group passes through.  `inverse` takes a value back out of a
total, or gives None where the total has to be folded anew; streams keep a running total as long as it does not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Reducer:
    #: whether the aggregate must see whole tuples in document order
    opaque = False

    def aggregates(self, values: Sequence[str]) -> list[Column]:
        raise NotImplementedError

    def fold(self, a: tuple, b: tuple) -> tuple:
        raise NotImplementedError

    def finish(self, total: tuple) -> tuple:
        return total

    inverse: Callable[[tuple, tuple], tuple] | None = None


def _one(r: Reducer, a, b):
    return b if a is None else a if b is None else r.fold((a,), (b,))[0]


class Sum(Reducer):
    """Column by column; nulls are left out; an overflow of long is an error."""

    def aggregates(self, values):
        return [F.sum(v).alias(v) for v in values]

    def fold(self, a, b):
        return tuple(y if x is None else x if y is None else x + y for x, y in zip(a, b))

    def inverse(self, total, old):  # type: ignore[override]
        """Exact for integers and decimals only; a difference of zero may be a sum of nothing, which is null."""
        out = tuple(x if y is None else None if x is None else x - y for x, y in zip(total, old))
        again = any(isinstance(x, float) for x in (*total, *old)) or any(y is not None and not z for y, z in zip(old, out))
        return None if again else out


class _Extreme(Reducer):
    pick: Callable

    def aggregates(self, values):
        # whole tuples, compared from the first column on; a null is lowest
        whole = (F.min if self.pick is min else F.max)(F.struct(*values))
        return [whole[v].alias(v) for v in values]

    def fold(self, a, b):
        key = lambda t: tuple((v is not None, v) for v in t)
        return type(self).pick((a, b), key=key)

    def inverse(self, total, old):  # type: ignore[override]
        """What is not the extreme leaves it alone."""
        return None if total == old else total


class MinValue(_Extreme):
    pick = min


class MaxValue(_Extreme):
    pick = max


class Union(Reducer):
    """Each column by its own reducer; a null side lets the other through."""

    def __init__(self, *reducers: Reducer):
        self.reducers = reducers

    def aggregates(self, values):
        if len(values) != len(self.reducers):
            raise ValueError(f"{len(self.reducers)} reducers for {len(values)} columns")
        out = []
        for r, v in zip(self.reducers, values):
            if isinstance(r, _Extreme):
                out.append((F.min if r.pick is min else F.max)(v).alias(v))
            else:
                out += r.aggregates([v])
        return out

    def fold(self, a, b):
        return tuple(_one(r, x, y) for r, x, y in zip(self.reducers, a, b))

    def finish(self, total):
        return tuple(r.finish((x,))[0] for r, x in zip(self.reducers, total))

    def inverse(self, total, old):  # type: ignore[override]
        out = []
        for r, x, y in zip(self.reducers, total, old):
            left = (x,) if y is None else None if x is None or r.inverse is None else r.inverse((x,), (y,))
            if left is None:
                return None
            out.append(left[0])
        return tuple(out)


class TopN(Reducer):
    """The n largest (or smallest) distinct tuples of one list column, in order."""

    def __init__(self, n: int, ascending: bool = False):
        self.n, self.ascending = n, ascending

    def aggregates(self, values):
        return [F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(v))), self.ascending), 1, self.n).alias(v) for v in values]

    def fold(self, a, b):
        return self.finish(([*(a[0] or ()), *(b[0] or ())],))

    def finish(self, total):
        if total[0] is None:
            return total
        distinct = {tuple(x): x for x in total[0]}
        key = lambda t: tuple((v is not None, v) for v in t)
        return ([distinct[t] for t in sorted(distinct, key=key, reverse=not self.ascending)][: self.n],)

    def inverse(self, total, old):  # type: ignore[override]
        """What is not among the first leaves them alone."""
        first = {tuple(x) for x in total[0] or ()}
        return None if any(tuple(x) in first for x in old[0] or ()) else total


class CollectSet(Reducer):
    """The sorted distinct elements of one list column."""

    def aggregates(self, values):
        return [F.array_sort(F.array_distinct(F.flatten(F.collect_set(v)))).alias(v) for v in values]

    def fold(self, a, b):
        return self.finish(([*(a[0] or ()), *(b[0] or ())],))

    def finish(self, total):
        return total if total[0] is None else (sorted(set(total[0])),)


class FirstNonNull(Reducer):
    """The value that is there; of several the largest, so the result does not depend on order."""

    def aggregates(self, values):
        return [F.max(v).alias(v) for v in values]

    def fold(self, a, b):
        return tuple(y if x is None else x if y is None else max(x, y) for x, y in zip(a, b))

    def inverse(self, total, old):  # type: ignore[override]
        return None if any(y is not None and x == y for x, y in zip(total, old)) else total


class BoolOr(Reducer):
    def aggregates(self, values):
        return [F.bool_or(v).alias(v) for v in values]

    def fold(self, a, b):
        return tuple(y if x is None else x if y is None else x or y for x, y in zip(a, b))

    def inverse(self, total, old):  # type: ignore[override]
        return total if all(y is None for y in old) else None


class FoldExpr(Reducer):
    """A fold in SQL expressions over ``a.col`` and ``b.col``, one for each value.

    As every reducer it must be associative and commutative: parts of a key are folded first, each in the order of
    sources and ids, and then in the order of their first documents.  A value keeps the type that its maps emit.
    """

    opaque = True

    def __init__(self, *expressions: str):
        self.expressions = expressions

    def over(self, rows: str, values: StructType) -> Column:
        """The fold of the array of structs (values) in the column `rows`; null of an empty one."""
        made = ", ".join(f"'{v.name}', cast({e} as {v.dataType.simpleString()})" for v, e in zip(values, self.expressions, strict=True))
        return F.expr(f"aggregate(slice({rows}, 2, greatest(size({rows}) - 1, 0)), get({rows}, 0), (a, b) -> named_struct({made}))")


class PyFold(Reducer):
    """Opaque Python: (key, a, b) or (a, b) to a tuple; associative and commutative, as FoldExpr."""

    opaque = True

    def __init__(self, function: Callable[..., tuple]):
        import inspect

        self.function, self.keyed = function, len(inspect.signature(function).parameters) == 3

    def step(self, key: tuple, a: tuple, b: tuple) -> tuple:
        return tuple(self.function(key, a, b) if self.keyed else self.function(a, b))

    def fold(self, a, b):
        return self.step((), a, b)
