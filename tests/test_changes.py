from view_helpers import rows

from foldview.operators import changes
from foldview.operators.ordering import compare, sort_key, universal

#: id, account, amount: sent twice, a second record, replaced, one without an amount, deleted in both ways, moved
MESSAGES = [(51, 7, 60.5), (51, 7, 60.5), (52, 7, 1.25), (52, 7, 30.0), (53, 7, None), (51, 7, None), (51, None, None), (52, 8, 30.0), (52, None, None)]


def updates(spark):
    return spark.createDataFrame([(*m, i) for i, m in enumerate(MESSAGES)], "id long, account long, amount double, s long")


def test_moves_leave_the_old_key(spark):
    out = rows(changes.moved_keys(updates(spark), ["id"], "s", ["account"], ["amount"]))
    assert (51, 5, 7, None) in out and (52, 7, 7, None) in out and (52, 7, 8, 30.0) in out and (52, 8, 8, None) in out
    assert not [r for r in out if r[0] == 53]


def test_running_totals(spark):
    got = {r[1]: r[2] for r in rows(changes.prefix_sums(updates(spark), ["id"], "s", "account", "amount")) if r[0] == 7}
    assert [got[s] for s in (0, 2, 3, 5, 7)] == [60.5, 61.75, 90.5, 30.0, None]


def test_running_totals_in_blocks(spark):
    """However the order is cut into blocks, the totals are the same."""
    import random

    rnd = random.Random(5)
    said = [(rnd.randint(1, 20), rnd.choice([1, 2, None]), rnd.choice([None, *range(9)]), i * i) for i in range(200)]
    df = spark.createDataFrame(said, "id long, account long, amount long, s long")
    held, want = {}, []
    for i, account, amount, s in said:
        keys = {account, held.get(i, (None, None))[0]} - {None}
        held[i] = (account, amount) if account is not None and amount is not None else (None, None)
        for k in keys:
            now = [v for a, v in held.values() if a == k]
            want.append((k, s, sum(now) if now else None))
    for blocks in (1, 7, 1000):
        got = rows(changes.prefix_sums(df, ["id"], "s", "account", "amount", blocks))
        assert set(got) <= set(want) and len(got) > 150


def test_changes_and_difference(spark):
    v = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, None), ("b", 1, None), ("b", 2, 7)], "k string, s long, x long")
    assert rows(changes.changes(v, ["k"], "s", ["x"])) == [("a", 1, 5, "U"), ("a", 3, None, "D"), ("b", 2, 7, "U")]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    assert rows(changes.difference(a, b, ["k"])) == [(1, None, "D"), (2, "z", "U"), (3, "w", "U")]


ORDER = [None, False, True, 1, 2, 3.0, 4, "a", "A", "aa", "AA", "aaa", "AAA", "b", "B", "ba", "bb", ["a"], ["b"], ["b", "c"], ["b", "c", "a"], ["b", "d"], ["b", "d", "e"]]


def test_universal_order():
    assert sorted(reversed(ORDER), key=universal) == ORDER
    assert compare(0, 0.0) == 0 and compare(-1, 1.0) < 0 and compare("Aa", "aa") == 0


def test_universal_columns(spark):
    strings = [x for x in ORDER if x is None or isinstance(x, str)]
    df = spark.createDataFrame([(x,) for x in reversed(strings)], "x string")
    assert [r[0] for r in df.orderBy(sort_key(df["x"], df.schema["x"].dataType)).collect()] == strings
    lists = [x for x in ORDER if isinstance(x, list)]
    df = spark.createDataFrame([(x,) for x in reversed(lists)], "x array<string>")
    assert [r[0] for r in df.orderBy(sort_key(df["x"], df.schema["x"].dataType)).collect()] == lists
