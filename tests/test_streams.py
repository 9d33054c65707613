import datetime
import decimal
import functools
import json
import random

import pyarrow as pa
import pytest
from view_helpers import rows

from foldview.functions.mappers import Count, PyMap, TopNMapper
from foldview.functions.reducers import BoolOr, FirstNonNull, FoldExpr, MaxValue, MinValue, PyFold, Sum, TopN, Union
from foldview.plans.engine import Engine
from foldview.plans.language import run
from foldview.sinks.publishers import ParquetTable
from foldview.streaming.stateful import Keyed, Packed, array, values

SCHEMA = "id long, account long, amount long, s long"


class Feed:
    """Views over a folder that messages are dropped into; each step runs what is new and gives the views' rows."""

    def __init__(self, spark, path, build):
        self.spark, self.path, self.build, self.n = spark, path, build, 0
        (path / "in").mkdir()
        self.sink = ParquetTable(spark, str(path / "out"))

    def step(self, view, *messages):
        with open(self.path / "in" / f"{self.n}.json", "w") as f:
            for m in messages:
                f.write(json.dumps(dict(zip(("id", "account", "amount"), m)) | {"s": self.n}) + "\n")
                self.n += 1
        e = Engine(self.spark).source("deposits(id)", self.spark.readStream.schema(SCHEMA).json(str(self.path / "in")), seq="s")
        self.build(e)
        e.publish(view, self.sink, str(self.path / "checkpoint")).awaitTermination()
        out = self.sink.read(view)
        return rows(out) if out is not None else []


def balances(e):
    e.map("{ account amount }", "deposits(id)").red("{ balance }", "accounts(account)", Sum())


def test_retraction_sequence(spark, tmp_path):
    f = Feed(spark, tmp_path, balances)
    assert f.step("accounts", (41, 7, 60), (41, 7, 60), (42, 8, 5)) == [(7, 60), (8, 5)]  # one document, sent twice
    assert f.step("accounts", (43, 7, 15)) == [(7, 75), (8, 5)]
    assert f.step("accounts", (43, 7, 40), (44, 9, None)) == [(7, 100), (8, 5)]  # replaced; another without an amount
    assert f.step("accounts", (43, 8, 40), (41, 7, -3)) == [(7, -3), (8, 45)]  # moved
    assert f.step("accounts", (41, None, None), (42, 8, None)) == [(8, 40)]  # deleted
    assert f.step("accounts", (43, None, 1), (44, None, None)) == []


FOLDS = {
    "expressions": lambda e: e.map("{ account amount }", "deposits(id)").red("{ balance }", "folded(account)", "a.balance + b.balance"),
    "bounds": lambda e: e.map("{ account amount }", "deposits(id)", "account; amount; amount").red("{ lo hi }", "folded(account)", FoldExpr("least(a.lo, b.lo)", "greatest(a.hi, b.hi)")).fmt("{ spread }", "hi - lo"),
    "text": lambda e: run(e, "MAP { account amount } FROM deposits(id)\nRED { n } INTO folded(account) USE { a, b -> [a.n + b.n] }"),
    "union": lambda e: e.map("{ account amount }", "deposits(id)", "account; amount; 1L; amount").red("{ total n most }", "folded(account)", Union(Sum(), Sum(), MaxValue())),
    "python map": lambda e: e.map("{ account amount }", "deposits(id)", PyMap(lambda r: [(r["account"], r["amount"]), (0, 1)][: 1 + r["amount"] % 2], "long", "long")).red("{ x }", "folded(account)", Sum()),
    "python fold": lambda e: e.map("{ account amount }", "deposits(id)").red("{ x }", "folded(account)", PyFold(lambda a, b: (a[0] ^ b[0],))),
    "extremes": lambda e: e.map("{ account id amount }", "deposits(id)", "account; amount; id").red("{ x who }", "folded(account)", MinValue()),
    "top": lambda e: e.map("{ account id amount }", "deposits(id)", "account; array(struct(amount, id))").red("{ top }", "folded(account)", TopN(2)),
}


@pytest.mark.parametrize("name", FOLDS)
def test_folds_in_streams(spark, tmp_path, name):
    """Each kind of fold against batch: upserts, moves and deletes in three steps."""
    rnd = random.Random(11)
    f, said = Feed(spark, tmp_path, FOLDS[name]), []
    for k in range(3):
        batch = [(rnd.randint(1, 9), rnd.choice([1, 2, 2, 3, None]), rnd.choice([None, *range(-4, 7)])) for _ in range(12)]
        said += batch
        got = f.step("folded", *batch)
        e = Engine(spark).source("deposits(id)", spark.createDataFrame([(*m, i) for i, m in enumerate(said)], SCHEMA), seq="s")
        FOLDS[name](e)
        assert got == rows(e.batch("folded")), k


def test_inverses():
    """Taking a value out of a total gives the fold of the others, or None."""
    rnd = random.Random(2)
    some = lambda: rnd.choice([None, *range(-3, 4)])
    kinds = [(Sum(), lambda: (some(), some())), (MinValue(), lambda: (some(), some())), (MaxValue(), lambda: (some(),)), (Union(Sum(), MaxValue(), FirstNonNull()), lambda: (some(), some(), some())), (FirstNonNull(), lambda: (some(), some())), (BoolOr(), lambda: (rnd.choice([None, True, False]),)), (TopN(2), lambda: ([(rnd.randint(0, 5),)],))]
    known = 0
    for reducer, value in kinds:
        for _ in range(300):
            held = [value() for _ in range(rnd.randint(2, 5))]
            fold = lambda xs: reducer.finish(functools.reduce(reducer.fold, xs))  # noqa: E731, B023
            left = reducer.inverse(fold(held), held[0])
            known += left is not None
            assert left is None or tuple(left) == tuple(fold(held[1:]))
    assert known > 600


def test_stream_equals_batch(spark, tmp_path):
    """Random upserts, moves and deletes, through a cascade with reducers that have no inverse and salted buckets."""

    def build(e):
        e.map("{ account amount }", "deposits(id)").red("{ most }", "most(account)", MaxValue()).salted(3)
        e.map("{ account most }", "most(account)", TopNMapper("most", "account")).red("{ top }", "top()", TopN(3))

    rnd = random.Random(3)
    f, said, got = Feed(spark, tmp_path, build), [], None
    for _ in range(4):
        batch = [(rnd.randint(1, 12), rnd.choice([None, 1, 2, 3, 4]), rnd.choice([None, *range(9)])) for _ in range(15)]
        said += batch
        got = f.step("top", *batch)
    e = Engine(spark).source("deposits(id)", spark.createDataFrame([(*m, i) for i, m in enumerate(said)], SCHEMA), seq="s")
    build(e)
    assert got == rows(e.batch("top"))


def test_count_ladder(spark, tmp_path):
    f = Feed(spark, tmp_path, lambda e: e.map("{ amount }", "deposits(id)", Count()).red("{ n }", "total()", Sum()))
    assert f.step("total", *[(i, 1, 1) for i in range(25)]) == [(25,)]
    assert f.step("total", *[(i, 1, None) for i in range(24)]) == [(1,)]
    assert f.step("total", (24, 1, None)) == []


def test_files_that_come_out_of_order(spark, tmp_path):
    """A view over a view takes the last row of each key, though documents with lower seq come later."""

    def build(e):
        e.map("{ account }", "deposits(id)", Count("account")).red("{ n }", "per(account)", Sum())
        e.map("{ n }", "per(account)", Count("n")).red("{ accounts }", "histogram(n)", Sum())

    f = Feed(spark, tmp_path, build)
    f.n = 100
    assert f.step("histogram", (1, 1, 1), (2, 1, 1), (3, 2, 1)) == [(1, 1), (2, 1)]
    f.n = 50
    assert f.step("histogram", (4, 1, 1), (5, 2, 1)) == [(2, 1), (3, 1)]


class Store:
    """A state store for one key that counts its calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, name, *schemas):
        return self

    getMapState = getValueState

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def getValue(self, k):
        self.calls += 1
        return self.map.get(k)

    def updateValue(self, k, v):
        self.calls, self.map[k] = self.calls + 1, v


def test_documents_in_chunks():
    """Thousands of documents take few calls; one of them reads and writes its chunk alone."""
    store, rnd, held = Store(), random.Random(4), {}
    for n in (3, 200, 3000, 1, 5000, 1):
        packed = Packed(store)
        store.calls, kept = 0, packed.open()
        assert kept == (len(held) or None)
        new = {("0", f"[{rnd.randrange(6000)}]"): rnd.choice([None, (rnd.randrange(9),)]) for _ in range(n)}
        for doc in packed.placed(new):
            assert packed.get(doc) == held.get(doc)
            packed.put(doc, new[doc])
        held = {d: v for d, v in (held | new).items() if v is not None}
        assert packed.count == len(held)
        packed.close(len(held))
        assert store.calls <= (4 if n == 1 else 2 + 3 * 64)
        packed.open()
        assert dict(packed.items()) == held
    assert len(store.map) >= 8


def test_maps_of_one_source_share_a_stage(spark, tmp_path):
    """One stage M for each source and type of rows, and one fold."""
    e = Engine(spark).source("deposits(id)", spark.readStream.schema(SCHEMA).json(str(tmp_path)), seq="s")
    e.map("{ account amount }", "deposits(id)").map("{ account amount }", "deposits(id)", "account; -amount").red("{ balance }", "accounts(account)", Sum())
    plan = e.stream("accounts")._jdf.queryExecution().analyzed().toString()
    assert plan.count("TransformWithState") == 2


class Stores(Store):
    """State stores by name."""

    def __init__(self):
        super().__init__()
        self.named = {}

    def getMapState(self, name, *schemas):
        return self.named.setdefault(name, MapStore())

    def getValueState(self, name, *schemas):
        return self.named.setdefault(name, Store())


class MapStore(Store):
    """A state store of Arrow's kinds: bytes and numbers."""

    def updateValue(self, k, v):
        assert all(isinstance(x, (int, bytes)) for x in (*k, *v))
        super().updateValue(k, v)


def test_keys_in_one_state():
    """A group's keys share chunks; one with many documents gets chunks of its own, and stays right as it loses them."""
    stores, rnd, held = Stores(), random.Random(5), {}
    for n in (3, 400, 2000, 1, 3000, 1):
        state, news = Keyed(stores, 32), {}
        for _ in range(n):
            key = (rnd.choice([0] * 9 + list(range(60))),)
            news.setdefault(key, {})[("0", str(rnd.randrange(900)))] = rnd.choice([None, (rnd.randrange(9),)])
        state.keys.open()
        for key in state.keys.placed(news):
            kept, documents = state.open(key)
            was = held.setdefault(key, {})
            assert kept == (len(was) or None) and dict(documents.items()) == was
            for doc in documents.placed(news[key]):
                documents.put(doc, news[key][doc])
            held[key] = {d: v for d, v in (was | news[key]).items() if v is not None}
            assert documents.count == len(held[key])
            state.close(key, len(held[key]) or None, documents)
        state.keys.close()
    assert list(stores.named["own"].map) and len(stores.named["own_chunks"].map) >= 8 and stores.named["chunks"].map


def test_columns_and_back():
    """Plain values of nested columns, nulls and all, make the same columns again."""
    kind = pa.struct([("a", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.list_(pa.string()))]))), ("m", pa.map_(pa.string(), pa.int64())), ("t", pa.timestamp("us", "UTC")), ("d", pa.decimal128(9, 2)), ("n", pa.int32())])
    one = {"a": [{"x": 1.5, "y": ["p", None]}, None, {"x": None, "y": None}], "m": [("k", 1)], "t": datetime.datetime(2020, 1, 2, tzinfo=datetime.timezone.utc), "d": decimal.Decimal("1.20"), "n": 7}
    given = pa.array([one, None, dict.fromkeys(one), one | {"a": [], "m": []}], kind)
    for part in (given, given.slice(1), given.slice(0, 0)):
        assert array(values(part), kind).equals(part)
    assert values(given)[0][0] == ((1.5, ("p", None)), None, (None, None))


def test_keys_of_a_batch_share_states(spark, tmp_path):
    """A state for each group of keys and not for each key: a store that is called for each was what took the time."""
    n = 6000
    spark.range(n).selectExpr("id", "id as account", "1L as amount", "id as s").write.json(str(tmp_path / "in"))
    e = Engine(spark).source("deposits(id)", spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), seq="s")
    balances(e)
    sink = ParquetTable(spark, str(tmp_path / "out"))
    q = e.publish("accounts", sink, str(tmp_path / "checkpoint"))
    q.awaitTermination()
    assert sink.read("accounts").count() == n
    operators = [o for p in q.recentProgress for o in json.loads(p.json)["stateOperators"]]
    assert operators and all(o["numRowsTotal"] <= 1024 for o in operators)


def test_keys_that_sql_takes_for_one(spark, tmp_path):
    """Zeros of either sign, and NaNs, in one batch and across batches."""

    def build(e):
        e.map("{ account amount }", "deposits(id)", "if(account = 0, double('NaN'), if(account < 3, account * 0d * (account - 1.5), account)); amount").red("{ x }", "folded(key)", Sum())

    f, said = Feed(spark, tmp_path, build), []
    for k in range(2):
        batch = [(10 * k + i, i % 4, 1) for i in range(8)]
        said += batch
        f.step("folded", *batch)
    got = [tuple(r) for r in f.sink.read("folded").orderBy("key").collect()]
    assert str(got) == "[(0.0, 8), (3.0, 4), (nan, 4)]"
