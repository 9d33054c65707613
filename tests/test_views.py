from decimal import Decimal

import pytest
from view_helpers import rows
from pyspark.sql import functions as F

from foldview.functions.mappers import Count, Emit, EmitAll, FlatMap, PyMap, SelectAll, TopNMapper
from foldview.functions.reducers import BoolOr, CollectSet, FirstNonNull, FoldExpr, MaxValue, MinValue, PyFold, Sum, TopN, Union
from foldview.plans.engine import Engine


def bank(spark, deposits, withdrawals=(), transfers=(), users=()):
    e = Engine(spark)
    e.source("deposits(id)", spark.createDataFrame(list(deposits), "id long, account string, amount decimal(10,2)"))
    e.source("withdrawals(id)", spark.createDataFrame(list(withdrawals), "id long, account string, amount decimal(10,2)"))
    e.source("transfers(id)", spark.createDataFrame(list(transfers), "id long, src string, dst string, amount decimal(10,2)"))
    e.source("users(id)", spark.createDataFrame(list(users), "id string, name string"))
    v = e.map("{ account amount }", "deposits(id)").map("{ account amount }", "withdrawals(id)", "account; -amount")
    v.map("{ src amount }", "transfers(id)", "src; -amount").map("{ dst amount }", "transfers(id)").red("{ balance }", "accounts(account)", Sum())
    e.map("{ account balance }", "accounts(account)", TopNMapper("balance", "account")).red("{ top }", "topAccounts()", TopN(2))
    e.map("{ amount }", "deposits(id)", Count()).map("{ amount }", "withdrawals(id)", Count()).map("{ amount }", "transfers(id)", Count()).red("{ n }", "totalTransactions()", Sum())
    e.map("{ account balance }", "accounts(account)", "account; balance; cast(null as string)").map("{ name }", "users(id)", "id; cast(null as decimal(20,2)); name").red("{ balance name }", "named(account)", Union(Sum(), FirstNonNull()))
    e.map("{ balance name account }", "named(account)", TopNMapper()).red("{ top }", "topCustomers()", TopN(2))
    return e


D = Decimal
USERS = [("a", "Ada"), ("b", "Bela")]
DEPOSITS = [(1, "a", D(70)), (2, "b", D(44))]


@pytest.mark.parametrize(
    "transfers, a, b, n, first",
    [([], 64, 44, 3, "Ada"), ([(1, "a", "b", D(25))], 39, 69, 4, "Bela"), ([(1, None, None, None)], 64, 44, 3, "Ada")],
)
def test_ledger(spark, transfers, a, b, n, first):
    e = bank(spark, DEPOSITS, [(1, "a", D(6))], transfers, USERS)
    assert rows(e.batch("accounts")) == [("a", D(a)), ("b", D(b))]
    assert rows(e.batch("totalTransactions")) == [(n,)]
    assert e.batch("topCustomers").first()["top"][0]["name"] == first


def test_empty_sources_give_no_rows(spark):
    e = bank(spark, [])
    assert [rows(e.batch(v)) for v in ("accounts", "topAccounts", "totalTransactions", "topCustomers")] == [[], [], [], []]


def test_users_and_orgs(spark):
    names = ["Ada", "Bela", "Cleo", "Dario", "Edda", "Farid"]
    users = [(i, n) for i, n in enumerate(n for k, n in enumerate(names) for _ in range(k + 1))]
    e = Engine(spark).source("users(id)", spark.createDataFrame(users, "id long, name string"))
    e.map("{ name }", "users(id)", Count("name")).red("{ n }", "names(name)", Sum())
    e.map("{ name n }", "names(name)", TopNMapper("n", "name")).red("{ top }", "topNames()", TopN(4))
    e.map("{ n }", "names(name)", "n; 1L").red("{ total names }", "avg()", Sum()).fmt("{ average }", "total div names")
    assert rows(e.batch("names")) == sorted((n, k + 1) for k, n in enumerate(names))
    assert rows(e.batch("topNames")) == [(((6, "Farid"), (5, "Edda"), (4, "Dario"), (3, "Cleo")),)]
    assert rows(e.batch("avg")) == [(sum(range(1, 7)) // 6,)]


def test_response_time(spark):
    def build(messages):
        e = Engine(spark).source("updates(channel tweet)", spark.createDataFrame(messages, "channel long, tweet long, re long, ts long"))
        v = e.map("{ channel tweet ts }", "updates(channel tweet)", "channel; tweet; ts; cast(null as bigint)").map("{ channel re ts }", "updates(channel tweet)", "channel; re; cast(null as bigint); ts")
        return v.red("{ sent answered }", "wait(channel tweet)", Union(MinValue(), MinValue())).fmt("{ ms }", "answered - sent")

    messages = [(7, 1001, None, 1), (7, 1002, None, 2), (7, 1003, 1001, 3), (7, 1004, 1001, 4)]
    assert (7, 1001, 2) in rows(build(messages).batch())
    assert [r for r in rows(build(messages).batch()) if r[2] is not None] == [(7, 1001, 2)]
    assert (7, 1001, 3) in rows(build([m for m in messages if m[1] != 1003]).batch())


def test_word_count(spark):
    def count(docs):
        e = Engine(spark).source("docs(id)", spark.createDataFrame(docs, "id long, text string"))
        return dict(rows(e.map("{ text }", "docs(id)", FlatMap("filter(split(lower(text), ' '), w -> w <> '')", "w", Emit("w", "1L"))).red("{ n }", "words(word)", Sum()).batch()))

    both = count([(3, "Two boats pass two buoys"), (4, "pass the salt  and pass the two plates")])
    assert (both["two"], both["pass"], both["the"], both["boats"]) == (3, 3, 2, 1) and "" not in both
    assert count([(3, None), (4, "salt Salt SALT")]) == {"salt": 3}


def test_not_null_rule_is_per_map(spark):
    e = Engine(spark).source("t(id)", spark.createDataFrame([(1, "x", None), (2, None, 5), (None, "y", 7)], "id long, a string, b long"))
    assert rows(e.map("{ a }", "t(id)", Count()).red("{ n }", "na()", Sum()).batch()) == [(2,)]
    assert rows(e.map("{ b }", "t(id)", Count()).red("{ n }", "nb()", Sum()).batch()) == [(2,)]
    # an id among the values may be null
    assert rows(e.map("{ id a }", "t(id)", Count()).red("{ n }", "nia()", Sum()).batch()) == [(2,)]


def test_inner_join_drops_partial_rows_and_sinks_keep_them(spark):
    e = Engine(spark).source("l(k)", spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")).source("r(k)", spark.createDataFrame([(2, "c"), (3, "d")], "k long, y string"))
    e.map("{ k x }", "l(k)", "k; x; cast(null as string)").map("{ k y }", "r(k)", "k; cast(null as string); y").red("{ x y }", "both(key)", FirstNonNull())
    assert rows(e.batch("both")) == [(1, "a", None), (2, "b", "c"), (3, None, "d")]
    assert rows(e.map("{ key x y }", "both(key)", SelectAll()).red("{ x y }", "inner(key)", MinValue()).batch()) == [(2, "b", "c")]


def test_min_and_max_are_of_whole_tuples(spark):
    e = Engine(spark).source("t(id)", spark.createDataFrame([(1, "k", 2, "a"), (2, "k", 1, "z"), (3, "k", 1, "b")], "id long, k string, a long, b string"))
    assert rows(e.map("{ k a b }", "t(id)").red("{ a b }", "lo(k)", MinValue()).batch()) == [("k", 1, "b")]
    assert rows(e.map("{ k a b }", "t(id)").red("{ a b }", "hi(k)", MaxValue()).batch()) == [("k", 2, "a")]


def test_topn_merges_equal_tuples(spark):
    e = Engine(spark).source("t(id)", spark.createDataFrame([(i, x) for i, x in enumerate([5, 5, 4, 1, 3])], "id long, x long"))
    assert rows(e.map("{ x }", "t(id)", TopNMapper()).red("{ top }", "top()", TopN(3)).batch()) == [(((5,), (4,), (3,)),)]
    assert rows(e.map("{ x }", "t(id)", TopNMapper()).red("{ top }", "low()", TopN(2, ascending=True)).batch()) == [(((1,), (3,)),)]


def test_collect_bool_several_and_python(spark):
    e = Engine(spark).source("t(id)", spark.createDataFrame([(1, "k", 3), (2, "k", 1), (3, "j", 1)], "id long, k string, x long"))
    assert rows(e.map("{ k x }", "t(id)", "k; array(x)").red("{ s }", "set(k)", CollectSet()).batch()) == [("j", (1,)), ("k", (1, 3))]
    assert rows(e.map("{ k x }", "t(id)", "k; x > 2").red("{ b }", "any(k)", BoolOr()).batch()) == [("j", False), ("k", True)]
    assert rows(e.map("{ k x }", "t(id)", EmitAll(Emit("k", "x"), Emit("'all'", "x", when="x > 1"))).red("{ n }", "sums(k)", Sum()).batch()) == [("all", 3), ("j", 1), ("k", 4)]
    assert rows(e.map("{ k x }", "t(id)", PyMap(lambda r: [(r["k"], r["x"])] * 2, "string", "long")).red("{ n }", "twice(k)", Sum()).batch()) == [("j", 2), ("k", 8)]
    assert rows(e.map("{ k x }", "t(id)").red("{ x }", "fold(k)", FoldExpr("a.x * 10 + b.x")).batch()) == [("j", 1), ("k", 31)]
    assert rows(e.map("{ k x }", "t(id)").red("{ x }", "py(k)", PyFold(lambda key, a, b: (a[0] * 10 + b[0],))).batch()) == [("j", 1), ("k", 31)]


def test_arity_columns_cycles(spark):
    e = Engine(spark).source("t(id)", spark.createDataFrame([(1, "k", 3)], "id long, k string, x long"))
    assert rows(e.map("{ k x }", "t(id)", "k; x; 99").red("{ x }", "extra(k)", Sum()).batch()) == [("k", 3)]
    with pytest.raises(ValueError, match="need 2"):
        e.map("{ k }", "t(id)", "k").red("{ x }", "short(k)", Sum()).batch()
    with pytest.raises(ValueError, match="no column"):
        e.map("{ nope }", "t(id)").red("{ x }", "bad(k)", Sum()).batch()
    with pytest.raises(ValueError, match="neither a source nor a view"):
        e.map("{ k }", "gone(id)").red("{ x }", "lost(k)", Sum()).batch()
    e.map("{ x }", "b(k)").red("{ x }", "a(k)", Sum())
    e.map("{ x }", "a(k)").red("{ x }", "b(k)", Sum())
    with pytest.raises(ValueError, match="cycle"):
        e.batch("a")


def test_sum_overflow_is_an_error(spark):
    e = Engine(spark).source("t(id)", spark.createDataFrame([(1, 2**62), (2, 2**62)], "id long, x long"))
    with pytest.raises(Exception, match="(?i)overflow"):
        e.map("{ x }", "t(id)").red("{ x }", "s()", Sum()).batch().collect()


def test_versions_are_reduced_to_the_last(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, None, 3)], "id long, k string, s long")
    e = Engine(spark).source("t(id)", df, seq="s")
    assert rows(e.map("{ k }", "t(id)", Count("k")).red("{ n }", "n(k)", Sum()).batch()) == [("b", 1)]


def test_partial_aggregation_and_pushdown(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 7).alias("k"), "id", F.lit("x").alias("unused")).write.parquet(str(tmp_path / "t"))
    e = Engine(spark).source("t(id)", spark.read.parquet(str(tmp_path / "t")))
    plan = e.map("{ k id }", "t(id)", Emit("k", "id", when="id > 5")).red("{ n }", "n(k)", Sum()).batch()._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "unused" not in plan and "GreaterThan(id,5)" in plan


def test_folds_go_by_parts(spark):
    """A key with many documents is folded in parts, in SQL and in Python, with the same result."""
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("k"), (F.col("id") * 7 % 1001).alias("x")).repartition(7)
    e = Engine(spark).source("t(id)", df)
    e.map("{ k x }", "t(id)", "k; x; x").red("{ lo hi }", "sql(k)", FoldExpr("least(a.lo, b.lo)", "greatest(a.hi, b.hi)"))
    e.map("{ k x }", "t(id)", "k; x; x").red("{ lo hi }", "py(k)", PyFold(lambda a, b: (min(a[0], b[0]), max(a[1], b[1]))))
    e.map("{ k x }", "t(id)", "k; x; x").red("{ lo hi }", "want(k)", Union(MinValue(), MaxValue()))
    assert rows(e.batch("sql")) == rows(e.batch("py")) == rows(e.batch("want"))


def test_fold_keeps_the_values_type(spark):
    e = Engine(spark).source("t(id)", spark.createDataFrame([(1, D("1.50")), (2, D("2.25"))], "id long, x decimal(10,2)"))
    out = e.map("{ x }", "t(id)").red("{ x }", "s()", "a.x + b.x").batch()
    assert rows(out) == [(D("3.75"),)] and out.schema["x"].dataType.simpleString() == "decimal(10,2)"


def test_topn_limits_before_its_only_shuffle(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 7).alias("k"), "id").write.parquet(str(tmp_path / "t"))
    e = Engine(spark).source("t(id)", spark.read.parquet(str(tmp_path / "t")))
    plan = e.map("{ k id }", "t(id)", "k; array(struct(id))").red("{ top }", "top(k)", TopN(3)).batch()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange hashpartitioning")
