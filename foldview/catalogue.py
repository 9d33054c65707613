"""Queries of the view engine over the driver's tables, each with its SQL oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.mappers import Count, Emit, EmitAll, FlatMap, PyMap, SelectAll, TopNMapper
from .functions.reducers import BoolOr, CollectSet, FirstNonNull, FoldExpr, MaxValue, MinValue, PyFold, Sum, TopN, Union
from .operators import changes, docstore
from .operators.cluster import Cluster
from .plans import language
from .plans.batch import latest
from .plans.engine import Engine
from .session import work_dir
from .sinks import publishers
from .sources import replay, schemes, wire

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def engine(spark: SparkSession, d: str) -> Engine:
    """The driver's tables as sources; events are versions of a user's record, where an error deletes it."""
    e = Engine(spark)
    e.source("orders(o_orderkey)", table(spark, d, "orders"))
    e.source("customer(c_custkey)", table(spark, d, "customer"))
    e.source("nation(n_nationkey)", table(spark, d, "nation"))
    e.source("supplier(s_suppkey)", table(spark, d, "supplier"))
    e.source("lineitem()", table(spark, d, "lineitem"))
    e.source("conversations(conv_id turn)", table(spark, d, "conversations"))
    events = table(spark, d, "events")
    e.source("events(event_id)", events)
    e.source("users(user_id)", user_versions(events), seq=("ts", "event_id"))
    return e


def user_versions(events: DataFrame) -> DataFrame:
    live = F.col("event_type") != "error"
    return events.select("user_id", "ts", "event_id", F.when(live, F.col("event_type")).alias("kind"), F.when(live, F.round("value", 2)).alias("amount"))


def cents(c: str) -> str:
    """Sums of money as decimals, so that any order of adding gives the same."""
    return f"cast({c} as decimal(18,2))"


MONEY = "cast({} as double)"


@query("select count(*)::bigint as n from orders having count(*) > 0")
def count_global(spark, d):
    return engine(spark, d).map("{ o_custkey }", "orders(o_orderkey)", Count()).red("{ n }", "total()", Sum()).batch()


@query("select o_orderstatus, count(*)::bigint as n from orders group by 1")
def count_by_key(spark, d):
    return engine(spark, d).map("{ o_orderstatus }", "orders(o_orderkey)", Count("o_orderstatus")).red("{ n }", "byStatus(o_orderstatus)", Sum()).batch()


@query("select o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by 1")
def sum_by_key(spark, d):
    return engine(spark, d).map("{ o_custkey o_totalprice }", "orders(o_orderkey)", f"o_custkey; {cents('o_totalprice')}").red("{ total }", "spent(o_custkey)", Sum()).fmt("{ total }", MONEY.format("total")).batch()


@query("select l_partkey, cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as price from lineitem group by 1")
def sum_multi_column(spark, d):
    v = engine(spark, d).map("{ l_partkey l_quantity l_extendedprice }", "lineitem()", f"l_partkey; {cents('l_quantity')}; {cents('l_extendedprice')}").red("{ qty price }", "parts(l_partkey)", Sum())
    return v.fmt("{ qty price }", MONEY.format("qty"), MONEY.format("price")).batch()


def _tuple_sql(order: str) -> str:
    return f"select o_custkey, o_orderpriority as priority, o_totalprice as price from (select *, row_number() over (partition by o_custkey order by o_orderpriority {order}, o_totalprice {order}) as r from orders) where r = 1"


@query(_tuple_sql("asc"))
def min_tuple(spark, d):
    return engine(spark, d).map("{ o_custkey o_orderpriority o_totalprice }", "orders(o_orderkey)").red("{ priority price }", "lowest(o_custkey)", MinValue()).batch()


@query(_tuple_sql("desc"))
def max_tuple(spark, d):
    return engine(spark, d).map("{ o_custkey o_orderpriority o_totalprice }", "orders(o_orderkey)").red("{ priority price }", "highest(o_custkey)", MaxValue()).batch()


def _top(spark, d, n: int, ascending: bool) -> DataFrame:
    v = engine(spark, d).map("{ o_custkey o_totalprice o_orderkey }", "orders(o_orderkey)", TopNMapper("o_totalprice", "o_orderkey", keys=("o_custkey",)))
    rows = v.red("{ top }", "top(o_custkey)", TopN(n, ascending)).batch()
    return rows.select("o_custkey", F.posexplode("top").alias("pos", "x")).select("o_custkey", (F.col("pos") + 1).cast("long").alias("rank"), F.col("x.o_totalprice").alias("price"), F.col("x.o_orderkey").alias("orderkey"))


def _top_sql(n: int, order: str) -> str:
    return f"select o_custkey, rank, price, orderkey from (select o_custkey, o_totalprice as price, o_orderkey as orderkey, row_number() over (partition by o_custkey order by o_totalprice {order}, o_orderkey {order}) as rank from orders) where rank <= {n}"


@query(_top_sql(3, "desc"))
def topn_desc(spark, d):
    return _top(spark, d, 3, False)


@query(_top_sql(2, "asc"))
def topn_asc(spark, d):
    return _top(spark, d, 2, True)


@query("select o_custkey, list(distinct o_orderpriority order by o_orderpriority desc)[1:2] as priorities from orders group by 1")
def topn_distinct(spark, d):
    v = engine(spark, d).map("{ o_custkey o_orderpriority }", "orders(o_orderkey)", TopNMapper("o_orderpriority", keys=("o_custkey",))).red("{ top }", "top(o_custkey)", TopN(2))
    return v.fmt("{ priorities }", "transform(top, x -> x.o_orderpriority)").batch()


@query("select c_nationkey, cast(sum(cast(c_acctbal as decimal(18,2))) as double) as total, min(c_custkey) as first, max(c_name) as last, max(n_name) as nation from customer join nation on c_nationkey = n_nationkey group by 1")
def union_reducer(spark, d):
    """Columns reduced apart; two sources fill different columns with nulls between."""
    v = engine(spark, d).map("{ c_nationkey c_acctbal c_custkey c_name }", "customer(c_custkey)", f"c_nationkey; {cents('c_acctbal')}; c_custkey; c_name; cast(null as string)")
    v = v.map("{ n_nationkey n_name }", "nation(n_nationkey)", "n_nationkey; cast(null as decimal(18,2)); cast(null as bigint); cast(null as string); n_name")
    v = v.red("{ total first last nation }", "nations(c_nationkey)", Union(Sum(), MinValue(), MaxValue(), FirstNonNull()))
    return v.fmt("{ total first last nation }", MONEY.format("total"), "first", "last", "nation").batch()


LEDGER = "select user_id, cast(sum(amount) as double) as balance from (select user_id, cast(value as decimal(18,2)) as amount from events where event_type = 'purchase' union all select user_id, -cast(value as decimal(18,2)) from events where event_type = 'error') group by 1"


def ledger(e: Engine):
    v = e.map("{ user_id event_type value }", "events(event_id)", Emit("user_id", cents("value"), when="event_type = 'purchase'"))
    return v.map("{ user_id event_type value }", "events(event_id)", Emit("user_id", f"-{cents('value')}", when="event_type = 'error'")).red("{ balance }", "ledger(user_id)", Sum())


@query(LEDGER)
def ledger_balance(spark, d):
    return ledger(engine(spark, d)).fmt("{ balance }", MONEY.format("balance")).batch()


@query("select account, count(*)::bigint as n from (select o_custkey as account from orders union all select user_id from events where event_type = 'purchase' union all select user_id from events where event_type = 'signup' union all select s_suppkey from supplier) group by 1")
def transaction_counts(spark, d):
    v = engine(spark, d).map("{ o_custkey }", "orders(o_orderkey)", Count("o_custkey"))
    for kind in ("purchase", "signup"):
        v = v.map("{ user_id event_type }", "events(event_id)", Emit("user_id", "1L", when=f"event_type = '{kind}'"))
    return v.map("{ s_suppkey }", "supplier(s_suppkey)", Count("s_suppkey")).red("{ n }", "counts(account)", Sum()).batch()


def _joined(e: Engine):
    """Customers and their large orders, co-grouped: each side leaves the other's column null."""
    v = e.map("{ c_custkey c_name }", "customer(c_custkey)", "c_custkey; c_name; cast(null as double)")
    return v.map("{ o_custkey o_totalprice }", "orders(o_orderkey)", Emit("o_custkey", "cast(null as string)", "o_totalprice", when="o_totalprice > 300000")).red("{ name price }", "both(custkey)", Union(FirstNonNull(), MaxValue()))


BIG = "(select o_custkey, max(o_totalprice) as price from orders where o_totalprice > 300000 group by 1)"


@query(f"select coalesce(c_custkey, o_custkey) as custkey, c_name as name, price from customer full join {BIG} on c_custkey = o_custkey")
def outer_join_view(spark, d):
    return _joined(engine(spark, d)).batch()


@query(f"select c_custkey as custkey, c_name as name, price from customer join {BIG} on c_custkey = o_custkey")
def inner_join_view(spark, d):
    """A second view over the join: a row with a null in a declared value is not there."""
    e = engine(spark, d)
    _joined(e)
    return e.map("{ custkey name price }", "both(custkey)", SelectAll()).red("{ name price }", "inner(custkey)", MaxValue()).batch()


@query(f"select c_custkey as custkey, c_name as name, coalesce(price, -1) as price from customer left join {BIG} on c_custkey = o_custkey")
def left_join_view(spark, d):
    e = engine(spark, d)
    e.map("{ c_custkey c_name }", "customer(c_custkey)", "c_custkey; c_name; -1.0D").map("{ o_custkey o_totalprice }", "orders(o_orderkey)", Emit("o_custkey", "cast(null as string)", "o_totalprice", when="o_totalprice > 300000")).red("{ name price }", "both(custkey)", Union(FirstNonNull(), MaxValue()))
    return e.map("{ custkey name price }", "both(custkey)").red("{ name price }", "kept(custkey)", MaxValue()).batch()


def _collected(e: Engine):
    v = e.map("{ n_nationkey n_name }", "nation(n_nationkey)", "n_nationkey; n_name; cast(array() as array<string>)")
    return v.map("{ s_nationkey s_name }", "supplier(s_suppkey)", "s_nationkey; cast(null as string); array(s_name)").red("{ name suppliers }", "nations(nationkey)", Union(FirstNonNull(), CollectSet()))


@query("select n_nationkey as nationkey, n_name as name, coalesce(list(distinct s_name order by s_name) filter (where s_name is not null), []) as suppliers from nation left join supplier on n_nationkey = s_nationkey group by 1, 2")
def one_to_many_collect(spark, d):
    return _collected(engine(spark, d)).batch()


@query("select s_name, list(distinct n_name order by n_name) as nations from supplier join nation on n_nationkey = s_nationkey group by 1")
def unnest_back(spark, d):
    e = engine(spark, d)
    _collected(e)
    return e.map("{ name suppliers }", "nations(nationkey)", FlatMap("suppliers", "s", Emit("s", "array(name)"))).red("{ nations }", "back(s_name)", CollectSet()).batch()


def _top_customers(e: Engine, n: int):
    e.map("{ o_custkey o_totalprice }", "orders(o_orderkey)", f"o_custkey; {cents('o_totalprice')}").red("{ total }", "spent(custkey)", Sum())
    return e.map("{ custkey total }", "spent(custkey)", TopNMapper("total", "custkey")).red("{ top }", "topSpent()", TopN(n))


TOP10 = "(select o_custkey, sum(cast(o_totalprice as decimal(18,2))) as total from orders group by 1 order by total desc, o_custkey desc limit 10)"


@query(f"select row_number() over (order by total desc, c_name desc) as rank, cast(total as double) as total, c_name as name from {TOP10} join customer on o_custkey = c_custkey")
def topn_join_lookup(spark, d):
    """Four views deep: totals, the top ten, their names by join, the top ten anew."""
    e = engine(spark, d)
    _top_customers(e, 10)
    e.map("{ top }", "topSpent()", FlatMap("top", "x", Emit("x.custkey", "x.total", "cast(null as string)"))).map("{ c_custkey c_name }", "customer(c_custkey)", "c_custkey; cast(null as decimal(28,2)); c_name").red("{ total name }", "named(custkey)", Union(MaxValue(), FirstNonNull()))
    rows = e.map("{ total name }", "named(custkey)", TopNMapper()).red("{ top }", "topNamed()", TopN(10)).batch()
    return rows.select(F.posexplode("top").alias("p", "x")).select((F.col("p") + 1).cast("long").alias("rank"), F.col("x.total").cast("double").alias("total"), F.col("x.name").alias("name"))


@query(f"select c_custkey as custkey, c_name as name from customer where c_custkey in (select o_custkey from {TOP10})")
def semi_flag(spark, d):
    """A flag by boolean or, then a filter on it."""
    e = engine(spark, d)
    _top_customers(e, 10)
    e.map("{ top }", "topSpent()", FlatMap("top", "x", Emit("x.custkey", "cast(null as string)", "true"))).map("{ c_custkey c_name }", "customer(c_custkey)", "c_custkey; c_name; false").red("{ name isTop }", "flags(custkey)", Union(FirstNonNull(), BoolOr()))
    return e.map("{ custkey name isTop }", "flags(custkey)", Emit("custkey", "name", when="isTop")).red("{ name }", "topOnly(custkey)", MinValue()).batch()


@query("select user_id, epoch_us(p) - epoch_us(s) as wait from (select user_id, min(ts) filter (where event_type = 'signup') as s, min(ts) filter (where event_type = 'purchase') as p from events where event_type in ('signup', 'purchase') group by 1)")
def self_pair_response(spark, d):
    """One source mapped twice under one key; the formatter is null unless both are there."""
    at = "unix_micros(cast(ts as timestamp))"
    v = engine(spark, d).map("{ user_id event_type ts }", "events(event_id)", Emit("user_id", at, "cast(null as bigint)", when="event_type = 'signup'"))
    v = v.map("{ user_id event_type ts }", "events(event_id)", Emit("user_id", "cast(null as bigint)", at, when="event_type = 'purchase'"))
    return v.red("{ s p }", "first(user_id)", Union(MinValue(), MinValue())).fmt("{ wait }", "p - s").batch()


@query("select c_mktsegment as segment, cast(sum(cast(c_acctbal as decimal(18,2))) as double) / count(*) as average, count(*) // 2 as half from customer group by 1")
def avg_formatter(spark, d):
    v = engine(spark, d).map("{ c_mktsegment c_acctbal }", "customer(c_custkey)", f"c_mktsegment; {cents('c_acctbal')}; 1L").red("{ total n }", "segments(segment)", Sum())
    return v.fmt("{ average half }", "cast(total as double) / n", "n div 2").batch()


@query(f"select coalesce(c_custkey, o_custkey) as custkey, case when price is not null and c_name is not null then c_name || '!' end as label from customer full join {BIG} on c_custkey = o_custkey")
def formatter_null_guard(spark, d):
    return _joined(engine(spark, d)).fmt("{ label }", "concat(coalesce(name, '?'), '!')").batch()


@query("select n, count(*)::bigint as customers from (select o_custkey, count(*) as n from orders group by 1) group by 1")
def cascade_count_of_counts(spark, d):
    e = engine(spark, d)
    e.map("{ o_custkey }", "orders(o_orderkey)", Count("o_custkey")).red("{ n }", "perCustomer(custkey)", Sum())
    return e.map("{ n }", "perCustomer(custkey)", Count("n")).red("{ customers }", "histogram(n)", Sum()).batch()


WORDS = "select word, count(*)::bigint as n from (select unnest(string_split(lower(text), ' ')) as word from conversations) where word <> '' group by 1"


@query(WORDS)
def word_count(spark, d):
    words = "filter(split(lower(text), ' '), w -> w <> '')"
    return engine(spark, d).map("{ text }", "conversations(conv_id turn)", FlatMap(words, "word", Emit("word", "1L"))).red("{ n }", "words(word)", Sum()).batch()


@query("select word, sum(n)::bigint as n, count(*)::bigint as documents from (select conv_id, turn, word, count(*) as n from (select conv_id, turn, unnest(string_split(lower(text), ' ')) as word from conversations) where word <> '' group by 1, 2, 3) group by 1")
def word_count_per_doc_combine(spark, d):
    """Rows of one document are combined first: a view by document and word under the view by word."""
    e = engine(spark, d)
    words = "filter(split(lower(text), ' '), w -> w <> '')"
    e.map("{ conv_id turn text }", "conversations(conv_id turn)", FlatMap(words, "w", Emit("conv_id", "turn", "w", "1L"))).red("{ n }", "perDoc(conv_id turn word)", Sum())
    return e.map("{ word n }", "perDoc(conv_id turn word)", "word; n; 1L").red("{ n documents }", "words(word)", Sum()).batch()


@query("select o_custkey as custkey, count(*)::bigint as n from orders where o_orderstatus = 'F' group by 1")
def conditional_emit(spark, d):
    return engine(spark, d).map("{ o_custkey o_orderstatus }", "orders(o_orderkey)", Emit("o_custkey", "1L", when="o_orderstatus = 'F'")).red("{ n }", "filled(custkey)", Sum()).batch()


@query("select c_custkey as id, c_name as label, c_mktsegment as kind from customer")
def selectall_rename(spark, d):
    return engine(spark, d).map("{ c_custkey c_name c_mktsegment }", "customer(c_custkey)").red("{ label kind }", "renamed(id)", MinValue()).batch()


@query("select user_id, count(*)::bigint as n from events where case when event_type <> 'view' then value end is not null group by 1")
def not_null_projection(spark, d):
    """A record with a null among its declared values is not there for that map, and there for one that leaves it out."""
    e = Engine(spark).source("e(event_id)", table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value")))
    return e.map("{ user_id value }", "e(event_id)", Count("user_id")).red("{ n }", "n(user_id)", Sum()).batch()


LAST = "(select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1)"


@query(f"select user_id, event_id, event_type from {LAST}")
def latest_state(spark, d):
    return latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(f"select event_type as kind, count(*)::bigint as n from {LAST} where event_type <> 'error' group by 1")
def latest_with_deletes(spark, d):
    return engine(spark, d).map("{ kind amount }", "users(user_id)", Count("kind")).red("{ n }", "kinds(kind)", Sum()).batch()


MOVES = """(select user_id, ts, event_id, case when event_type <> 'error' then event_type end as kind, case when event_type <> 'error' then cast(round(value, 2) as decimal(18,2)) end as amount,
  lag(case when event_type <> 'error' then event_type end) over w as kind0 from events window w as (partition by user_id order by ts, event_id))"""


@query(f"select user_id, event_id, kind, cast(amount as double) as amount from {MOVES} where kind is not null union all select user_id, event_id, kind0, null from {MOVES} where kind0 is not null and kind is distinct from kind0")
def moved_keys(spark, d):
    versions = user_versions(table(spark, d, "events"))
    return changes.moved_keys(versions, ["user_id"], ["ts", "event_id"], ["kind"], ["amount"]).select("user_id", "event_id", "kind", "amount")


@query("select user_id, event_id, kind, op from (select user_id, event_id, kind, case when kind is null then 'D' else 'U' end as op, lag(kind) over w as k0, lag(event_id) over w as e0 from (select user_id, ts, event_id, case when event_type <> 'error' then event_type end as kind from events) window w as (partition by user_id order by ts, event_id)) where (e0 is null and kind is not null) or (e0 is not null and k0 is distinct from kind)")
def changes_only(spark, d):
    versions = user_versions(table(spark, d, "events")).select("user_id", "ts", "event_id", "kind")
    return changes.changes(versions, ["user_id"], ["ts", "event_id"], ["kind"]).select("user_id", "event_id", "kind", F.col("_op").alias("op"))


@query(f"""select kind, event_id, case when sum(c) over w > 0 then sum(1) filter (where false) over w end as nothing, sum(c) over w as live from (
  select kind, ts, event_id, sum(c) as c from (select kind, ts, event_id, 1 as c from {MOVES} where kind is not null union all select kind0, ts, event_id, -1 from {MOVES} where kind0 is not null) group by 1, 2, 3) window w as (partition by kind order by ts, event_id rows unbounded preceding)""".replace("case when sum(c) over w > 0 then sum(1) filter (where false) over w end as nothing, sum(c) over w as live", "case when sum(c) over w > 0 then cast(sum(c) over w as double) end as total"))
def default_stream(spark, d):
    """Each update's new total of the keys it concerns, changed or not: here the users of each kind."""
    versions = user_versions(table(spark, d, "events")).withColumn("one", F.when(F.col("kind").isNotNull(), F.lit(1.0)))
    return changes.prefix_sums(versions, ["user_id"], ["ts", "event_id"], "kind", "one").select("kind", "event_id", "total")


@query("select distinct o_orderstatus as status, o_orderpriority as priority from orders")
def reduce_none(spark, d):
    return engine(spark, d).map("{ o_orderstatus o_orderpriority }", "orders(o_orderkey)", "o_orderstatus; o_orderpriority; 1").red("{ one }", "pairs(status priority)", MinValue()).batch().select("status", "priority")


@query("select o_custkey as custkey, bool_or(o_totalprice > 400000) as big from orders group by 1")
def bool_or_flag(spark, d):
    return engine(spark, d).map("{ o_custkey o_totalprice }", "orders(o_orderkey)", "o_custkey; o_totalprice > 400000").red("{ big }", "flags(custkey)", BoolOr()).batch()


@query("select c_custkey as custkey, c_name as name, n as orders from customer full join (select o_custkey, count(*)::bigint as n from orders group by 1) on c_custkey = o_custkey")
def first_non_null(spark, d):
    v = engine(spark, d).map("{ c_custkey c_name }", "customer(c_custkey)", "c_custkey; c_name; cast(null as bigint)").map("{ o_custkey }", "orders(o_orderkey)", "o_custkey; cast(null as string); 1L")
    return v.red("{ name orders }", "both(custkey)", Union(FirstNonNull(), Sum())).batch()


@query("select o_custkey as custkey, max(o_orderkey) - min(o_orderkey) as spread from orders group by 1")
def fold_expr(spark, d):
    v = engine(spark, d).map("{ o_custkey o_orderkey }", "orders(o_orderkey)", "o_custkey; o_orderkey; o_orderkey").red("{ lo hi }", "range(custkey)", FoldExpr("least(a.lo, b.lo)", "greatest(a.hi, b.hi)"))
    return v.fmt("{ spread }", "hi - lo").batch()


@query("select o_custkey as custkey, bit_xor(o_orderkey) as x from orders group by 1")
def python_fold(spark, d):
    """An opaque fold in Python, over sorted partitions."""
    return engine(spark, d).map("{ o_custkey o_orderkey }", "orders(o_orderkey)").red("{ x }", "xor(custkey)", PyFold(lambda a, b: (a[0] ^ b[0],))).batch()


@query("select user_id, count(*)::bigint as n from (select user_id from events union all select user_id + 1 from events) group by 1")
def emit_several(spark, d):
    v = engine(spark, d).map("{ user_id }", "events(event_id)", EmitAll(Emit("user_id", "1L"), Emit("user_id + 1", "1L")))
    return v.red("{ n }", "n(user_id)", Sum()).batch()


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_scheme(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("props").alias("value"))
    return schemes.JsonScheme("k long").apply(e, meta=["event_id"])


@query("select event_id as id, user_id as \"user\", event_type as kind from events")
def tuple_scheme(spark, d):
    e = table(spark, d, "events").select(F.to_json(F.array(F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type"))).alias("value"))
    return schemes.TupleScheme("id long, user long, kind string").apply(e)


@query("select cast(event_id as varchar) as id, case when event_type <> 'error' then event_type end as kind, case when event_type <> 'error' then cast(user_id as varchar) end as name from events")
def path_scheme_delete(spark, d):
    e = table(spark, d, "events")
    gone = F.to_json(F.struct(F.struct(F.struct(F.col("event_id").cast("string").alias("id_str")).alias("status")).alias("delete")))
    here = F.to_json(F.struct(F.col("event_id").cast("string").alias("id_str"), F.col("event_type").alias("text"), F.struct(F.col("user_id").cast("string").alias("name")).alias("user")))
    messages = e.select(F.when(F.col("event_type") == "error", gone).otherwise(here).alias("value")).unionByName(spark.createDataFrame([("{bad",), ("{}",)], "value string"))
    return schemes.PathScheme("id", (("id", "id_str"), ("kind", "text"), ("name", "user.name"))).apply(messages)


@query("select str, topic, \"offset\" from (select cast(event_type as varchar) as str, 'events' as topic, event_id as \"offset\" from events)")
def meta_scheme(spark, d):
    e = table(spark, d, "events").select(F.lit("events").alias("topic"), F.col("event_id").alias("offset"), F.encode("event_type", "UTF-8").alias("value"))
    return schemes.MetaScheme(schemes.StringScheme()).apply(e)


def _updates(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("uuid"), F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("amount"))
    return docstore.flat(e, "users", ["user_id"], "ts", "uuid")


@query("select cast(user_id as varchar) as id, 'amount' as \"column\", cast(cast(floor(value) as bigint) as varchar) as value from (select *, row_number() over (partition by user_id order by ts desc, floor(value) desc) as r from events) where r = 1 union all select cast(user_id as varchar), 'kind', '\"' || event_type || '\"' from (select *, row_number() over (partition by user_id order by ts desc, event_type desc) as r from events) where r = 1")
def lww_merge(spark, d):
    return docstore.merge(_updates(spark, d)).select(F.get("key", F.lit(0)).alias("id"), F.get("path", F.lit(0)).alias("column"), "value")


@query("select cast(user_id as varchar) as id, cast(max(cast(floor(value) as bigint)) as varchar) as value from events group by 1")
def lww_tie(spark, d):
    """All versions at one time: the larger value wins."""
    e = table(spark, d, "events").select("user_id", F.lit(1000).alias("ts"), F.floor("value").cast("long").alias("amount"))
    return docstore.merge(docstore.flat(e, "users", ["user_id"], "ts")).select(F.get("key", F.lit(0)).alias("id"), "value")


@query("select cast(o_custkey as varchar) as id, 'orders/' || cast(o_orderkey as varchar) || '/status' as path, '\"' || o_orderstatus || '\"' as value from orders")
def nested_relations(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_orderstatus").alias("status"))
    long = docstore.flat(o, "customers", ["o_custkey", "o_orderkey"], "ts", prefix=("orders", "$o_orderkey"))
    return docstore.merge(long).select(F.get("key", F.lit(0)).alias("id"), F.array_join("path", "/").alias("path"), "value")


@query("select cast(user_id as varchar) as id, event_id, value from (select user_id, event_id, cast(cast(floor(value) as bigint) as varchar) as value, floor(value) as v, ts, max(row(ts, floor(value))) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from events) where before is null or row(ts, v) > before")
def change_log(spark, d):
    """Updates in order of arrival (event_id); those that lose to what is there make no change."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("uuid"), F.floor("value").cast("long").alias("amount"))
    x = docstore.flat(e, "users", ["user_id"], "ts", "uuid").withColumn("seq", F.col("uuid").cast("long"))
    return docstore.change_log(x).select(F.get("key", F.lit(0)).alias("id"), F.col("seq").alias("event_id"), "value")


@query("select cast(user_id as varchar) as id, cast(cast(floor(value) as bigint) as varchar) as value from (select *, row_number() over (partition by user_id order by ts desc, floor(value) desc) as r from events) where r = 1")
def two_cluster_union(spark, d):
    """Two clusters with half the updates each, subscribed to one another, hold what one with all would."""
    x = _updates(spark, d).where(F.get("path", F.lit(0)) == "amount")
    even = F.col("uuid").cast("long") % 2 == 0
    return docstore.subscribe(x.where(even), docstore.change_log(x.where(~even))).select(F.get("key", F.lit(0)).alias("id"), "value")


def _messages(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.lit("events").alias("topic"), F.lit("h").alias("hostname"), F.lit(9092).alias("port"), F.col("user_id").cast("int").alias("partition"), (F.row_number().over(_by_user()) - 1).cast("long").alias("offset"), F.row_number().over(_by_user()).cast("long").alias("nextOffset"), F.encode("event_type", "UTF-8").alias("bytes"))


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("event_id")


@query("select user_id as \"partition\", o as \"offset\", str from (select user_id, o, str, sum(length(str)) over (partition by user_id order by o rows unbounded preceding) as size from (select user_id, row_number() over (partition by user_id order by event_id) - 1 as o, event_type as str from events) where o >= 3) where size <= 60")
def archive_fetch(spark, d):
    return replay.fetched(_messages(spark, d), 3, 60).select(F.col("partition").cast("long").alias("partition"), "offset", F.col("bytes").cast("string").alias("str"))


@query("select user_id as \"partition\", count(*)::bigint as n from events group by 1")
def replay_union_dedup(spark, d):
    """The archive below the live source's first offset, live from there: nothing is lost or doubled."""
    m = _messages(spark, d)
    return replay.replay(m.where("offset < 40"), m.where("offset >= 20")).groupBy(F.col("partition").cast("long").alias("partition")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select user_id, event_id, case when event_type <> 'error' then event_type end as kind from {LAST}")
def sink_dedupe(spark, d):
    return publishers.last_of_each(user_versions(table(spark, d, "events")).select("user_id", "ts", "event_id", "kind"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "kind")


@query(f"select user_id, event_type = 'error' as gone from {LAST}")
def sink_delete_all_null(spark, d):
    rows = publishers.last_of_each(user_versions(table(spark, d, "events")), ["user_id"], ["ts", "event_id"]).select("user_id", "kind", "amount")
    return rows.select("user_id", publishers.is_delete(rows, ["user_id"]).alias("gone"))


def _last_users(spark, d) -> DataFrame:
    """The last version of each user, as a publisher gets it: what is not an id is null where the user is deleted."""
    return publishers.last_of_each(user_versions(table(spark, d, "events")), ["user_id"], ["ts", "event_id"]).select("user_id", "kind", F.lit(None).cast("string").alias("note"))


@query(f"select cast(user_id as varchar) as \"row\", event_type = 'error' as gone, case when event_type <> 'error' then '\"' || event_type || '\"' else 'null' end as kind, 'null' as note from {LAST}")
def key_value_cells(spark, d):
    """The cells that a key/value store gets: JSON by field, under the ids joined by '/'."""
    x = publishers.KeyValue.cells(["user_id"], _last_users(spark, d))
    return x.select("row", "gone", F.col("cells")["kind"].alias("kind"), F.col("cells")["note"].alias("note"))


_ID = "'[\"users\",\"' || user_id || '\"]'"


@query(f"select {_ID} as id, event_type = 'error' as gone, '{{\"_id\":' || to_json({_ID}) || ',\"type\":\"users\",\"user_id\":' || user_id || ',\"kind\":' || case when event_type <> 'error' then '\"' || event_type || '\"' else 'null' end || ',\"note\":null}}' as body from {LAST}")
def http_documents(spark, d):
    """The requests that a document store gets."""
    return publishers.HttpDocuments.requests("users", ["user_id"], _last_users(spark, d))


@query(f"select '[\"' || user_id || '\"]' as \"key\", case when event_type <> 'error' then user_id || ' ' || event_type end as value, 'wc' as topic from {LAST}")
def kafka_text_messages(spark, d):
    """The messages of a topic of changes, written as text; a deletion has no value."""
    return publishers.KafkaTopic("", "wc", "concat(user_id, ' ', kind)").messages(["user_id"], _last_users(spark, d).withColumns({"_op": F.lit("U"), "_changed": F.lit(True)}))


@query("select '[\"' || n_nationkey || '\"]' as \"key\", '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' as value from nation")
def json_messages(spark, d):
    return schemes.json_records(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


@query("select o_custkey as custkey, '{\"value\":' || count(*) || '}' as body from orders group by 1")
def dashboard_counter(spark, d):
    v = engine(spark, d).map("{ o_custkey }", "orders(o_orderkey)", Count("o_custkey")).red("{ n }", "perCustomer(custkey)", Sum()).batch()
    return v.join(publishers.counter(v, "n").distinct(), F.concat(F.lit('{"value":'), "n", F.lit("}")) == F.col("body")).select("custkey", "body")


@query("select '[' || string_agg('{\"name\":' || user_id || ',\"values\":[' || n || ']}', ',' order by n desc, user_id desc) || ']' as board from (select user_id, count(*) as n from events group by 1 order by n desc, user_id desc limit 10)")
def dashboard_leaderboard(spark, d):
    e = engine(spark, d)
    e.map("{ user_id }", "events(event_id)", Count("user_id")).red("{ n }", "perUser(user_id)", Sum())
    top = e.map("{ n user_id }", "perUser(user_id)", TopNMapper("n", "user_id")).red("{ top }", "busiest()", TopN(10)).batch()
    return publishers.leaderboard(top, "top", "user_id", "n")


@query("select event_id as id, event_type as kind from events where event_type <> 'error'")
def keyed_scheme(spark, d):
    """Messages without their key field are dropped."""
    e = table(spark, d, "events").select(F.to_json(F.struct(F.when(F.col("event_type") != "error", F.col("event_id")).alias("id"), F.col("event_type").alias("kind"))).alias("value"))
    return schemes.KeyedScheme(schemes.JsonScheme("id long, kind string"), ("id",)).apply(e)


@query("select case when user_id < 10 then 'a' when user_id < 20 then 'b' end as hostname, case when user_id < 10 then 9092 when user_id < 20 then 9093 end::bigint as port, user_id % 10 as \"partition\", count(*)::bigint as n from events group by all")
def static_brokers(spark, d):
    """Where messages come from, with ten partitions on each of two brokers."""
    live = table(spark, d, "events").select(F.lit("events").alias("topic"), F.col("user_id").cast("int").alias("partition"), F.col("event_id").alias("offset"), F.encode("event_type", "UTF-8").alias("value"))
    options = schemes.KafkaOptions("a:9092", "events", hosts=schemes.StaticHosts(("a", "b:9093"), 10))
    found = replay.ReplayOptions(options, "", schemes.StringScheme()).messages(live)
    return found.groupBy("hostname", F.col("port").cast("long").alias("port"), F.col("partition").cast("long").alias("partition")).agg(F.count(F.lit(1)).alias("n"))


def _work(spark) -> str:
    return f"{work_dir(spark)}/foldview-query-{uuid.uuid4().hex}"


@query("select user_id as \"partition\", count(*)::bigint as n, sum(length(event_type))::bigint as letters from events group by 1")
def archive_written(spark, d):
    """Messages kept in an archive, some of them twice: each is read once."""
    kept, m = replay.Archive(spark, _work(spark)), _messages(spark, d)
    kept.write(m)
    kept.write(m.where("offset < 5"))
    return kept.read().groupBy(F.col("partition").cast("long").alias("partition")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("bytes")).cast("long").alias("letters"))


@query("select cast(user_id as varchar) as id, 'amount' as \"column\", cast(cast(floor(value) as bigint) as varchar) as value from (select *, row_number() over (partition by user_id order by ts desc, floor(value) desc) as r from events) where r = 1 union all select cast(user_id as varchar), 'kind', '\"' || event_type || '\"' from (select *, row_number() over (partition by user_id order by ts desc, event_type desc) as r from events) where r = 1")
def cluster_snapshot(spark, d):
    """Two batches of updates written to a cluster, to which another subscribes that had the second alone."""
    x, work = _updates(spark, d), _work(spark)
    even = F.col("uuid").cast("long") % 2 == 0
    a, b = Cluster(spark, f"{work}/a"), Cluster(spark, f"{work}/b")
    b.put_batch(x.where(~even))
    a.put_batch(x.where(even))
    b.take_from(a)
    return b.snapshot().select(F.get("key", F.lit(0)).alias("id"), F.get("path", F.lit(0)).alias("column"), "value")


_NATION = "'{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}'"


def _nations(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.lit(5).alias("ts"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return docstore.flat(n, "nations", ["n_nationkey"], "ts")


@query(f"select 'nations' as \"table\", cast(n_nationkey as varchar) as id, {_NATION} as json from nation")
def document_json(spark, d):
    return docstore.as_json(_nations(spark, d)).select("table", F.get("key", F.lit(0)).alias("id"), "json")


@query("select cast(n_nationkey as varchar) as id, '\"' || n_name || '\"' as name, 5::bigint as name_ts, cast(n_regionkey as varchar) as region from nation")
def document_maps(spark, d):
    """A document with its versions: column to value and column to timestamp."""
    return docstore.documents(_nations(spark, d)).select(F.get("key", F.lit(0)).alias("id"), F.col("doc")["name"].alias("name"), F.col("timestamps")["name"].alias("name_ts"), F.col("doc")["region"].alias("region"))


@query("select 'name' as \"column\", '\"' || n_name || '\"' as value from nation where n_nationkey = 7 union all select 'region', cast(n_regionkey as varchar) from nation where n_nationkey = 7")
def point_read(spark, d):
    return docstore.get(_nations(spark, d), "nations", ["7"]).select(F.get("path", F.lit(0)).alias("column"), "value")


@query("select '[\"nations\",\"' || n_nationkey || '\"]' as \"key\", '{\"table\":\"nations\",\"key\":[\"' || n_nationkey || '\"],\"value\":' || " + _NATION + " || ',\"ts\":5,\"uuid\":\"\"}' as value from nation")
def update_messages(spark, d):
    return wire.update_messages(_nations(spark, d))


@query("select cast(o_custkey as varchar) as id, 'orders/' || cast(o_orderkey as varchar) || '/status' as path, '\"' || o_orderstatus || '\"' as value, 9::bigint as ts, 'u' as uuid from orders")
def messages_as_updates(spark, d):
    """Orders as child documents of their customers, in one message a customer, read back column by column."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit(9).alias("ts"), F.lit("u").alias("uuid"), F.col("o_orderstatus").alias("status"))
    sent = wire.update_messages(docstore.flat(o, "customers", ["o_custkey", "o_orderkey"], "ts", "uuid", prefix=("orders", "$o_orderkey")))
    return wire.updates(sent).select(F.get("key", F.lit(0)).alias("id"), F.array_join("path", "/").alias("path"), "value", "ts", "uuid")


@query("select cast(n_nationkey as varchar) as id, cast(n_regionkey + 1 as varchar) as region, 6::bigint as ts, '\"' || n_name || '\"' as name, 1::bigint as n_update from nation")
def messages_as_changes(spark, d):
    """Changes of one column, each sent with its whole document, read back."""
    before = _nations(spark, d)
    moved = before.where("path[0] = 'region'").withColumns({"value": F.expr("cast(cast(value as long) + 1 as string)"), "ts": F.lit(6).cast("long")})
    got = wire.changes(wire.change_messages(docstore.change_log(moved, before), docstore.subscribe(before, moved)))
    at = lambda cells, name: F.get(F.filter(cells, lambda c: F.get(c["path"], F.lit(0)) == name), F.lit(0))["value"]
    return got.select(F.get("key", F.lit(0)).alias("id"), at("snapshot", "region").alias("region"), F.col("timestamp").alias("ts"), at("snapshot", "name").alias("name"), F.size("update").cast("long").alias("n_update"))


@query("select o_custkey as custkey, (count(*) // 2)::bigint as pairs, max(o_orderkey)::bigint as newest from orders group by 1")
def text_views(spark, d):
    """A view in the text front end, with a fold and a format written as expressions."""
    script = "MAP { o_custkey o_orderkey } FROM orders(o_orderkey) USE {[o_custkey, 1L, o_orderkey]}\nRED { n newest } INTO perCustomer(custkey) USE { a, b -> [a.n + b.n, greatest(a.newest, b.newest)] }\nFMT { pairs newest } USE {[n div 2, newest]}"
    return language.run(engine(spark, d), script)[-1].batch()


@query("select n, count(*)::bigint as customers from (select o_custkey, count(*)::bigint as n from orders where o_orderstatus = 'F' group by 1) group by 1")
def sql_over_views(spark, d):
    """A transformed DataFrame as a source, and SQL over the view it feeds."""
    e = Engine(spark, namespace=f"ns{uuid.uuid4().hex}").source("done(o_orderkey)", table(spark, d, "orders").where("o_orderstatus = 'F'"))
    e.map("{ o_custkey }", "done(o_orderkey)", Count("o_custkey")).red("{ n }", "perCustomer(custkey)", Sum())
    e.register("perCustomer")
    return spark.sql(f"select n, count(*) as customers from {e.namespace}_perCustomer group by n")


@query("select 'status' as view, o_orderstatus as \"key\", count(*)::bigint as n from orders group by all union all select 'priority', o_orderpriority, count(*) from orders group by all")
def published_views(spark, d):
    """Two views published to one table store, and read back."""
    from .sinks.publishers import ParquetTable

    e = engine(spark, d)
    e.map("{ o_orderstatus }", "orders(o_orderkey)", Count("o_orderstatus")).red("{ n }", "status(key)", Sum())
    e.map("{ o_orderpriority }", "orders(o_orderkey)", Count("o_orderpriority")).red("{ n }", "priority(key)", Sum())
    store = ParquetTable(spark, _work(spark))
    publishers.publish_all(e, ["status", "priority"], store)
    one = lambda name: store.read(name).select(F.lit(name).alias("view"), "key", "n")
    return one("status").unionByName(one("priority"))


def _streamed(spark: SparkSession, d: str, build, name: str) -> DataFrame:
    """Run a view as a stream over the events' files in a few batches; its rows after the last one."""
    from .sinks.publishers import ParquetTable

    work = f"{work_dir(spark)}/foldview-stream-{uuid.uuid4().hex}"
    # a stream's stages are not coalesced: each partition is a worker to start and a store to commit in every batch
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    store = "spark.sql.streaming.stateStore"
    held = {
        f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{store}.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.shuffle.partitions": str(tasks),
    }
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        schema = spark.read.parquet(f"{d}/events.parquet").schema
        # four batches by arrival, each of a file for every task: a stream in the shared folder
        events = spark.read.parquet(f"{d}/events.parquet")
        events.repartitionByRange(4 * tasks, "event_id").write.parquet(f"{work}/in")
        e = Engine(spark)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", tasks).parquet(f"{work}/in")
        e.source("events(event_id)", stream, seq="event_id").source("users(user_id)", user_versions(stream), seq=("ts", "event_id"))
        build(e)
        sink = ParquetTable(spark, f"{work}/out", tasks)  # all buckets change in each of the few batches
        e.publish(name, sink, f"{work}/checkpoint").awaitTermination()
        return sink.read(name)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@query(LEDGER)
def stream_ledger(spark, d):
    return _streamed(spark, d, ledger, "ledger").select("user_id", F.col("balance").cast("double").alias("balance"))


@query(f"select event_type as kind, count(*)::bigint as n from {LAST} where event_type <> 'error' group by 1")
def stream_moved_keys(spark, d):
    """Users move from kind to kind and are deleted; each kind's count follows."""
    return _streamed(spark, d, lambda e: e.map("{ kind amount }", "users(user_id)", Count("kind")).red("{ n }", "kinds(kind)", Sum()).salted(4), "kinds")


@query("select n, count(*)::bigint as users from (select user_id, count(*) as n from events group by 1) group by 1")
def stream_cascade(spark, d):
    def build(e: Engine) -> None:
        e.map("{ user_id }", "events(event_id)", Count("user_id")).red("{ n }", "perUser(user_id)", Sum())
        e.map("{ n }", "perUser(user_id)", Count("n")).red("{ users }", "histogram(n)", Sum())

    return _streamed(spark, d, build, "histogram")


@query("select event_type as kind, count(*)::bigint as n, max(user_id)::bigint as most from events group by 1")
def stream_fold_expr(spark, d):
    """A fold written in SQL expressions, as the text front end makes them."""
    script = "MAP { event_type user_id } FROM events(event_id) USE {[event_type, 1L, user_id]}\nRED { n most } INTO folded(kind) USE { a, b -> [a.n + b.n, greatest(a.most, b.most)] }"
    return _streamed(spark, d, lambda e: language.run(e, script), "folded")


@query(f"select event_type as kind, count(*)::bigint as n, sum(user_id)::bigint as ids, min(user_id)::bigint as first from {LAST} where event_type <> 'error' group by 1")
def stream_union(spark, d):
    """Each column by its own reducer, with running totals, while users move between kinds and are deleted."""
    return _streamed(spark, d, lambda e: e.map("{ user_id kind amount }", "users(user_id)", "kind; 1L; user_id; user_id").red("{ n ids first }", "folded(kind)", Union(Sum(), Sum(), MinValue())), "folded")


@query("select user_id % 50 as bucket, sum(length(event_type))::bigint as letters from events group by 1")
def stream_python_map(spark, d):
    """An opaque mapper in Python; the fold is one of sums."""
    return _streamed(spark, d, lambda e: e.map("{ user_id event_type }", "events(event_id)", PyMap(lambda r: [(r["user_id"] % 50, len(r["event_type"]))], "long", "long")).red("{ letters }", "folded(bucket)", Sum()), "folded")


@query("select user_id, rank, amount from (select user_id, amount, row_number() over (partition by user_id order by amount desc) as rank from (select distinct user_id, round(value, 2) as amount from events where event_type = 'purchase')) where rank <= 3")
def stream_topn(spark, d):
    def build(e: Engine) -> None:
        e.map("{ user_id event_type value }", "events(event_id)", Emit("user_id", "array(struct(round(value, 2) as amount))", when="event_type = 'purchase'")).red("{ top }", "top(user_id)", TopN(3))

    rows = _streamed(spark, d, build, "top")
    return rows.select("user_id", F.posexplode("top").alias("p", "x")).select("user_id", (F.col("p") + 1).cast("long").alias("rank"), F.col("x.amount").alias("amount"))
