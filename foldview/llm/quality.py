"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source.

Native: DataFrame functions only.  Every document gets four measures; each (lang, source) group keeps a
quantile sketch of each measure, a histogram over integer buckets of bounded relative width (7 significant
bits, so a quantile is off by under 1/64 of its value).  Such sketches merge by adding counts: partial
aggregation adds them map-side, and groups with too few documents use their language's merged sketch, or
all documents' merged sketch.  The fence of a group is q75 + 3 * max(q75 - q25, slack) (and the mirror
below for word length); a document outside a fence of its group is rejected.  The base rules of the
contract apply first.

A sketch's size is (groups * measures * buckets), a bounded number of buckets for each group, however many
rows a group holds, so a source with a third of all rows is no hot key.

Defined results: null text counts as empty (0 words: base_failed); null lang or source form a group of
their own; repeated rows are judged each on its own; an empty table gives an empty table; extra columns
are ignored by `judge` and kept by `keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import needed, numbered, settled, table

SPACE = r"[\x20\x09-\x0D]+"
MIN_GROUP = 100
FENCE = 3
#: measure -> (slack of the upper fence, slack of the lower fence or None); per mille, word length in hundredths
MEASURES = {"symbol_rate": (100, None), "dup_line_rate": (100, None), "repeat_rate": (100, None), "word_length": (100, 100)}


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows found twice or more: sort windows by hash, keep those with an equal neighbour, add up their cover."""
    grams = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    twice = lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
    at = lambda kept: F.sort_array(F.transform(kept, lambda x: x["i"]))
    cover = lambda p: F.aggregate(p, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))["n"]
    # one-element arrays bind an intermediate value once, instead of once for each element
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return bind(F.sort_array(grams), lambda s: bind(at(twice(s)), cover))


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_text", text).withColumn("_words", _words(F.col("_text")))
    return df.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.coalesce(_repeat_words(F.col("_words")), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _rates(df: DataFrame) -> DataFrame:
    per = lambda n, k: F.when(F.col("n_words") > 0, F.expr(f"({n} * {k}) div n_words")).otherwise(0).cast("long")
    return df.withColumns({"symbol_rate": per("n_symbols", 1000), "dup_line_rate": per("n_dup_lines", 1000), "repeat_rate": per("n_repeat_words", 1000), "word_length": per("word_chars", 100)})


def bucket(v: Column) -> Column:
    """The value with all but its 7 leading bits cleared."""
    low = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def sketches(rated: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: one mergeable histogram for each group and measure."""
    long = rated.where(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("x")).select("lang", "source", "x.measure", "x.bucket")
    return long.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(hist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, total, q25, q75 of merged histograms; equal to the lower quantile of the bucketed values."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "measure")
    merged = hist.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    q = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bucket")))
    return run.groupBy(*keys, "measure").agg(F.max("total").alias("total"), q(25).alias("q25"), q(75).alias("q75"))


def fences(hist: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source and, for each measure, lo_ and hi_: of the group itself, else of its language, else of all."""
    own, by_lang, whole = _quartiles(hist, ["lang", "source"]), _quartiles(hist, ["lang"]), _quartiles(hist, [])
    a, b, c = own.alias("a"), by_lang.alias("b"), whole.alias("c")
    q = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.measure") == F.col("b.measure"))).join(c, F.col("a.measure") == F.col("c.measure"))
    pick = lambda k: F.when(F.col("a.total") >= min_group, F.col(f"a.{k}")).when(F.col("b.total") >= min_group, F.col(f"b.{k}")).otherwise(F.col(f"c.{k}"))
    q = q.select("a.lang", "a.source", "a.measure", pick("q25").alias("q25"), pick("q75").alias("q75"))
    up, down = F.lit(None).cast("long"), F.lit(None).cast("long")
    for m, (hi, lo) in MEASURES.items():
        up = F.when(F.col("measure") == m, F.lit(hi)).otherwise(up)
        down = F.when(F.col("measure") == m, F.lit(lo).cast("long")).otherwise(down)
    spread = F.col("q75") - F.col("q25")
    q = q.withColumns({"hi": F.col("q75") + FENCE * F.greatest(spread, up), "lo": F.when(down.isNotNull(), F.col("q25") - FENCE * F.greatest(spread, down))})
    return q.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col(k))).alias(f"{k}_{m}") for m in MEASURES for k in ("lo", "hi")])


def _judged(docs: DataFrame, min_group: int) -> DataFrame:
    """Every row's measures and verdict, with _h, which tells rows of equal doc_id apart."""
    docs = needed(docs, doc_id="long", text="string", lang="string", source="string").withColumn("_h", F.xxhash64("text"))
    base = measured(docs).drop("text").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rated = settled(docs.sparkSession, _rates(base), "quality")  # measured once, used by the sketches and by the filter
    f = fences(sketches(rated), min_group).withColumnsRenamed({"lang": "_l", "source": "_s"})
    joined = rated.join(f, rated["lang"].eqNullSafe(F.col("_l")) & rated["source"].eqNullSafe(F.col("_s")), "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce((F.col(m) <= F.col(f"hi_{m}")) & (F.col(f"lo_{m}").isNull() | (F.col(m) >= F.col(f"lo_{m}"))), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def judge(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row of docs."""
    return _judged(docs, min_group).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    kept = _judged(docs, min_group).where("kept").select(F.col("doc_id").alias("d"), F.col("_h").alias("h")).distinct()
    plain, doc, text = numbered(docs), *(f"_{docs.columns.index(c)}" for c in ("doc_id", "text"))
    own = F.xxhash64(F.col(text).cast("string")) == F.col("h")
    return plain.join(kept, F.col(doc).cast("long").eqNullSafe(F.col("d")) & own, "left_semi").toDF(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    ws = r"[\x20\x09-\x0D]+"
    rate = lambda n, k: f"case when n_words > 0 then ({n} * {k}) // n_words else 0 end::bigint"
    cut = lambda m: f"(({m} >> greatest(length(bin({m})) - 7, 0)) << greatest(length(bin({m})) - 7, 0))"
    quart = lambda keys: f"select {keys} measure, max(total) as total, min(case when upto * 100 >= total * 25 then bucket end) as q25, min(case when upto * 100 >= total * 75 then bucket end) as q75 from (select {keys} measure, bucket, sum(n) over (partition by {keys} measure order by bucket) as upto, sum(n) over (partition by {keys} measure) as total from (select {keys} measure, bucket, sum(n) as n from hist group by all)) group by all"
    long = " union all ".join(f"select lang, source, '{m}' as measure, {cut(m)} as bucket from rated where not base_failed" for m in MEASURES)
    pick = lambda k: f"case when a.total >= {MIN_GROUP} then a.{k} when b.total >= {MIN_GROUP} then b.{k} else c.{k} end as {k}"
    up = "case measure " + " ".join(f"when '{m}' then {hi}" for m, (hi, _) in MEASURES.items()) + " end"
    down = "case measure " + " ".join(f"when '{m}' then {lo}" for m, (_, lo) in MEASURES.items() if lo is not None) + " end"
    wide = ", ".join(f"max(case when measure = '{m}' then {k} end) as {k}_{m}" for m in MEASURES for k in ("lo", "hi"))
    inside = " and ".join(f"{m} <= hi_{m} and (lo_{m} is null or {m} >= lo_{m})" for m in MEASURES)
    return f"""
with t as (select doc_id, lang, source, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}'), lambda w: w <> '') as words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines from documents),
g as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from t where len(words) >= 3),
k as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as c from g),
r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from k where c > 1) group by doc_id),
base as (select t.doc_id, lang, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words from t left join r on t.doc_id = r.doc_id),
rated as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {rate('n_symbols', 1000)} as symbol_rate, {rate('n_dup_lines', 1000)} as dup_line_rate, {rate('n_repeat_words', 1000)} as repeat_rate, {rate('word_chars', 100)} as word_length from base),
hist as (select lang, source, measure, bucket, count(*) as n from ({long}) group by all),
own as ({quart('lang, source,')}), bylang as ({quart('lang,')}), whole as ({quart('')}),
q as (select a.lang, a.source, a.measure, {pick('q25')}, {pick('q75')} from own a join bylang b on a.lang is not distinct from b.lang and a.measure = b.measure join whole c on a.measure = c.measure),
f as (select lang, source, measure, q75 + {FENCE} * greatest(q75 - q25, {up}) as hi, case when {down} is not null then q25 - {FENCE} * greatest(q75 - q25, {down}) end as lo from q),
w as (select lang, source, {wide} from f group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({inside}, false) as kept
from rated left join w on rated.lang is not distinct from w.lang and rated.source is not distinct from w.source"""
