"""Weighted URL vocabulary: Aho-Corasick over strict and soft terms, with boundary checks, below host/path rules.

A url is rejected by the method when one strict term occurs, or when at least ``min_soft``
*distinct* soft terms occur.  A term counts only when the characters on both sides are not
ASCII letters or digits, so ``essex`` has no hit of ``sex``.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by its
whole string (null: no terms, so ``allow``).  Repeated rows are judged each on its own; an empty table
gives an empty table; extra columns of the input are ignored.  There is no shuffle and no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import needed, table

STRICT = ("porn", "porno", "xxx", "casino", "viagra", "cialis", "hentai", "escorts", "torrent", "warez", "camgirls", "sportsbook")
SOFT = ("adult", "x", "sex", "cheap", "pills", "pharmacy", "free", "bets", "bet", "betting", "win", "spam", "farm", "ads", "ad", "track", "tracker", "clicks", "poker", "loan", "loans", "dating", "nude", "crack", "keygen", "download", "replica", "bonus")
MIN_SOFT = 2
#: (host, path, verdict); a rule fits the host and its subdomains where the path starts with the rule's path
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ASCII_UP, ASCII_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def automaton(strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for weight, terms in ((0, soft), (1, strict)):
        for term in terms:
            found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def count_terms(url: str | None, terms: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict and distinct soft terms of a url."""
    if not url:
        return 0, 0
    text, hits = url.translate(str.maketrans(ASCII_UP, ASCII_LOW)), (set(), set())
    edge = lambda i: not (0 <= i < len(text)) or not (text[i].isascii() and text[i].isalnum())
    for end, (term, weight) in terms.iter(text):
        if edge(end + 1) and edge(end - len(term)):
            hits[weight].add(term)
    return len(hits[1]), len(hits[0])


def term_counts(df: DataFrame, strict: tuple[str, ...], soft: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(strict, soft)
        for batch in batches:
            pairs = [count_terms(u, terms) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32())], names=["page_id", "url", "n_strict", "n_soft"])

    return needed(df, page_id="long", url="string").mapInArrow(run, "page_id long, url string, n_strict int, n_soft int")


def filter_urls(pages: DataFrame, rules=RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft for every row of `pages` (page_id, url)."""
    scored = term_counts(pages, strict, soft)
    after = F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end")
    rest = F.substring_index(F.substring_index(F.coalesce(after, F.lit("")), "#", 1), "?", 1)
    scored = scored.withColumn("rest", rest).withColumn("host", F.translate(F.substring_index("rest", "/", 1), ASCII_UP, ASCII_LOW))
    scored = scored.withColumn("path", F.expr("case when instr(rest, '/') > 0 then substring(rest, instr(rest, '/')) else '' end"))
    rule, verdict = F.lit(None).cast("string"), F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= min_soft), "block").otherwise("allow")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest comes last and so wins
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "n_strict", "n_soft")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def oracle_sql() -> str:
    """The same in SQL: one boundary-checked pattern a term."""
    hits = lambda terms: " + ".join(f"(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))::int" for t in terms)
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    by_length = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in by_length)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in by_length)
    low = f"translate(coalesce(url, ''), '{ASCII_UP}', '{ASCII_LOW}')"
    return f"""
with a as (select page_id, {low} as low, case when instr(coalesce(url, ''), '://') > 0 then split_part(split_part(substr(url, instr(url, '://') + 3), '#', 1), '?', 1) else '' end as rest from pages),
b as (select page_id, low, translate(split_part(rest, '/', 1), '{ASCII_UP}', '{ASCII_LOW}') as host, case when instr(rest, '/') > 0 then substr(rest, instr(rest, '/')) else '' end as path from a),
c as (select *, ({hits(STRICT)})::int as n_strict, ({hits(SOFT)})::int as n_soft from b)
select page_id, host, path, case {rule} else null end as rule,
  case {verdict} when n_strict > 0 or n_soft >= {MIN_SOFT} then 'block' else 'allow' end as verdict, n_strict, n_soft from c"""
