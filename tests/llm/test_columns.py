"""All ten operators and all five stages on tables with odd extra columns, nulls and a very long text."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldview.llm import extract, imatch, jaccard, packing, pieces, quality, secrets, substring, toxicity, url_filter
from llm_helpers import text_of

#: names that operators might use for themselves, names with dots, spaces and quotes
EXTRA = ["_key", "_d", "_marks", "_k", "_rank", "_h", "_0", "_1", "d", "h", "marks", "rank", "gone", "_text", "_words", "known", "_row", "part", "guest", "salt", "component_id", "n_words", "kept", "score", "a.b", "a b", "a`b"]
OPERATORS = {
    "op1": jaccard.linked, "op2": substring.removed, "op6": secrets.scan, "op7": quality.judge, "op10": imatch.fingerprints,
    "op3": lambda df: toxicity.classify(df, df.select("*", F.lit(1).alias("quality"), (F.col("doc_id") % 2).alias("toxic"))),
    "op8": lambda df: packing.pack(df, packing.default_tokenizer()),
    "op9": lambda df: pieces.encode_rows(df, __import__("public_tokenizers").path("piece_bpe_32k.model")),
    "op4": lambda df: url_filter.filter_urls(as_pages(df)), "op5": lambda df: extract.extract(as_pages(df)),
}


def as_pages(df):
    out = df.withColumnsRenamed({"doc_id": "page_id", "text": "html"})
    return out.withColumn("url", F.concat(F.lit("https://h.org/"), "page_id"))


@pytest.fixture(scope="module")
def rows(corpus):
    rnd = random.Random(4)
    long = text_of(rnd, 40_000)
    return [*corpus[:30], *corpus[-14:], (800, long, "en", "s0", 1), (801, long + " end", "en", "s0", 1), (802, "x" * 300_000, "en", "s1", 1), (None, "none", None, None, None)]


def with_extra(df, names):
    return df.select(*df.columns, *[F.lit(f"own {i}").alias(n) for i, n in enumerate(names) if n not in df.columns])


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_ignore_other_columns(frame, rows, name):
    run, df = OPERATORS[name], frame(rows)
    # columns that differ from a needed one in case alone are others too
    others = ["TEXT", "Doc_Id", "Html", "URL"] if name != "op3" else []
    wide = with_extra(df, [n for n in EXTRA if name not in ("op4", "op5") or n != "url"])
    if name in ("op4", "op5"):
        got = run(with_extra(df, EXTRA))
    else:
        got = run(wide.toDF(*wide.columns).select("*", *[F.lit("x").alias(n) for n in others]))
    assert plain(got) == plain(run(df))


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_other_columns(frame, spark, rows, stage):
    name, run = corpus_pipeline.STAGES[stage]
    df = frame(rows)
    wide = with_extra(df, EXTRA)
    want, got = run(spark, df, "unused"), run(spark, wide, "unused")
    if name == "best_fit_packing":
        pieces_of = lambda x: plain(x.select("doc_id", "piece", "start", "length", "ids_crc32"))
        assert pieces_of(got) == pieces_of(want)
        return
    assert got.columns == wide.columns
    own = [f"`{c.replace('`', '``')}`" for c in df.columns]
    assert plain(got.select(*own)) == plain(want) and want.count() > 20
    extra = {tuple(r[len(df.columns) :]) for r in got.collect()}
    assert extra == {tuple(f"own {i}" for i in range(len(EXTRA)))}


@pytest.mark.parametrize("stage", range(4))
def test_stages_without_the_other_columns_of_documents(frame, spark, rows, stage):
    name, run = corpus_pipeline.STAGES[stage]
    if name == "quality_rules":
        pytest.skip("its groups are of lang and source")
    df = frame(rows).select("text", "doc_id")
    out = run(spark, df, "unused")
    assert out.columns == ["text", "doc_id"] and out.count() > 20
