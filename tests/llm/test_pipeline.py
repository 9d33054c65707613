"""The pipeline against brute force, stage by stage and as a whole."""

import re

import duckdb
import pytest

import corpus_pipeline
from foldview.llm import common, packing, quality, secrets
from test_jaccard import brute as brute_links
from test_packing import TOKENIZER
from test_substring import words_of

KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


@pytest.fixture(scope="module")
def docs_rows(corpus):
    filler = " ".join(f"q{i}" for i in range(60))
    return [*corpus, (700, f'{filler} one token = "{KEY}" end', "en", "s0", 1), (701, " ".join(f"z{i}$$$&&&" for i in range(70)), "en", "s0", 1)]


def kept_by_rules(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", [list(r) for r in rows])
    found = con.execute(f"select doc_id from ({quality.oracle_sql()}) where kept").fetchall()
    return [r for r in rows if (r[0],) in found]


def without_windows(rows, window=50):
    first = {}
    for d, t, *_ in rows:
        w = words_of(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t, *rest in rows:
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        w = words_of(t)
        gone = {p for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for p in range(i, i + window)}
        text, last = "", None
        for i, (a, b) in enumerate(spans):
            if i in gone:
                continue
            text += (t[spans[i - 1][1] : a] if last == i - 1 and last is not None else " " if last is not None else "") + t[a:b]
            last = i
        out.append((d, text if gone else t, *rest))
    return out


def test_stages(frame, spark, docs_rows, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "substring_dedup", "secret_scan", "best_fit_packing"]
    want = list(docs_rows)
    df = frame(docs_rows)
    brute = {
        "quality_rules": kept_by_rules,
        "ngram_jaccard": lambda rows: [r for r in rows if r[0] in {d for d, _, c, _ in brute_links(rows) if d == c}],
        "substring_dedup": without_windows,
        "secret_scan": lambda rows: [(d, t.replace(KEY, secrets.MASK), *x) for d, t, *x in rows],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "unused")
        assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        want = brute[name](want)
        assert sorted((r["doc_id"], r["text"]) for r in df.collect()) == sorted((d, t) for d, t, *_ in want), name
    assert 0 < len(want) < len(docs_rows) and 701 not in {r[0] for r in want} and any(secrets.MASK in r[1] for r in want)
    tok = packing.ByteTokenizer(TOKENIZER)
    got = corpus_pipeline.STAGES[-1][1](spark, df, "unused").groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {d: len(tok.slow(t)) + 1 for d, t, *_ in want}


def test_run_is_the_stages(frame, spark, docs_rows, tmp_path):
    frame(docs_rows).write.parquet(str(tmp_path / "documents.parquet"))
    had = len(common._written)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    want = {d for d, _, c, _ in brute_links(kept_by_rules(docs_rows)) if d == c}
    assert {r["doc_id"] for r in out.collect()} == want
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common._written[had:]]
    assert sorted(left) == ["foldview-pieces", "foldview-pipeline-secret_scan"]


def test_empty_table(frame, spark):
    df = frame([])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, "unused").count() == 0, name
