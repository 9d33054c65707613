import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from foldview.llm import quality


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {p for i, g in enumerate(grams) if count[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(frame, odd_rows):
    odd = [*odd_rows, (900, "a b c\na b c\n\n \na b c d\n#x $y", "en", "s0", 1), (901, "x x x x", "en", "s0", 1), (902, "é|\U0001d54f<> \n" * 70, "en", "s1", 1)]
    got = quality.judge(frame(odd)).collect()
    want = sorted(((d, *measures(t)) for d, t, *_ in odd), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=repr) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_bucket_error_is_bounded(spark):
    df = spark.range(0, 200_000, 7).select("id", quality.bucket(F.col("id")).alias("b"))
    assert df.where((F.col("b") > F.col("id")) | ((F.col("id") - F.col("b")) * 64 > F.col("id"))).count() == 0


def test_adaptive_fences(frame):
    clean = [(i, " ".join(f"word{(i * 31 + k * 7) % 997}{k}" for k in range(80)), "en", f"s{i % 3}", 1) for i in range(150)]
    junk = [(1000 + i, " ".join(f"word{k}$$$&&&" for k in range(80)), "en", "s0", 1) for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(frame([*clean, *junk])).collect()}
    assert all(got[d] for d, *_ in clean) and not any(got[d] for d, *_ in junk)
    # where symbols are usual, they are no fault
    usual = [(i, " ".join(f"w{(i * 31 + k * 7) % 997}{k}$$&" for k in range(80)), "xx", "s9", 1) for i in range(150)]
    assert all(r["kept"] for r in quality.judge(frame(usual)).collect())


def test_sql_says_the_same(frame, corpus):
    df = frame(corpus)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = con.execute(quality.oracle_sql())
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[n] for n in names) for r in quality.judge(df).collect()) == sorted(want.fetchall())


def test_native_and_empty(frame, corpus):
    plan = quality.judge(frame(corpus))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert quality.judge(frame([])).count() == 0
    df = frame(corpus).withColumn("n_words", F.lit(1)).withColumn("_l", F.lit(1)).withColumn("measure", F.lit(1))
    assert quality.keep_good(df).columns == df.columns


def test_keep_good_keeps_rows(frame, odd_rows):
    verdict = Counter((r["doc_id"], r["n_words"]) for r in quality.judge(frame(odd_rows)).collect() if r["kept"])
    kept = Counter((r["doc_id"], measures(r["text"])[0]) for r in quality.keep_good(frame(odd_rows)).collect())
    assert kept == verdict


@pytest.mark.parametrize("text, repeat", [("a b c a b c", 6), ("a a a", 0), ("a a a a", 4), ("a b c x a b c y b c x", 11 - 1), ("", 0), ("a b", 0)])
def test_repeat_words(frame, text, repeat):
    assert measures(text)[4] == quality.judge(frame([(1, text, "en", "s", 1)])).first()["n_repeat_words"]
    if text != "a b c x a b c y b c x":
        assert measures(text)[4] == repeat
