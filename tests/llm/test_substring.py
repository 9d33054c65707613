import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from foldview.llm import substring


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    first = {}
    for d, t, *_ in rows:
        w = words_of(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t, *_ in rows:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, gram, most", [(50, 8, 1000), (50, 8, 1), (7, 3, 1000), (7, 3, 3), (5, 5, 1)])
def test_against_brute_force(frame, odd_rows, window, gram, most):
    got = substring.removed(frame(odd_rows), window, gram, most)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(odd_rows, window)


def test_windows_inside_one_document_do_not_count(frame):
    assert brute([(1, "a b " * 60)], 50) == sorted(tuple(r) for r in substring.removed(frame([(1, "a b " * 60, "en", "s", 1)])).collect())


@pytest.mark.parametrize("most", [1000, 30, 1])
def test_a_passage_that_very_many_share(frame, most):
    """Its windows inside are alike in all documents, those at its edges are not."""
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(70)]
    some = lambda n: [f"x{rnd.randrange(10**6)}" for _ in range(n)]
    rows = [(i, " ".join(some(rnd.randint(0, 90)) + passage[: rnd.choice([70, 70, 55])] + some(rnd.randint(0, 90))), "en", "s", 1) for i in range(300)]
    rows.append((5, " ".join(passage * 3), "en", "s", 1))
    got = substring.removed(frame(rows, 7), most=most)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 50)


def test_blocks_of_one_bucket(frame, spark):
    """A bucket of a split minimiser that is worked off in several blocks marks the same windows."""
    rows = [(i, " ".join([f"x{i}", *(f"p{k}" for k in range(60)), f"y{i % 7}"]), "en", "s", 1) for i in range(40)]
    keyed = substring._keyed(frame(rows))
    seen = substring._sequences(keyed, 50, 8)
    salted = seen.select("doc_id", "h", "ms", F.transform("ms", lambda _: F.lit(3)).alias("salts"))
    sent = substring._super_kmers(keyed.join(salted, ["doc_id", "h"]), 50, 8).where("packed is not null").persist()
    marked = []
    for block in (4 << 20, 500):
        found = substring._buckets(sent, 50, block)
        least = found.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
        own = [(r["doc_id"], r["start"] + k) for r in found.where("k1 is null").collect() for k in range(r["n"])]
        marked.append(sorted(own + [tuple(r) for r in found.join(least, ["k1", "k2"]).where("least < doc_id").select("doc_id", "start").collect()]))
    assert marked[0] == marked[1] and len(set(marked[0])) == len(marked[0]) > 39
    sent.unpersist()


def test_windows_of_one_document_alone_stay_behind(frame, monkeypatch):
    """Of near copies that each differ by a word, most windows with that word do not go to the second round."""
    rnd = random.Random(9)
    rows = []
    for i in range(600):
        text = [f"p{k}" for k in range(150)]
        text[rnd.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(text), "en", "s", 1))
    kept = {}
    settled = substring.settled
    monkeypatch.setattr(substring, "settled", lambda spark, df, name: kept.setdefault(name, settled(spark, df, name)))
    got = substring.removed(frame(rows, 4), most=32)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 50)
    alone = sum(1 for _, t, *_ in rows for i in range(101) if any(w[0] == "x" for w in t.split()[i : i + 50]))
    assert kept["marked"].where("k1 is not null").count() < 0.6 * alone


def test_empty_table_and_clashing_columns(frame, corpus):
    assert substring.removed(frame([])).count() == 0
    df = frame(corpus).withColumn("h", F.lit(1)).withColumn("marks", F.lit("x")).withColumn("_key2", F.lit(1))
    out = substring.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(corpus)


def test_kept_text(frame, odd_rows):
    want = {(d, h) for d, _, _, h in brute(odd_rows, 50)}
    out = substring.without_repeats(frame(odd_rows)).collect()
    assert {(r["doc_id"], hashlib.sha256(" ".join(words_of(r["text"])).encode()).hexdigest()) for r in out} == want
    untouched = {t for _, t, *_ in odd_rows}
    n_same = sum(r["text"] in untouched for r in out)
    assert n_same > 40 and all(r["n_chars"] == len(r["text"] or "") for r in out)
