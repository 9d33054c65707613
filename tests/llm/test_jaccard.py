import random
import re

import pytest
from pyspark.sql import functions as F

from foldview.llm import jaccard
from foldview.llm.components import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def brute_pairs(rows, percent=80):
    """Pairs (i, j) of rows that link."""
    sets = [(d, shingles(t)) for d, t, *_ in rows]
    return sets, [(i, j) for i, (a, x) in enumerate(sets) for j, (b, y) in enumerate(sets[:i]) if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]


def brute(rows, percent=80):
    """doc_id, size, component and the number of other sets that link with the row's own."""
    sets, pairs = brute_pairs(rows, percent)
    up, near = {d: d for d, _ in sets if d is not None}, {}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, j in pairs:
        (a, x), (b, y) = sets[i], sets[j]
        a_, b_ = sorted((root(a), root(b)))
        up[b_] = a_
        if x != y:
            near.setdefault(frozenset(x), set()).add(frozenset(y))
            near.setdefault(frozenset(y), set()).add(frozenset(x))
    return sorted(((d, len(s), None if d is None else root(d), 0 if d is None else len(near.get(frozenset(s), ()))) for d, s in sets), key=repr)


@pytest.mark.parametrize("options", [{}, {"bucket": 4}, {"small": 2, "block": 7}, {"orders": 1}, {"percent": 60}])
def test_against_brute_force(frame, odd_rows, options):
    got = jaccard.linked(frame(odd_rows), **options)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(odd_rows, options.get("percent", 80))


def test_links_between_representatives(frame, corpus):
    found, members = (x.collect() for x in jaccard.links(frame(corpus)))
    rep = {r["doc_id"]: r["rep"] for r in members}
    sets, pairs = brute_pairs(corpus)
    want = {tuple(sorted((rep[sets[i][0]], rep[sets[j][0]]))) for i, j in pairs if sets[i][1] != sets[j][1]}
    assert sorted(tuple(r) for r in found) == sorted(want) and len(want) > 5
    by_set = {}
    for d, s in sets:
        if s:
            by_set.setdefault(frozenset(s), []).append(d)
    assert rep == {d: min(ds) for ds in by_set.values() for d in ds}


def test_templates_that_share_a_phrase(frame):
    """Documents of few passages, unlike but for what they share: hot tokens whose members are of many components."""
    rnd = random.Random(3)
    passages = [[f"p{k}w{i}" for i in range(30)] for k in range(14)]
    data = [(i, " ".join(w for k in sorted(rnd.sample(range(14), 4)) for w in passages[k]), "en", "s", 1) for i in range(250)]
    for options in ({"small": 3, "block": 40}, {"small": 3}):
        got = jaccard.linked(frame(data), **options)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(data)


def test_empty_table_and_clashing_columns(frame, corpus):
    assert jaccard.linked(frame([])).count() == 0
    df = frame(corpus[:5]).withColumn("rep", F.lit(1)).withColumn("token", F.lit(2)).withColumn("h", F.lit(3)).withColumn("n", F.lit(3))
    assert jaccard.linked(df).count() == 5 and jaccard.one_of_each(df).columns == df.columns


def test_one_of_each(frame, odd_rows):
    want = sorted({d for d, _, c, _ in brute(odd_rows) if d is not None and d == c})
    got = [r["doc_id"] for r in jaccard.one_of_each(frame(odd_rows)).collect()]
    assert sorted(d for d in got if d is not None) == want and got.count(None) == 2


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 9)] + [(20, x) for x in range(21, 40)] + [(50, 51), (51, 50), (60, 60)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(10)}, **{i: 20 for i in range(20, 40)}, 50: 50, 51: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_an_unmixed_group_costs_its_size(frame):
    """Near copies of one text: a star gives the component."""
    rnd = random.Random(1)
    words = [f"v{i}" for i in range(150)]

    def near():
        w = list(words)
        w[rnd.randrange(150)] = f"x{rnd.randrange(10**9)}"
        return " ".join(w)

    data = [(0, " ".join(words), "en", "s", 1)] + [(i, near(), "en", "s", 1) for i in range(1, 120)]
    assert {r["component_id"] for r in jaccard.linked(frame(data)).collect()} == {0}


def test_sql_says_the_same(frame, corpus):
    import duckdb

    con = duckdb.connect()
    df = frame(corpus)
    con.register("documents", df.toArrow())
    want = con.execute(jaccard.oracle_sql())
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[n] for n in names) for r in jaccard.linked(df).collect()) == sorted(want.fetchall())
