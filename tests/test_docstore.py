import itertools

from view_helpers import rows

from foldview.operators import docstore

BASE = [("name", '"Joe"', 1000), ("age", "27", 1000), ("home/city", '"San Francisco"', 1000), ("home/state", '"CA"', 1000)]


def frame(spark, updates):
    return spark.createDataFrame([("users", ["7"], p.split("/"), v, ts, "") for p, v, ts in updates], docstore.LONG)


def state(spark, updates):
    return {"/".join(r["path"]): r["value"] for r in docstore.merge(frame(spark, updates)).collect()}


def test_last_write_wins(spark):
    assert state(spark, [*BASE, ("name", '"Joey"', 999)])["name"] == '"Joe"'
    assert state(spark, [*BASE, ("name", '"Joey"', 1001)])["name"] == '"Joey"'
    ages = [*BASE, ("age", "32", 2000), ("age", "33", 2000), ("age", "32", 2000)]
    assert state(spark, ages)["age"] == "33"
    assert state(spark, [("age", "9", 1), ("age", "10", 1)])["age"] == "10"
    assert state(spark, [*BASE, ("color", '"green"', 999)])["color"] == '"green"'


def test_any_order_gives_one_document(spark):
    updates = [("a", "1", 1), ("a", "2", 1), ("a", "3", 2), ("b", "null", 5)]
    assert len({tuple(sorted(state(spark, [*p, p[0]]).items())) for p in itertools.permutations(updates)}) == 1


def test_no_op_makes_no_change(spark):
    updates = spark.createDataFrame([("t", ["1"], ["a"], v, ts, "", s) for s, (v, ts) in enumerate([("1", 5), ("1", 5), ("0", 5), ("2", 4), ("3", 6)])], docstore.LONG + ", seq long")
    assert [r["seq"] for r in docstore.change_log(updates).orderBy("seq").collect()] == [0, 4]
    snapshot = frame(spark, []).unionByName(spark.createDataFrame([("t", ["1"], ["a"], "9", 6, "")], docstore.LONG))
    assert docstore.change_log(updates, snapshot).count() == 0


def test_clusters_converge(spark):
    a, b = frame(spark, BASE), frame(spark, [("name", '"Joey"', 1001), ("age", "27", 1000)])
    assert rows(docstore.subscribe(a, b).drop("uuid")) == rows(docstore.subscribe(b, a).drop("uuid"))
    assert docstore.change_log(b, docstore.subscribe(a, b)).count() == 0


def test_documents_and_reads(spark):
    snapshot = docstore.merge(frame(spark, BASE))
    doc = docstore.documents(snapshot).first()
    assert doc["doc"]["home/city"] == '"San Francisco"' and set(doc["timestamps"].values()) == {1000}
    assert docstore.as_json(snapshot).first()["json"] == '{"age":27,"name":"Joe"}'
    assert docstore.get(snapshot, "users", ["7"]).count() == 4 and docstore.get(snapshot, "users", ["8"]).count() == 0


def test_flat(spark):
    df = spark.createDataFrame([(1, 10, 5, "x", None)], "id long, child long, ts long, a string, b long")
    assert rows(docstore.flat(df, "t", ["id"], "ts").select("path", "value")) == [(("a",), '"x"'), (("b",), "null"), (("child",), "10")]
    assert rows(docstore.flat(df, "t", ["id", "child"], "ts", prefix=("kids", "$child")).select("key", "path", "value")) == [(("1",), ("kids", "10", "a"), '"x"'), (("1",), ("kids", "10", "b"), "null")]


def test_cluster(spark, tmp_path):
    from foldview.operators.cluster import Cluster

    a, b = Cluster(spark, str(tmp_path / "a")), Cluster(spark, str(tmp_path / "b"))
    assert a.get("users", 7) is None and a.changes().count() == 0
    assert a.put("users", [7], {"name": "Joe", "age": 27, "addresses": {"home": {"city": "San Francisco", "state": "CA"}}}, 1000) == 4
    assert a.put("users", [7], {"name": "Joey"}, 999) == 0 and a.get("users", 7)["name"] == "Joe"
    assert a.put("users", [7], {"name": "Joey", "color": "green"}, 1001) == 2
    assert b.put("users", [7], {"age": 33}, 2000) == 1
    assert b.take_from(a) > 0 and a.take_from(b) > 0
    assert a.get("users", 7) == b.get("users", 7) == {"name": "Joey", "age": 33, "color": "green", "addresses/home/city": "San Francisco", "addresses/home/state": "CA"}
    # no-ops end the loop
    assert b.take_from(a) == 0 and a.take_from(b) == 0


def test_cluster_takes_a_stream(spark, tmp_path):
    from foldview.operators.cluster import Cluster

    frame(spark, BASE).write.parquet(str(tmp_path / "in"))
    c = Cluster(spark, str(tmp_path / "c"))
    c.stream(spark.readStream.schema(docstore.LONG).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert c.get("users", 7)["age"] == 27
