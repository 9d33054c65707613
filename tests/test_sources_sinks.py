import json

from view_helpers import rows
from pyspark.sql import functions as F

from foldview.functions.reducers import Sum
from foldview.plans.engine import Engine
from foldview.sinks import publishers
from foldview.sources import replay, schemes


def messages(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_schemes(spark):
    assert rows(schemes.JsonScheme("id long, name string").apply(messages(spark, '{"id": 1}', '{"id": 2, "name": "x", "more": 1}', "{bad"))) == [(1, None), (2, "x")]
    assert rows(schemes.TupleScheme("id long, name string").apply(messages(spark, '[1, "x"]', "[2]", "no"))) == [(1, "x"), (2, None)]
    assert rows(schemes.KeyedScheme(schemes.JsonScheme("id long, a string"), ("id",)).apply(messages(spark, '{"a": "x"}', '{"id": 1}'))) == [(1, None)]
    paths = schemes.PathScheme("id", (("id", "id_str"), ("user", "user.name")))
    assert rows(paths.apply(messages(spark, '{"id_str": "1", "user": {"name": "n"}}', '{"delete": {"status": {"id_str": "2"}}}', "{}", "bad"))) == [("1", "n"), ("2", None)]
    meta = schemes.MetaScheme(schemes.StringScheme()).apply(messages(spark, "x").withColumn("topic", F.lit("t")).withColumn("offset", F.lit(5)))
    assert rows(meta) == [("t", 5, "x")]
    assert schemes.KafkaOptions("h:1", "t", "latest", 10, False).options()["maxOffsetsPerTrigger"] == "10"


def test_records_as_messages(spark):
    out = schemes.json_records(spark.createDataFrame([(1, None)], "id long, a string"), ["id"]).first()
    assert json.loads(out["key"]) == ["1"] and json.loads(out["value"]) == {"id": 1, "a": None}


def archive_rows(spark, n, size=None):
    return spark.createDataFrame([("t", "h", 1, 0, i, i + 1, (f"Message {i}" if size is None else f"message{i}").encode()) for i in range(n)], "topic string, hostname string, port int, partition int, offset long, nextOffset long, bytes binary")


def test_archive(spark, tmp_path):
    a = replay.Archive(spark, str(tmp_path / "archive"))
    a.write(archive_rows(spark, 100))
    a.write(archive_rows(spark, 5))  # sent again
    assert a.read().count() == 100
    assert a.fetch("t", "h", 1, 0, 0, 10_000).count() == 100
    ten, at, got = archive_rows(spark, 10, 1), 0, []
    while part := replay.fetched(ten, at, 30).orderBy("offset").collect():
        assert sum(len(r["bytes"]) for r in part) <= 30
        got += [bytes(r["bytes"]).decode() for r in part]
        at = part[-1]["nextOffset"]
    assert got == [f"message{i}" for i in range(10)]
    assert replay.fetched(ten.where("offset <> 4"), 2, 1000).count() == 2  # not across a gap


def test_replay(spark):
    m = archive_rows(spark, 10)
    joined = replay.replay(m.where("offset < 7"), m.where("offset >= 5"))
    assert sorted(r["offset"] for r in joined.collect()) == list(range(10))
    assert rows(replay.replay(m, m.where("offset > 3"), force_archive=True)) == rows(m)
    assert rows(replay.replay(m, m.limit(0))) == rows(m)


def test_parquet_publisher(spark, tmp_path):
    table = publishers.ParquetTable(spark, str(tmp_path / "pub"))
    schema = "k string, x long, _changed boolean, _op string"
    table.write("v", ["k"], spark.createDataFrame([("a", 1, True, "U"), ("b", 2, True, "U")], schema), 0)
    second = spark.createDataFrame([("a", None, True, "D"), ("c", 3, True, "U")], schema)
    table.write("v", ["k"], second, 1)
    table.write("v", ["k"], second, 1)  # a batch that comes again
    assert rows(table.read("v")) == [("b", 2), ("c", 3)]
    e = Engine(spark).source("t(id)", spark.createDataFrame([(1, "a", 5)], "id long, k string, x long"))
    e.map("{ k x }", "t(id)").red("{ x }", "sums(k)", Sum())
    e.publish("sums", table)
    assert rows(table.read("sums")) == [("a", 5)]


def test_parquet_buckets(spark, tmp_path):
    """A small batch rewrites its own buckets alone; old versions go; a new run goes on above the old one."""
    table = publishers.ParquetTable(spark, str(tmp_path / "pub"), number=8)
    schema = "k long, x long, _changed boolean, _op string"
    frame = lambda *r: spark.createDataFrame([(k, x, True, "D" if x is None else "U") for k, x in r], schema)
    table.write("v", ["k"], frame(*[(i, i) for i in range(100)]), 0)
    table.write("v", ["k"], frame((7, 70), (100, 1)), 1)
    assert len(table._buckets("v").touched()[1]) <= 2 and len(table._buckets("v").touched()[0]) == 8
    assert rows(table.read("v")) == sorted([*((i, i) for i in range(100) if i != 7), (7, 70), (100, 1)], key=repr)
    for n in range(2, 6):
        table.write("v", ["k"], frame((7, n)), n)
    table.write("v", ["k"], frame((7, 5)), 5)  # a batch that comes again
    assert dict(rows(table.read("v")))[7] == 5 and table.read("v").count() == 101
    own = table._buckets("v").bucket(["k"])
    b = frame((7, 0)).select(own).first()[0]
    assert not list((tmp_path / "pub" / "v" / "v=2").glob(f"_b={b}/*.parquet"))
    again = publishers.ParquetTable(spark, str(tmp_path / "pub"), number=8)
    again.begin("v", "another checkpoint")
    again.write("v", ["k"], frame(*[(i, None) for i in range(101)]), 0)
    assert rows(again.read("v")) == [] and again.read("v").columns == ["k", "x"]
    again.begin("v", "another checkpoint")
    assert again.base["v"] == 6
    table.write("all", [], frame((1, 2)), 0)
    table.write("all", [], frame((3, 4)), 1)
    assert rows(table.read("all")) == [(3, 4)]


def clients(path):
    """Makes key/value clients that write what they are told into a folder; nested, so that workers need no test module."""

    def client():
        import json
        import uuid
        from types import SimpleNamespace

        def log(*x):
            with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
                json.dump(list(x), f)

        return SimpleNamespace(put=lambda *x: log("put", *x), delete=lambda *x: log("delete", *x), log=log)

    return client


def read(path):
    return sorted((json.loads(p.read_text()) for p in path.iterdir()), key=repr)


def test_cell_and_document_publishers(spark, tmp_path):
    client = clients(str(tmp_path))
    batch = spark.createDataFrame([("a", 1, "x", None), ("b", 2, None, None)], "k string, j long, v string, w long")
    publishers.KeyValue(client).write("t", ["k", "j"], batch, 0)
    assert read(tmp_path) == [["delete", "t", "b/2"], ["put", "t", "a/1", {"v": '"x"', "w": "null"}]]
    for p in tmp_path.iterdir():
        p.unlink()
    publishers.HttpDocuments(lambda *x: client().log(*x)).write("t", ["k", "j"], batch, 0)
    assert [(r[0], json.loads(r[1])) for r in read(tmp_path)] == [("delete", ["t", "b", "2"]), ("replace", ["t", "a", "1"])]


def test_dashboards_and_print(spark):
    assert [json.loads(r[0]) for r in publishers.counter(spark.createDataFrame([(3,), (None,)], "n long"), "n").collect()] == [{"value": 3}, {"value": 0}]
    top = spark.createDataFrame([([("Joe", 5)],)], "top array<struct<name: string, n: long>>")
    assert json.loads(publishers.leaderboard(top, "top", "name", "n").first()[0]) == [{"name": "Joe", "values": [5]}]
    said = []
    publishers.Print("p", out=said.append).write("t", ["k"], spark.createDataFrame([("a", 1)], "k string, x long"), 0)
    assert said == ["p t: {'k': 'a', 'x': 1}"]


def test_last_of_each(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "k string, x long, s long")
    assert rows(publishers.last_of_each(df, ["k"], "s")) == [("a", 2, 2), ("b", 3, 1)]
    assert rows(publishers.last_of_each(df, [], "s").select("x")) in ([(2,)],)


def test_replayed_source(spark, tmp_path):
    from foldview.sources.schemes import JsonScheme, KafkaOptions

    options = replay.ReplayOptions(KafkaOptions("broker:9092", "t"), str(tmp_path / "a"), JsonScheme("id long"))
    topic = spark.createDataFrame([("t", 0, i, json.dumps({"id": i}).encode()) for i in range(10)], "topic string, partition int, offset long, value binary")
    replay.Archive(spark, str(tmp_path / "a")).write(options.messages(topic.where("offset < 6")))
    assert rows(options.read(spark, topic.where("offset >= 4"))) == [(i,) for i in range(10)]


def test_where_a_reader_begins():
    o = schemes.KafkaOptions("h:1", "t", hosts=schemes.StaticHosts(("a", "b"), 2))
    assert json.loads(o.resumed({1: 7}).starting) == {"t": {"0": -1, "1": 7, "2": -1, "3": -1}}
    assert o.resumed({1: 7}, force=True).starting == "earliest"
    assert schemes.KafkaOptions("h:1", "t").resumed({}).starting == "latest"


def test_kafka_topic(spark):
    rows_ = spark.createDataFrame([("pear", 3, True, "U"), ("fig", None, True, "D")], "word string, n long, _changed boolean, _op string")
    sent = []
    publishers.KafkaTopic("", "words", "concat(word, ' ', n)", save=lambda df: sent.extend(df.collect())).write("v", ["word"], rows_, 0)
    assert sorted(map(tuple, sent), key=str) == [("words", '["fig"]', None), ("words", '["pear"]', "pear 3")]
    whole = publishers.KafkaTopic("", "words").messages(["word"], rows_)
    assert sorted(r["value"] for r in whole.collect()) == ['{"word":"fig","n":null}', '{"word":"pear","n":3}']


def test_http_documents_are_sent_again(spark, tmp_path):
    place = str(tmp_path)

    def post(kind, id_, body):
        import os

        n = len(os.listdir(place))
        open(f"{place}/{n}", "w").close()
        if n < 2:
            raise OSError("not now")

    one = spark.createDataFrame([("a", 1)], "k string, x long").coalesce(1)
    publishers.HttpDocuments(post, tries=3, pause=0.01).write("t", ["k"], one, 0)
    assert len(list(tmp_path.iterdir())) == 3
