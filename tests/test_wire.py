import json

import pytest
from view_helpers import rows

from foldview.operators import docstore
from foldview.sources import wire


def messages(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) or v is None else json.dumps(v),) for v in values], "value string")


UPDATE = {"table": "trees", "key": ["1", "x"], "value": {"name": "ash \"tall\"", "age": 40, "cut": None, "tags": [1, "a"], "leaves": {"l1": {"size": 2.5}, "l2": {}}}, "ts": 7, "uuid": "u"}
CELLS = [("age", "40"), ("cut", "null"), ("leaves/l1/size", "2.5"), ("name", '"ash \\"tall\\""'), ("tags", '[1,"a"]')]


def test_updates_in_long_form(spark):
    got = wire.updates(messages(spark, UPDATE))
    assert sorted(("/".join(r["path"]), r["value"]) for r in got.collect()) == CELLS
    assert got.columns == [c.split()[0] for c in docstore.LONG.split(", ")]
    assert {(r["table"], tuple(r["key"]), r["ts"], r["uuid"]) for r in got.collect()} == {("trees", ("1", "x"), 7, "u")}


def test_broken_messages_are_dropped(spark):
    bad = [None, "", "{no", "[]", {**UPDATE, "table": None}, {**UPDATE, "ts": None}, {k: v for k, v in UPDATE.items() if k != "key"}, {**UPDATE, "value": 5}, {**UPDATE, "value": {}}]
    assert wire.updates(messages(spark, *bad)).count() == 0
    assert wire.updates(messages(spark, {k: v for k, v in UPDATE.items() if k != "uuid"})).first()["uuid"] == ""


def test_there_and_back(spark):
    long = wire.updates(messages(spark, UPDATE))
    sent = wire.update_messages(long)
    assert sent.count() == 1
    assert json.loads(sent.first()["key"]) == ["trees", "1", "x"]
    assert rows(wire.updates(sent)) == rows(long)


def test_changes(spark):
    long = wire.updates(messages(spark, UPDATE))
    one = long.where("path[0] = 'age'")
    sent = wire.change_messages(one, long)
    body = json.loads(sent.first()["value"])
    assert body["update"] == {"age": 40} and body["snapshot"]["leaves"] == {"l1": {"size": 2.5}} and body["ts"] == 7
    got = wire.changes(sent).first()
    assert [tuple(c["path"]) for c in got["update"]] == [("age",)] and len(got["snapshot"]) == len(CELLS) and got["timestamp"] == 7


def test_too_deep_and_contradicting(spark):
    deep = {"x": 1}
    for _ in range(wire.DEPTH):
        deep = {"x": deep}
    with pytest.raises(Exception, match="names on the way"):
        wire.updates(messages(spark, {**UPDATE, "value": deep})).collect()
    with pytest.raises(ValueError):
        wire.nested([{"path": ["a"], "value": "1"}, {"path": ["a", "b"], "value": "2"}])
