import pytest

from foldview.plans.schema import parse, parse_signature


@pytest.mark.parametrize(
    "text, name, ids, values",
    [
        ("users(id) { name age }", "users", ("id",), ("name", "age")),
        ("allOrgs()", "allOrgs", (), ()),
        ("deposits(id) ", "deposits", ("id",), ()),
        ("sortedNames (count name) { name count,,}", "sortedNames", ("count", "name"), ("name", "count")),
        ("a(b,c) { d } e(f)", "a", ("b", "c"), ("d",)),
    ],
)
def test_accepts(text, name, ids, values):
    s = parse(text)
    assert (s.name, s.ids, s.values) == (name, ids, values)
    assert parse(str(s)) == s


def test_signature():
    assert parse_signature("{ orgId, id, name }").values == ("orgId", "id", "name")
    assert parse_signature("(id) { a }").ids == ("id",)


@pytest.mark.parametrize("text", ["{}", "(users)", "users[id]", "users(id", "", "users(1)", "a(b) {}"])
def test_rejects(text):
    with pytest.raises(ValueError):
        parse(text) if text != "{}" else parse_signature(text)
