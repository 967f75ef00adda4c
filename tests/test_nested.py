import json

import pytest

from kenmark.operators.nested import ENVELOPE, Shape, camel_case, deep_json, flatten, payload_children, records, strict_json, tables_of


def test_names_and_json_in_text():
    assert strict_json('{"a_b": "{\\"c_d\\": [1]}", "d": "[x", "aB": 2, "l": [" [2]", ["{}"]]}') == {"aB": {"cD": [1]}, "d": "[x", "l": [[2], [{}]]}
    assert strict_json('{"a_b": null, "aB": 2}') == {"aB": 2} and camel_case("_a__b_") == "_aB_"
    for broken in ("", "{", '{"a":1} x', "NaN", "[1,]", '{"a" 1}', '{1: 2}', "[1}", "]"):
        for read in (strict_json, deep_json):
            with pytest.raises(ValueError):
                read(broken)


def test_reading_without_recursion_is_the_same():
    for tree in ({}, [], [[]], {"a": [1, -2.5e3, True, None, 'x"\\y\n', {"b": {}}, []], "c": "é"}, "text", 7):
        for text in (json.dumps(tree), json.dumps(tree, indent=2)):
            assert deep_json(text) == json.loads(text) == strict_json(text)


def test_shapes_merge():
    one, many = Shape().observe({"a": {"b": 1}}), Shape().observe({"a": [{"c": 2}], "d": "x", "n": None})
    both = Shape.load(Shape().merge(one).merge(many).dump())
    table, child = tables_of(both)
    assert table.columns == ["d"] and child.path == "a" and child.listed and child.columns == ["b", "c"]
    keyed = [Shape().observe({f"k{i}": {"x": i} for i in range(j, j + 3)}, 4) for j in range(0, 9, 3)]
    whole = Shape()
    for x in keyed:
        whole.merge(x, 4)
    assert [t.path for t in tables_of(whole)] == ["", "*"] and not whole.members


def test_tables_keep_links_places_and_clashing_names(spark):
    bodies = [
        json.dumps([{"id": "own", "list": [{"x": 1, "inner": [{"y": 2}, None, {"y": 3}]}, {"x": None}]}, 7, {"id": "second"}]),
        None,
        "",
        "{broken",
        "[]",
        json.dumps({"data": {"records": [{"id": "wrapped"}]}}),
        json.dumps({"id": "x" * 200_000}),
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "k long, body string")
    tables = flatten(df, "k", "body", ENVELOPE)
    assert set(tables) == {"", "list", "list.inner"}
    roots = {(r.k, r.rec): r.id_ for r in tables[""].collect()}
    assert roots[0, 0] == "own" and roots[0, 2] == "second" and roots[5, 0] == "wrapped" and len(roots[6, 0]) == 200_000
    parents = {r.id: r for r in tables["list"].collect()}
    inner = sorted((parents[r.parent_id].pos, r.pos, r.y) for r in tables["list.inner"].collect())
    assert inner == [(0, 0, "2"), (0, 2, "3")] and sorted(r.pos for r in parents.values()) == [0, 1]
    top = {r.id: r.id_ for r in tables[""].collect()}
    assert {top[r.parent_id] for r in parents.values()} == {"own"}


def test_lists_of_lists_scalars_and_rows_of_one_key(spark):
    body = json.dumps({"grid": [[{"v": 1}, {"v": 2}], [], [{"v": 3}]], "tags": ["a", None, "b"], "mixed": [1, {"v": 2}]})
    tables = flatten(spark.createDataFrame([(1, body), (1, body)], "k long, body string"), "k", "body")
    assert set(tables) == {"", "grid", "grid[]", "tags", "mixed"}
    assert tables[""].select("id").distinct().count() == 2
    rows = {r.id: r.pos for r in tables["grid"].collect()}
    assert sorted(rows.values()) == [0, 0, 1, 1, 2, 2]
    assert sorted((rows[r.parent_id], r.pos, r.v) for r in tables["grid[]"].collect()) == sorted([(0, 0, "1"), (0, 1, "2"), (2, 0, "3")] * 2)
    assert sorted((r.pos, r.value) for r in tables["tags"].collect()) == [(0, "a"), (0, "a"), (2, "b"), (2, "b")]
    assert sorted((r.pos, r.value, r.v) for r in tables["mixed"].distinct().collect())[::2] == [(0, "1", None), (1, None, "2")]


def test_any_depth_and_objects_keyed_by_id(spark):
    deep, n = {"x": "end"}, 60
    for _ in range(n):
        deep = {"a": [deep]}
    tables = flatten(spark.createDataFrame([(1, json.dumps(deep))], "k long, body string"), "k", "body")
    bottom = ".".join(["a"] * n)
    assert len(tables) == n + 1 and tables[bottom].first().x == "end"
    far = "[" * 30_000 + "]" * 30_000
    assert records('{"a": ' + far + ', "b": 1}', ())[0][1]["b"] == 1
    keyed = json.dumps({"by": {f"id{i}": {"v": i, "name": "own"} for i in range(20)} | {"plain": 5}})
    tables = flatten(spark.createDataFrame([(1, keyed)], "k long, body string"), "k", "body", most_members=10)
    rows = {r.name: (r.name_, r.v, r.value) for r in tables["by.*"].collect()}
    assert set(tables) == {"", "by", "by.*"} and rows["id7"] == ("own", "7", None) and rows["plain"] == (None, None, "5") and len(rows) == 21


def test_children_of_empty_and_broken_payloads(spark):
    schema = "payload_id long, body string"
    assert payload_children(spark.createDataFrame([], schema)).count() == 0
    assert payload_children(spark.createDataFrame([(1, None), (2, "{"), (3, "3")], schema)).count() == 0
    body = json.dumps({"screen": {"width": None, "orientation": {}}, "high_entropy_values": json.dumps({"model": "", "brands": {"brand": "B"}})})
    got = {(r.child, r.pos, r["item"]) for r in payload_children(spark.createDataFrame([(1, body)], schema)).collect()}
    assert got == {("highEntropyValues", 0, ""), ("brands", 0, "B")}
