"""Shared inlining against a recursive walk of the same records."""

import json

from pyspark.sql import Row

from tidewater.operators import nested as N

ARRAYS, TEXT = ("turns", "spans", "rounds"), ("label", "metadata")


def brute(raw):
    try:
        o = json.loads(raw)
    except (TypeError, ValueError):
        return set()
    out = set()

    def walk(v, path, name=""):
        if name in TEXT and isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                pass
        if name in ARRAYS and isinstance(v, dict):
            v = [v]
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}.{k}" if path else k, k)
        elif isinstance(v, list):
            for i, x in enumerate(v, 1):
                out.add(f"{path}.{i}")
                walk(x, f"{path}.{i}")

    if isinstance(o, dict):
        walk(o, "")
    return out


LINES = [
    '{"turns": [{"text": "a", "spans": [{"hits": [{"rule": 1}, null]}]}, null], "label": {"options": ["x", {"text": "y", "checks": [1, 2]}]}}',
    '{"turns": {"text": "a", "spans": {"hits": []}}, "label": "{\\"options\\": [\\"p\\", null]}", "metadata": "{\\"review\\": {\\"rounds\\": {\\"notes\\": [\\"n\\"]}}}"}',
    '{"turns": null, "label": "plain", "metadata": {}}', "[]", "null", "{broken", None, "", '{"a": [[1, [2]], []]}', '{"tree": {"v": 1, "tree": {"v": 2, "tree": null}}}',
]


def test_json_rows_match_a_recursive_walk(spark):
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(LINES)], "line_no long, raw string, path string")
    got = {}
    for r in N.json_rows(df, "line_no", "raw", ARRAYS, TEXT).filter("position IS NOT NULL").collect():
        got.setdefault(r.record_key, set()).add(r.path)
    assert got == {i: b for i, x in enumerate(LINES) if (b := brute(x))}


def test_json_tables_link_children_to_parents(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "line_no long, raw string")
    t = N.json_tables(df, "line_no", "raw", ARRAYS, TEXT)
    spans = t.table("turns_spans").collect()
    assert {(r.record_key, r.parent_path, r.path, r.position) for r in spans} == {(0, "turns.1", "turns.1.spans.1", 1), (1, "turns.1", "turns.1.spans.1", 1)}
    assert {r.f_rule for r in t.table("turns_spans_hits").collect()} == {"1", None}
    assert {r.path for r in t.rows.filter("record_key = 9").collect()} == {"", "tree", "tree.tree"}  # recursive objects share one table
    assert t.table("records").filter("record_key = 2").first().f_label == "plain"  # a scalar in an object's place


def scalars(v):
    if isinstance(v, dict):
        return sum((scalars(x) for x in v.values()), [])
    if isinstance(v, list):
        return sum((scalars(x) for x in v), [])
    return [] if v is None else [str(v)]


def test_no_scalar_is_lost_in_json(spark):
    records = [
        {"addr": {"x": "1"}, "b": {"addr": {"x": "2", "y": "3"}}, "list": [{"addr": {"x": "4"}}, {"addr": [{"x": "5"}]}, "6"]},
        {"node": {"v": "7", "node": {"v": "8", "kids": [{"node": {"v": "9"}}]}}, "a_b": "10", "a": {"b": "11"}, "a.b": "12"},
        {"list": [["13", ["14"]], [], {"value": "15"}], "addr": "16", "path": "17", "position": {"path": "18"}}, {},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "line_no long, raw string")
    t = N.json_tables(df, "line_no", "raw")
    got, paths = [], []
    for name in t.plans:
        for r in t.table(name).collect():
            paths.append((r.record_key, r.path))
            got += [v for k, v in r.asDict().items() if k.startswith("f_") and v is not None]
    assert sorted(got) == sorted(sum(map(scalars, records), []))
    assert len(paths) == len(set(paths)) == t.rows.count()
    assert {(r.record_key, r.path) for r in t.table("addr").collect()} >= {(0, "addr"), (0, "b.addr"), (0, "list.1.addr"), (0, "list.2.addr.1")}


def test_no_scalar_is_lost_in_typed_columns(spark):
    schema = "k long, addr struct<x:string>, b struct<addr:struct<x:string,y:string>,path:string>, list array<struct<addr:struct<x:string>,path:string,value:string>>, m map<string,struct<addr:struct<x:string>,n:string>>, a_b string, a struct<b:string>"
    rows = [(1, ("1",), (("2", "3"), "4"), [(("5",), "6", "7"), None, (None, None, None)], {"p": (("8",), "9"), "q": None}, "10", ("11",)), (2, None, None, None, None, None, None)]
    t = N.inline_typed(spark.createDataFrame(rows, schema), "k", ["addr", "b", "list", "m", "a_b", "a"])
    got = []
    for df in t.values():
        for r in df.collect():
            got += [str(v) for k, v in r.asDict().items() if k not in N.LINKS and v is not None]
    assert sorted(got) == sorted([str(i) for i in range(1, 12)] + ["p", "q"])
    assert sorted((r.record_key, r.parent_path, r.path) for r in t["addr"].collect()) == [(1, "", "addr"), (1, "", "b.addr"), (1, "list.1", "list.1.addr"), (1, "m.p", "m.p.addr")]
    assert "record_key" in t["records"].columns and {"a_b", "a_b_2"} <= set(t["records"].columns)


def test_typed_tables(spark):
    row = Row(line_no=1, path="clash", turns=[Row(speaker="g", text="a"), None], label=Row(ok=True, options=["x", None]), metadata={"s": "1", "n": None}, grid=[[1, 2], None])
    schema = "line_no long, path string, turns array<struct<speaker:string,text:string>>, label struct<ok:boolean,options:array<string>>, metadata map<string,string>, grid array<array<int>>"
    df = spark.createDataFrame([row, Row(2, None, None, None, None, None)], schema)
    t = N.inline_typed(df, "line_no", ["turns", "label", "metadata", "grid"])
    assert [(r.path, r.is_null, r.text) for r in t["turns"].collect()] == [("turns.1", False, "a"), ("turns.2", True, None)]
    assert [(r.path, r.value) for r in t["label_options"].collect()] == [("label.options.1", "x"), ("label.options.2", None)]
    assert {r.path for r in t["metadata"].collect()} == {"metadata.s", "metadata.n"}
    assert {r.path for r in t["grid_item"].collect()} == {"grid.1.1", "grid.1.2"}
    assert [(r.record_key, r.label_ok) for r in t["records"].collect()] == [(1, True), (2, None)]
    assert all(x.count() == 0 for x in N.inline_typed(df.limit(0), "line_no", ["turns", "label", "metadata"]).values())
