import json

from conftest import as_set
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.functions import jsonstream as js
from factloom.operators import uploads
from factloom.operators.nested import CORRUPT, ROOT, Reader, Record, Shape, pick, shred

UNIT = {"name": "f", "parameters": [{"type": "int", "name": "a"}, None, {"type": None, "name": "b"}], "returns": {"type": "x", "name": ""}, "extras": json.dumps({"annotations": ["@A", None, "@B"], "fields": {"name": "n", "annotations": "@C"}})}


def messages(spark, payloads):
    return spark.createDataFrame([(i, p, "x", 1) for i, p in enumerate(payloads)], "delivery_id bigint, payload string, `table` string, at int")


def test_elements_of_a_message(spark):
    payload = json.dumps({"funcResult": {"units": [None, UNIT]}})
    got = as_set(uploads.elements(messages(spark, [payload])))
    assert got == {
        (0, 1, "unit", -1, -1), (0, 1, "parameter", 0, -1), (0, 1, "parameter", 2, -1), (0, 1, "return", 0, -1), (0, 1, "annotation", 0, -1), (0, 1, "annotation", 2, -1),
        (0, 1, "field", 0, -1), (0, 1, "field_annotation", 0, 0),
    }


def test_what_is_no_record_gives_no_element(spark):
    bad = [None, "", "{", "[]", "3", "null", '{"a":NaN}', '{"funcResult":{"units":null}}', '{"funcResult":null}', "[" * 100_000]
    assert uploads.elements(messages(spark, bad)).count() == 0
    assert shred(messages(spark, bad), ["delivery_id"], "payload").filter(f"`table` = '{CORRUPT}'").count() == 4


def test_a_lone_unit_and_repeated_rows(spark):
    p = json.dumps({"clazzFileResult": {"units": {"name": "c"}}})
    assert uploads.elements(messages(spark, [p]).union(messages(spark, [p]))).count() == 2


def test_empty_table_and_long_text(spark):
    assert uploads.elements(messages(spark, [p for p in ["x"]]).limit(0)).count() == 0
    long_ = json.dumps({"funcResult": {"units": [{"name": "n" * 1_000_000, "parameters": [{"name": "a"}] * 5000}]}})
    assert uploads.elements(messages(spark, [long_])).count() == 5001


def test_flat_tables_keep_their_parents(spark):
    m = messages(spark, [json.dumps({"funcResult": {"units": [UNIT, UNIT]}})])
    parents = {tuple(r)[:2] for r in uploads.units(m).collect()}
    assert {tuple(r)[:2] for r in uploads.typed(m, "parameter").collect()} <= parents
    assert {(r["pos"], r["name"], r["type"]) for r in uploads.typed(m, "parameter").collect()} == {(0, "a", "int"), (2, "b", None)}


def test_wrapped_numbers(spark):
    m = messages(spark, ['{"funcResult":{"units":[{"name":"f","span":{"start":{"row":{"$numberLong":"4"},"column":1}}}]}}'])
    r = uploads.units(m).first()
    assert (r["span_start_row"], r["span_start_col"]) == (4, 1)


def test_surrogates_and_dots(spark):
    rows = shred(messages(spark, ['{"a.b": "\\ud800", "a": {"b": 1}}']), ["delivery_id"], "payload")
    fields = rows.filter(f"`table` = '{ROOT}'").first()["fields"]
    assert fields["a.b"] == "1" and "a\\.b" in fields
    assert pick(rows, ROOT, {"n": "a.b:int"}).first()["n"] == 1


value = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("abc.", min_size=1, max_size=2), c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(value)
def test_every_leaf_comes_out_once(record):
    def leaves(v):
        if isinstance(v, dict):
            return sum(map(leaves, v.values()))
        return sum(map(leaves, v)) if isinstance(v, list) else v is not None

    rows = Record()
    got = [(r, p.table, p.column, v) for r, p, v in Reader(Shape()).triples(json.dumps(record), rows)]
    assert len(got) == leaves(record) and len({g[:3] for g in got}) == len(got)
    assert all(rows.place[r].table == t for r, t, _, _ in got)
    pivoted = Reader(Shape()).read(json.dumps(record))
    keys = [(p.table, tuple(at)) for p, at, _ in pivoted.rows()]
    assert len(set(keys)) == len(keys) and sum(len(c) for *_, c in pivoted.rows()) == len(got)


@settings(max_examples=300, deadline=None)
@given(value | st.text("{}[]\",:01.eE+-ntrufalse \\\n", max_size=12), st.sampled_from([None, 1]))
def test_events_accept_what_json_accepts(x, indent):
    text = x if isinstance(x, str) and indent else json.dumps(x, indent=indent)

    def build(it):
        kind, v = next(it)
        if kind == js.OPEN:
            out = {}
            while (e := next(it))[0] != js.CLOSE:
                out[e[1]] = build(it)
            return out
        if kind == js.LIST:
            out, it = [], iter_back(it)
            while not it.ends():
                out.append(build(it))
            return out
        return v if kind == js.TEXT else None if kind == js.NULL else json.loads(v)

    try:
        want = json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except ValueError:
        try:
            list(js.events(text))
            raise AssertionError(text)
        except ValueError:
            return
    assert build(iter_back(js.events(text))) == want


class iter_back:
    def __init__(self, it):
        self.it, self.held = getattr(it, "it", it), getattr(it, "held", [])

    def __next__(self):
        return self.held.pop() if self.held else next(self.it)

    def ends(self):
        e = next(self)
        if e[0] != js.END:
            self.held.append(e)
        return e[0] == js.END


def test_repeated_keys_count_with_the_last_value():
    text = '{"a":[{"x":1,"b":[1,2]},{"x":2}],"c":{"d":1},"a":[{"x":3}],"c":{"e":null}}'
    got = [(p.table, tuple(at), dict(c)) for p, at, c in Reader(Shape()).read(text).rows()]
    assert got == [(ROOT, (), {}), ("a", (0,), {"x": "3"})]


def test_depth_is_no_limit(spark):
    deep = ["[" * 30_000 + "]" * 30_000, '{"a":' * 30_000 + "7" + "}" * 30_000, '{"a":[' * 2000 + "1" + "]}" * 2000]
    unit = json.dumps({"funcResult": {"units": [UNIT]}})
    with_deep = [unit[:-1] + f', "z": {d}' + "}" for d in deep]
    assert uploads.elements(messages(spark, with_deep)).count() == 8 * len(deep)
    rows = shred(messages(spark, deep[1:]), ["delivery_id"], "payload").filter(f"`table` <> '{CORRUPT}'")
    assert rows.count() == 1 + 2001
    leaf = rows.filter("delivery_id = 0").selectExpr("map_values(fields)[0]", "length(map_keys(fields)[0])").first()
    assert tuple(leaf) == ("7", 2 * 30_000 - 1)
    assert shred(messages(spark, ["[" * 20_000 + "]" * 20_000]), ["delivery_id"], "payload").selectExpr("size(at) n").agg({"n": "max"}).first()[0] == 19_999


def test_tables_of_plain_values(spark):
    m = messages(spark, [json.dumps({"clazzFileResult": {"units": [{"name": "c", "extras": {"annotations": ["@A", 3], "modifiers": "public", "implements": ["I"], "extends": "B", "fields": [None, {"name": "n", "modifiers": ["final", None, "static"], "annotations": "@C"}]}}]}})])
    assert as_set(uploads.words(m, "annotation")) == {(0, 0, 0, "@A"), (0, 0, 1, "3")}
    assert as_set(uploads.words(m, "modifier")) == {(0, 0, 0, "public")}
    assert as_set(uploads.words(m, "interface")) == {(0, 0, 0, "I")}
    assert as_set(uploads.words(m, "field_modifier")) == {(0, 0, 1, 0, "final"), (0, 0, 1, 2, "static")}
    assert as_set(uploads.words(m, "field_annotation")) == {(0, 0, 1, 0, "@C")}
    assert uploads.units(m).first()["base"] == "B"


def test_elements_come_out_of_pivoted_rows(spark, monkeypatch):
    """p1_found is no pass of its own: its rows hold the values of the flat tables."""
    from factloom.operators import nested

    seen = []
    monkeypatch.setattr(uploads, "shred", lambda *a: seen.append(nested.shred(*a)) or seen[-1])
    m = messages(spark, [json.dumps({"funcResult": {"units": [UNIT]}})])
    n = uploads.elements(m).count()
    cells = [r["fields"] for r in seen[0].collect()]
    assert len(cells) == n and {"value": "@A"} in cells and {"type": "int", "name": "a"} in cells
