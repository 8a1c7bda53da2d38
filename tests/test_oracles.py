"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import DATA

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in Path(DATA).iterdir():
        con.execute(f"create view {p.name.split('.')[0]} as select * from '{p if p.is_file() else str(p) + '/*.parquet'}'")
    return con


def rows(names, values):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple("∅" if r[i] is None else str(r[i]) for i in at) for r in values))


def check_plan(df):
    """Hash and merge joins only, no row-at-a-time Python."""
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    check_plan(df)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


def located(text, span):
    """The piece of a text at a printed span, whose columns count bytes."""
    (a, b), (c, d) = (map(int, p.split(":")) for p in span.split(","))
    lines = text.split("\n")
    raw = [x.encode("utf-8", "replace") for x in lines[a : c + 1]]
    if a == c:
        return raw[0][b:d].decode("utf-8", "replace")
    return "\n".join(x.decode("utf-8", "replace") for x in [raw[0][b:], *raw[1:-1], raw[-1][:d]])


@pytest.fixture(scope="module")
def sources(duck):
    return {i: t for i, t in duck.execute("select doc_id, text from documents where source = 'src_file' and path is not null").fetchall()}


def hold_functions(r, text):
    whole, name = located(text, r["span"]), r["signature"].split("|")[2]
    assert name in whole and r["lang"] and (not r["body_span"] or located(text, r["body_span"]) in whole)
    assert r["def_line"] == 0 or name in text.split("\n")[r["def_line"] - 1]


def hold_classes(r, text):
    assert r["signature"].split(".")[-1] in located(text, r["span"])


def hold_symbols(r, text):
    assert located(text, r["span"]) == r["symbol"] and r["kind"].endswith("identifier")


def hold_calls(r, text):
    whole = located(text, r["span"])
    assert whole.startswith(r["caller"].split("(")[0].split(".")[0]) and all(a in whole for a in (r["arguments"] or "").split(",")) and r["src"].count("|") == 4


#: What every row of a query that has no SQL must hold, by the text it comes from.
HOLDS = {"extract_functions": hold_functions, "extract_classes": hold_classes, "extract_symbols": hold_symbols, "extract_calls": hold_calls}


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_facts_stand_where_they_say(spark, data, sources, name):
    df = entry.queries()[name](spark, data)
    check_plan(df)
    found = [r for r in df.collect() if r["span"] is not None]
    assert len(found) > 20 or name == "extract_classes" and found
    for r in found:
        HOLDS[name](r, sources[r["doc_id"]])


def test_every_call_has_one_enclosing_function(spark, data):
    rows_ = entry.queries()["tree_enclosing"](spark, data).collect()
    keys = [(r["doc_id"], r["start_id"]) for r in rows_]
    assert len(set(keys)) == len(keys) > 20 and all(r["unit_id"] < r["start_id"] for r in rows_)
    # the same functions that the extraction of calls names
    calls = entry.queries()["extract_calls"](spark, data).filter("error is null").groupBy("doc_id").count().collect()
    per_doc = {}
    for d, _ in keys:
        per_doc[d] = per_doc.get(d, 0) + 1
    assert all(per_doc.get(r["doc_id"], 0) >= r["count"] for r in calls)


def test_no_query_is_left_unchecked():
    """Queries have SQL, or rows checked here, or are texts' and checked in tests/llm."""
    texts = {n for n in entry.queries() if n.startswith(("p4_", "p8_", "p9_", "p10_"))}
    assert set(entry.queries()) - set(SQL) - texts == set(HOLDS) | {"tree_enclosing"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
