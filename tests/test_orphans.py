from datetime import datetime, timedelta

from conftest import as_set

from factloom.operators import orphans

T0 = datetime(2024, 1, 1)
DAY = timedelta(days=1)
FUNC = "func_id bigint, repo_id string, rev_hash string, signature string, ingest_ts timestamp, h1 string, value string"
CTX = "ctx_id bigint, repo_id string, rev_hash string, signature string, calls array<string>, reverse_calls array<string>, ingest_ts timestamp, src_id string, gone int"
TAG = "tag_id bigint, repo_id string, rev_hash string, signature string, tag string, ingest_ts timestamp"
DROP = "drop_id bigint, repo_id string, rev_hash string, path string, signature string, drop_ts timestamp"


def graph(spark, func=(), ctx=(), tag=(), drop=(), deep=False):
    make = lambda rows, s, extra: spark.createDataFrame([(*r, *extra) for r in rows], s)
    return orphans.code_graph(make(func, FUNC, ("x", "y")), make(ctx, CTX, ("z", 1)), make(tag, TAG, ()), make(drop, DROP, ()), deep)


def found(g):
    return as_set(orphans.cascade(g).filter("kind = 'direct'").select("src_table", "src_id", "ref_field", "signature", "status"))


def test_states_of_references(spark):
    func = [(1, "r", "v", "a", T0), (1, "r", "v", "a", T0 + DAY), (2, "r", "v", "late", T0 + 3 * DAY), (3, "r", "w", "other", T0)]
    ctx = [(1, "r", "v", "a", ["late", "gone", "gone", None, "never", "other"], None, T0 + DAY), (1, "r", "v", "a", ["late"], None, T0 + 5 * DAY), (2, "r", "v", "a", [], ["a"], None)]
    tag = [(7, "r", "v", "late", "T", T0 + 4 * DAY), (8, "r", "v", None, "T", T0), (None, "r", "v", "never", "T", T0)]
    drop = [(1, "r", "v", "p", "gone", T0), (2, "r", "v", "p", "late", T0)]
    assert found(graph(spark, func, ctx, tag, drop)) == {
        ("rel_funcctx", 1, "calls", "late", "late"), ("rel_funcctx", 1, "calls", "gone", "deleted"), ("rel_funcctx", 1, "calls", "never", "missing"), ("rel_funcctx", 1, "calls", "other", "missing"),
        ("func_tag", None, "signature", "never", "missing"),
    }


def test_empty_tables(spark):
    assert found(graph(spark)) == set()
    assert found(graph(spark, ctx=[(1, "r", "v", "a", None, None, T0)])) == {("rel_funcctx", 1, "signature", "a", "missing")}


def test_null_scope_and_long_text(spark):
    long_ = "x" * 200_000
    assert found(graph(spark, [(1, None, "v", long_, T0)], [(1, None, "v", long_, None, [long_ + "y"], T0)])) == {("rel_funcctx", 1, "reverse_calls", long_ + "y", "missing")}


def test_orphans_are_inherited(spark):
    func = [(i, "r", "v", s, T0) for i, s in enumerate("abcde")]
    ctx = [(1, "r", "v", "a", ["missing"], None, T0), (2, "r", "v", "b", ["a"], None, T0), (3, "r", "v", "c", ["b", "d"], None, T0), (4, "r", "v", "d", ["e", "c"], None, T0), (5, "r", "v", "e", None, None, T0)]
    got = orphans.cascade(graph(spark, func, ctx, [(9, "r", "v", "d", "T", T0)], deep=True))
    levels = {(r["src_table"], r["src_id"]): r["level"] for r in got.collect() if r["kind"] == "inherited"}
    assert levels == {("rel_funcctx", 2): 1, ("rel_funcctx", 3): 2, ("rel_funcctx", 4): 3, ("func_tag", 9): 4}


def test_report(spark):
    g = graph(spark, ctx=[(1, "r", "v", "a", ["b"], None, T0), (2, "r", "v", "a", ["b"], None, T0)])
    assert as_set(orphans.report(orphans.cascade(g))) == {("rel_funcctx", "signature", "2024-01-01", "missing", 2, 2), ("rel_funcctx", "calls", "2024-01-01", "missing", 2, 2)}


def test_same_rows_without_broadcast(spark, data, monkeypatch):
    from factloom.plans import problems

    a = as_set(problems.QUERIES["p3_found"](spark, data))
    monkeypatch.setattr(orphans, "BROADCAST_BYTES", -1)
    assert as_set(problems.QUERIES["p3_found"](spark, data)) == a


def test_cascade_runs_behind_the_queries(spark, monkeypatch):
    from factloom.plans import problems

    func = [(1, "r", "v", "a", T0), (2, "r", "v", "b", T0), (3, "r", "v", "no context", T0)]
    ctx = [(1, "r", "v", "a", ["x"], None, T0), (2, "r", "v", "b", ["a", "no context"], None, T0)]
    tables = {n: t.rows for n, t in graph(spark, func, ctx).tables.items()} | {"func_drop": spark.createDataFrame([], DROP)}
    monkeypatch.setattr(problems, "read_table", lambda s, d, name: tables[name])
    seen, cascade = [], orphans.cascade
    monkeypatch.setattr(orphans, "cascade", lambda g: seen.append(cascade(g)) or seen[-1])
    assert as_set(problems.QUERIES["p3_found"](spark, "")) == {("rel_funcctx", 1, "calls", "x", "missing")}
    assert as_set(seen[0].select("src_id", "kind", "level")) == {(1, "direct", 0), (2, "inherited", 1)}
    direct = ("rel_funcctx", "calls", "2024-01-01", "missing")
    assert as_set(problems.QUERIES["p3_report"](spark, "")) == {(*direct, 1, 1)}
    assert as_set(problems.QUERIES["p3_report_kinds"](spark, "")) == {(*direct, "direct", 1, 1), (*direct[:3], "inherited", "inherited", 1, 1)}


def test_a_long_chain_and_a_circle(spark, monkeypatch):
    monkeypatch.setattr(orphans, "FOLD", 3)
    n = 12
    func = [(i, "r", "v", f"s{i}", T0) for i in range(n)]
    ctx = [(i, "r", "v", f"s{i}", [f"s{i - 1}"] if i else ["missing", f"s{n - 1}"], None, T0) for i in range(n)]
    got = {r["src_id"]: (r["kind"], r["level"]) for r in orphans.cascade(graph(spark, func, ctx, deep=True)).collect()}
    assert got == {i: ("inherited", i) if i else ("direct", 0) for i in range(n)}
    assert orphans.cascade(graph(spark, func, ctx, deep=True), max_levels=2).count() == 3
