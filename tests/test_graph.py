import random

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from factloom.functions import spans
from factloom.operators import chains, graph

FUNC = "repo_id string, func_id bigint, path string, unit_ordinal bigint, name string, signature string, a int, b int, c int, d int"
SYM = "repo_id string, path string, symbol string, a int, b int, c int, d int"


def touches(s, o):
    if s[2] < o[0] or s[0] > o[2]:
        return False
    if s[2] == o[0]:
        return s[3] >= o[1]
    if s[0] == o[2]:
        return s[1] <= o[3]
    return True


def brute(func, sym, limit):
    files = {}
    for f in func:
        files.setdefault(f[2], []).append(f)
    for fs in files.values():
        fs.sort(key=lambda f: (f[3], f[1]))
    inside = [s for s in sym if any(touches(f[6:], s[3:]) for f in files.get(s[1], []))]
    refs = {}
    for s in inside:
        refs.setdefault(s[2], []).append(s)
    defs = {}
    for f in func:
        defs.setdefault(f[4], []).append(f)
    edges = set()
    for name, fs in defs.items():
        if len(name.encode()) < 4 or len(fs) * len(refs.get(name, [])) > limit:
            continue
        for callee in fs:
            for s in refs.get(name, []):
                for host in files[s[1]]:
                    if touches(host[6:], s[3:]) and (host[6:], host[5]) != (callee[6:], callee[5]):
                        edges.add(("r", host[1], callee[1]))
                        break
    return edges


@pytest.mark.parametrize("seed", range(3))
def test_edges_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    names = ["abc", "abcd", "ébc", "éébc", "render", "setup", "x" * 8]
    func, sym, n = [], [], 0
    for p in range(6):
        for k in range(rnd.randint(2, 6)):
            a = rnd.randint(0, 12)
            c = a + rnd.randint(0, 8)
            name = rnd.choice(names)
            func.append(("r", n, f"f{p}", k, name, f"||{name}||", a, rnd.randint(0, 5), c, rnd.randint(6, 9)))
            n += 1
    func.append(("r", n, "f0", 99, func[0][4], func[0][5], *func[-1][6:]))
    for _ in range(120):
        row, col = rnd.randint(0, 22), rnd.randint(0, 9)
        s = ("r", f"f{rnd.randint(0, 7)}", rnd.choice(names), row, col, row, col + 3)
        if s not in sym:
            sym.append(s)
    span = spans.make("a", "b", "c", "d")
    f = spark.createDataFrame(func, FUNC).withColumns({"span": span, "body_span": span})
    s = spark.createDataFrame(sym, SYM).withColumn("span", span)
    for limit in (1024, 12):
        assert as_set(graph.call_edges(f, s, limit=limit)) == brute(func, sym, limit)


@pytest.mark.parametrize(("refs", "hit"), [(1024, True), (1025, False)])
def test_reference_limit(spark, refs, hit):
    span = spans.make("a", "b", "c", "d")
    f = spark.createDataFrame([("r", 1, "p", 0, "callee", "c", 0, 0, 1, 0), ("r", 2, "p", 1, "caller", "k", 5, 0, 9000, 0)], FUNC).withColumns({"span": span, "body_span": span})
    s = spark.range(refs).select(F.lit("r").alias("repo_id"), F.lit("p").alias("path"), F.lit("callee").alias("symbol"), spans.make(F.col("id") + 10, F.lit(0), F.col("id") + 10, F.lit(6)).alias("span"))
    assert as_set(graph.call_edges(f, s)) == ({("r", 2, 1)} if hit else set())


def test_context_and_star(spark):
    span = spans.make("a", "b", "c", "d")
    f = spark.createDataFrame([("r", i, "p", i, f"name{i}", f"s{i}", 10 * i, 0, 10 * i + 5, 0) for i in range(3)], FUNC).withColumns({"span": span, "body_span": span})
    e = spark.createDataFrame([("r", 0, 1), ("r", 2, 1)], "repo_id string, caller_id bigint, callee_id bigint")
    assert as_set(graph.contexts(f, e).select("func_id", F.array_join("calls", ","), F.array_join("reverse_calls", ","))) == {(0, "s1", ""), (1, "", "s0,s2"), (2, "s1", "")}
    assert as_set(graph.star_edges(f, e).filter("center_id = 0")) == {("r", 0, "name0", "name1")}
    assert as_set(graph.neighbours(e).select("func_id", F.size("calls"), F.size("reverse_calls"))) == {(0, 1, 0), (1, 0, 2), (2, 1, 0)}


CTX = "ctx_id bigint, repo_id string, rev_hash string, path string, signature string, calls array<string>, reverse_calls array<string>, a int, b int, c int, d int"


def walk(edges, start, depth):
    out, todo = [], [(start, ())]
    while todo:
        node, chain = todo.pop()
        nxt = edges.get(node, [])
        if not nxt or len(chain) > depth:
            out.append(chain)
            continue
        todo += [(n, (*chain, n)) for n in dict.fromkeys(nxt) if n not in chain]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("depth", [0, 1, 4])
def test_chains_equal_brute_force(spark, seed, depth):
    rnd = random.Random(seed)
    nodes = [f"n{i}" for i in range(8)]
    edges = {n: [rnd.choice([*nodes, "unknown", n]) for _ in range(rnd.randint(0, 3))] for n in nodes}
    rows = [(i, "r", "v", "p", n, e or None, None, 0, 0, 0, 0) for i, (n, e) in enumerate(edges.items())] + [(99, "r", "v", "q", "n0", ["nope"], None, 0, 0, 0, 0)]
    ctx = spark.createDataFrame(rows, CTX).withColumn("span", spans.make("a", "b", "c", "d"))
    starts = spark.createDataFrame([("r", "v", n) for n in ("n0", "n1", "n2", "n1", "unknown")], "repo_id string, rev_hash string, signature string")
    got = {}
    for r in chains.chains(ctx, starts, depth).collect():
        got.setdefault(r["start"], []).append(tuple(r["chain"]))
    want = {s: walk(edges, s, depth) for s in ("n0", "n1", "n2", "unknown")}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_negative_depth(spark):
    with pytest.raises(ValueError):
        chains.chains(None, None, -1)


def test_duplicate_vertices_are_an_error(spark):
    f = spark.createDataFrame([("r", 1, "p", "|s", 1), ("r", 2, "p", "|s", 2), ("r", 3, "q", "|s", 1)], "repo_id string, func_id bigint, path string, signature string, a int")
    f = f.withColumn("span", spans.make("a", F.lit(0), "a", F.lit(9)))
    assert graph.require_unique(f) is f
    with pytest.raises(ValueError, match="p"):
        graph.require_unique(f.union(f.filter("func_id = 1").withColumn("func_id", F.lit(9).cast("bigint"))))


def test_long_bodies_and_symbols_over_many_rows(spark):
    func = [("r", 1, "p", 0, "outer", "||outer||", 0, 0, 1000, 0), ("r", 2, "p", 1, "inner", "||inner||", 500, 0, 700, 0)]
    sym = [("r", "p", "inner", 10, 0, 900, 3), ("r", "p", "outer", 600, 0, 600, 4), ("r", "p", "inner", 1001, 0, 1001, 4), ("r", "p", "inner", 10, 0, 900, 3), ("r", "q", "inner", 1, 0, 1, 4)]
    f = spark.createDataFrame(func, FUNC).select("*", spans.make("a", "b", "c", "d").alias("span"), spans.make("a", "b", "c", "d").alias("body_span"))
    s = spark.createDataFrame(sym, SYM).select("repo_id", "path", "symbol", spans.make("a", "b", "c", "d").alias("span"))
    assert as_set(graph.call_edges(f, s)) == {("r", 1, 2), ("r", 2, 1)}
    assert graph.symbols_in_bodies(f, s).count() == 2


def test_a_graph_reads_its_table_once(spark, data):
    """func_context writes the functions of the graph and works on these: one scan of fact_func."""
    from factloom.plans import catalog

    text = catalog.graph_functions(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert text.count("fact_func.parquet") == 1
    assert "fact_func.parquet" not in catalog.func_context(spark, data)._jdf.queryExecution().executedPlan().toString()
