import json

import duckdb
import pytest
from conftest import as_set

from factloom.functions.canonical import canonical_text, pruned
from factloom.operators import snapshots
from factloom.plans.problems import QUERIES


def brute(d):
    con = duckdb.connect()
    rows = con.execute(f"select repo_id, rev_hash, path, signature, name, receiver, namespace, parameters, returns, def_line, span, body_span, lang, extras from '{d}/fact_func.parquet'").fetchall()
    revs = con.execute(f"select repo_id, branch, rev_hash, min(create_time) from '{d}/rev_info.parquet' group by all order by 1, 2, 4, 3").fetchall()
    snap, out, before = {}, set(), None
    for r in rows:
        snap.setdefault(r[:2], {})[r[2:4]] = json.dumps([pruned(x) for x in r[4:13]] + [pruned(json.loads(r[13])) if r[13] else None], sort_keys=True)
    for repo, branch, rev, _ in revs:
        if (repo, rev) not in snap:
            continue
        if before and before[:2] == (repo, branch):
            a, b = snap[repo, before[2]], snap[repo, rev]
            for kind, keys in (("removed", a.keys() - b.keys()), ("added", b.keys() - a.keys()), ("changed", {k for k in a.keys() & b.keys() if a[k] != b[k]})):
                out |= {(repo, before[2], rev, *k, kind) for k in keys}
        before = (repo, branch, rev)
    return out


@pytest.mark.parametrize("limit", [16 << 20, -1])
def test_equals_brute_force(spark, data, monkeypatch, limit):
    monkeypatch.setattr(snapshots, "BROADCAST_BYTES", limit)
    got = QUERIES["p5_found"](spark, data).collect()
    assert {tuple(r) for r in got} == brute(data) and len(got) == len(set(got))


def test_canonical_json():
    same = ['{"a":1,"b":[]}', ' {"b":null, "a":1.0}', '{"a":1,"c":{"d":""}}']
    assert len({canonical_text(s) for s in same}) == 1
    assert canonical_text("{}") is canonical_text("null") is canonical_text("") is canonical_text(None) is canonical_text("[]") is None
    assert canonical_text('["a",null]') == canonical_text('["a",""]') != canonical_text('["a"]')
    assert canonical_text("{x") == "!{x"
    deep = '{"b":' * 20_000 + '[1.0,"",{"z":"é","a":null}]' + "}" * 20_000
    assert canonical_text(deep) == canonical_text(deep.replace("1.0", "1 ")) == '{"b":' * 20_000 + '[1,null,{"z":"\\u00e9"}]' + "}" * 20_000
    assert canonical_text(deep + "}") == "!" + deep + "}"


FUNC = "repo_id string, rev_hash string, path string, signature string, v bigint, chain string, ord int"
REV = "repo_id string, rev_hash string, branch string, create_time bigint, n int"


def changes(spark, func, rev):
    from pyspark.sql import functions as F

    f = spark.createDataFrame([(*r, "x", 0) for r in func], FUNC)
    r = spark.createDataFrame([(*r, 0) for r in rev], REV)
    return as_set(snapshots.snapshot_changes(f, r, ["repo_id", "branch"], ["repo_id", "rev_hash"], "create_time", ["path", "signature"], F.coalesce("v", F.lit(0))))


def test_nulls_copies_and_gaps(spark):
    func = [("r", "v1", None, "a", 1), ("r", "v1", None, "a", 1), ("r", "v1", "p", None, 1), ("r", "v3", None, "a", 2), ("r", "v3", "", "a", 1), ("r", "nowhere", "p", "a", 1)]
    rev = [("r", "v1", "b", 1), ("r", "v2", "b", 2), ("r", "v3", "b", 3), ("r", "v3", "b", 4), ("r", "v1", None, None)]
    assert changes(spark, func, rev) == {("r", "v1", "v3", None, "a", "changed"), ("r", "v1", "v3", "p", None, "removed"), ("r", "v1", "v3", "", "a", "added")}


def test_empty_tables(spark):
    assert changes(spark, [], [("r", "v", "b", 1)]) == changes(spark, [("r", "v", "p", "s", 1)], []) == set()
