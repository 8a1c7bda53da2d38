import re

import numpy as np
import pytest
from conftest import as_set
from pyspark.sql import functions as F

from factloom.operators import keyfilter, orphans, snapshots
from factloom.operators.keys import hash64
from factloom.plans import problems
from factloom.runtime import materialize


def hashed(df):
    return df.select(hash64("id").alias("h1"), hash64(F.lit(1), "id").alias("h2"), "id")


@pytest.mark.parametrize("limit", [16 << 20, -1])
def test_join_is_exact(spark, limit):
    rows = spark.range(5000).withColumn("wide", F.concat(F.lit("w"), "id"))
    keys = materialize(hashed(spark.range(0, 9000, 7)), "keys").withColumnRenamed("id", "hit")
    got = keyfilter.join_keys(rows, [hash64("id"), hash64(F.lit(1), "id")], keys, limit)
    assert as_set(got.select("id", "hit")) == {(i, i) for i in range(0, 5000, 7)}
    assert keyfilter.join_keys(rows, [hash64("id"), hash64(F.lit(1), "id")], materialize(keys.limit(0), "none"), limit).count() == 0


@pytest.mark.parametrize(("n", "size", "most"), [(1, 32 << 20, 0.01), (20_000, 32 << 20, 0.01), (300_000, 32 << 20, 0.01), (300_000, 1 << 17, 0.9)])
def test_filter_lets_all_keys_pass_and_few_others(spark, n, size, most):
    keys = hashed(spark.range(n))
    bits = keyfilter.build(keys, n, size)
    assert len(bits) <= size and bits.dtype == np.uint8
    test = keyfilter.may_hold(spark, bits)
    assert keys.filter(~test("h1", "h2")).isEmpty()
    assert hashed(spark.range(10_000_000, 10_020_000)).filter(test("h1", "h2")).count() <= most * 20_000


def exchanged(df):
    """The parts of a plan below each exchange that carries a path or signature as text."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = text.split("\n")
    out = []
    for i, x in enumerate(lines):
        if re.search(r"Exchange hashpartitioning", x):
            depth = len(x) - len(x.lstrip(" :+-"))
            below = []
            for y in lines[i + 1 :]:
                if len(y) - len(y.lstrip(" :+-")) <= depth:
                    break
                below.append(y)
            out.append("\n".join(below))
    return out


def test_only_matching_rows_are_shuffled(spark, data, monkeypatch):
    monkeypatch.setattr(snapshots, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(orphans, "BROADCAST_BYTES", -1)
    for df, column in ((problems.QUERIES["p5_found"](spark, data), "path"), (orphans.direct(problems._graph(spark, data)), "signature")):
        wide = [b for b in exchanged(df) if re.search(rf"FileScan .*ReadSchema: struct<.*\b{column}:string", b)]
        assert wide and all("ArrowEvalPython" in b for b in wide)


def test_same_changes_without_broadcast(spark, data, monkeypatch):
    a = as_set(problems.QUERIES["p5_found"](spark, data))
    monkeypatch.setattr(snapshots, "BROADCAST_BYTES", -1)
    assert as_set(problems.QUERIES["p5_found"](spark, data)) == a
