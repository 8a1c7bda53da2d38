from collections import Counter

import numpy as np
from conftest import as_set
from pyspark.sql import functions as F

from factloom.operators import salted


def test_salting_changes_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{int(rng.integers(0, 40))}", i // 2, float(i), "a", 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id bigint, x double, _salt string, _salts int")
    part = {"n": F.count("*"), "s": F.sum("x"), "m": F.max("x"), "d": F.count_distinct("id")}
    merge = {"n": F.sum("n"), "s": F.sum("s"), "m": F.max("m"), "d": F.sum("d")}
    plain = as_set(df.groupBy("k").agg(F.count("*"), F.sum("x"), F.max("x"), F.count_distinct("id")))
    assert as_set(salted.salted_aggregate(df, ["k"], ["id"], part, merge, 0.017)) == plain
    assert df.transform(lambda d: salted.salted(d, ["k"], ["id"], 0.017)).filter("k = 'hot'").select("_salt_").distinct().count() > 10


def test_counts_of_signatures(spark):
    func = [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")]
    ctx = [(1, ["a", "a", None, "b"]), (1, ["a", "a", None, "b"]), (2, None), (3, []), (4, ["b"] * 70_000)]
    f = spark.createDataFrame(func, "func_id bigint, signature string")
    c = spark.createDataFrame(ctx, "ctx_id bigint, reverse_calls array<string>").withColumn("value", F.lit(1)).withColumn("_i", F.lit(1))
    for share in (0.01, None):
        got = as_set(salted.signature_counts(f, c, share))
        assert got == {("signature", "a", 2, 5), ("signature", "b", 1, 5), ("signature", "", 1, 5), ("reverse_calls", "a", 2, 70_003), ("reverse_calls", "b", 70_001, 70_003)}


def test_element_counts(spark):
    lists = [["b", "a", "b", None], [], None, [None], ["z"]]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, xs array<string>")
    want = {(i, v, n) for i, xs in enumerate(lists) for v, n in Counter(x for x in xs or [] if x is not None).items()}
    assert as_set(salted.element_counts(df, "xs", ["id"])) == want


def test_empty_tables(spark):
    f, c = spark.createDataFrame([], "func_id bigint, signature string"), spark.createDataFrame([], "ctx_id bigint, reverse_calls array<string>")
    assert salted.heavy_signatures(f, c).count() == 0


def test_number_of_heavy_keys_is_bounded(spark):
    df = spark.createDataFrame([(k, i) for k in range(60) for i in range(5)] + [(99, i) for i in range(400)], "k int, id bigint")
    assert salted.heavy_keys(df, ["k"], 0.001).count() == 61
    assert [r["_salts"] for r in salted.heavy_keys(df, ["k"], 0.01).collect()] == [58]
    assert salted.heavy_keys(df.limit(0), ["k"]).count() == 0


def test_copies_of_a_record_meet_under_a_salt(spark):
    rows = [("hot", i % 500, i) for i in range(5000)] + [(f"k{i}", i, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id bigint, n bigint").repartition(7)
    got = salted.salted_aggregate(df, ["k"], ["id"], {"n": F.sum("n"), "c": F.count("*")}, {"n": F.sum("n"), "c": F.sum("c")}, 0.01, once={"n": F.max("n")})
    assert as_set(got.filter("k = 'hot'")) == {("hot", sum(range(4500, 5000)), 500)}
    assert got.count() == 501


def test_hot_signatures_are_salted_in_the_query(spark, monkeypatch):
    """At sf0.01 there are heavy keys, and their rows are spread over salts in p6_found."""
    from factloom.plans import problems

    seen, real = [], salted.salted
    monkeypatch.setattr(salted, "salted", lambda *a: seen.append(real(*a)) or seen[-1])
    problems.QUERIES["p6_found"](spark, "/root/testdata/sf0.01")
    per_key = seen[0].filter("_salt > 0").groupBy("field", "h1").agg(F.countDistinct("_salt").alias("salts"), F.count("*").alias("n"))
    assert per_key.filter("salts > 5").count() >= 1
    largest = seen[0].groupBy("field", "h1", "h2", "_salt").count().agg(F.max("count")).first()[0]
    assert largest < 2.5 * salted.SHARE * seen[0].count()
