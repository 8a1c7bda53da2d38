import uuid

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from factloom.operators import dedupe

U = [uuid.UUID(int=(k + 1) * (2**125 + 2**60 + 17)) for k in range(4)]
SCHEMA = "delivery_id bigint, msg_id string, payload string, _file string, _row int, _part int, _bits string, _metadata string"


def rows(*pairs):
    return [(d, m, f"p{i}", "f", 1, 2, "b", "m") for i, (d, m) in enumerate(pairs)]


MESSAGES = rows(
    (5, str(U[0])), (3, f"{{{str(U[0]).upper()}}}"), (9, f" {U[0].hex}\n"), (1, f"urn:uuid:{U[1]}"), (2, f"URN:UUID:{U[1]}"), (4, None), (6, None), (7, "no uuid"), (8, "no uuid"), (None, str(U[2])), (10, str(U[2])), (11, str(U[3])), (11, str(U[3])), (12, "")
)


def test_notations(spark):
    df = spark.createDataFrame([(x,) for x in (str(U[0]), U[0].hex.upper(), f"{{{U[0]}}}", f"({U[0]})", f"\t{U[0]} ", f"urn:uuid:{U[0]}")], "m string")
    assert as_set(df.select(dedupe.uuid_hex("m"))) == {(U[0].hex,)}
    bad = spark.createDataFrame([("",), (None,), ("x" * 32,), (U[0].hex + "0",), ("0" * 1_000_000,)], "m string")
    assert as_set(bad.select(dedupe.uuid_hex("m"))) == {(None,)}


def test_duplicate_deliveries(table):
    assert as_set(dedupe.duplicate_deliveries(table(MESSAGES, SCHEMA))) == {(5,), (9,), (2,)}


@pytest.mark.parametrize("limit", [16 << 20, -1])
def test_one_copy_stays(table, monkeypatch, limit):
    monkeypatch.setattr(dedupe, "BROADCAST_BYTES", limit)
    df = table(MESSAGES, SCHEMA)
    kept = dedupe.keep_first(df, dedupe.uuid_hex("msg_id"), "delivery_id")
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted((r["delivery_id"] or 0, r["_bits"]) for r in got) == [(d, "b") for d in (1, 3, 4, 6, 7, 8, 10, 11, 12)]


@pytest.mark.parametrize("limit", [16 << 20, -1])
def test_found_deliveries_come_out_of_deletion_vectors(table, monkeypatch, limit):
    monkeypatch.setattr(dedupe, "BROADCAST_BYTES", limit)
    seen, real = [], dedupe.deletion_vectors
    monkeypatch.setattr(dedupe, "deletion_vectors", lambda lost: seen.append(real(lost)) or seen[-1])
    assert as_set(dedupe.duplicate_deliveries(table(MESSAGES, SCHEMA))) == {(5,), (9,), (2,)}
    assert sum(bin(b).count("1") for r in seen[0].collect() for b in r["_bits"]) == 3


def test_extreme_orders(table):
    ends = [-(2**63), 2**63 - 1, 0, None, -1]
    df = table(rows(*((d, str(U[0])) for d in ends)), SCHEMA)
    assert as_set(dedupe.duplicate_deliveries(df)) == {(2**63 - 1,), (0,), (-1,)}
    assert [r["delivery_id"] for r in dedupe.keep_first(df, dedupe.uuid_hex("msg_id"), "delivery_id").collect()] == [-(2**63)]
    assert "SortAggregate" not in dedupe.losers(df, dedupe.uuid_hex("msg_id"), "delivery_id")._jdf.queryExecution().executedPlan().toString()


def test_hot_identifier(table):
    df = table([(i, str(U[0]), "p", "", 0, 0, "", "") for i in range(5000)], SCHEMA)
    assert dedupe.duplicate_deliveries(df).count() == 4999
    assert [r["delivery_id"] for r in dedupe.keep_first(df, dedupe.uuid_hex("msg_id"), "delivery_id").collect()] == [0]


def test_empty_table(table):
    df = table([], SCHEMA)
    assert dedupe.duplicate_deliveries(df).count() == dedupe.keep_first(df, dedupe.uuid_hex("msg_id"), "delivery_id").count() == 0


def test_halves_are_exact(spark):
    df = spark.createDataFrame([("f" * 32,), ("0" * 32,), ("8" + "0" * 31,)], "u string").select(*dedupe._halves(F.col("u")))
    assert as_set(df) == {(-1, -1), (0, 0), (-(2**63), 0)}


def test_latest_row_of_a_key(table):
    from datetime import datetime

    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    data = [("a", t[0], 1, "x"), ("a", t[2], 1, "last"), ("a", t[1], 9, "x"), (None, t[0], 1, "x"), (None, t[0], 2, "last"), ("b", None, 5, "last"), ("c", None, 5, "x"), ("c", t[0], None, "last"), ("d", t[0], 1, "same"), ("d", t[0], 1, "same")]
    df = table([(*r, "f") for r in data], "k string, at timestamp, id bigint, v string, _file string")
    got = dedupe.keep_latest(df, ["k"], "at", "id")
    assert got.columns == df.columns and sorted((r["k"] or "", r["v"]) for r in got.collect()) == [("", "last"), ("a", "last"), ("b", "last"), ("c", "last"), ("d", "same")]
    assert dedupe.keep_latest(table([], "k string, at timestamp, id bigint", "e"), ["k"], "at", "id").count() == 0
    narrow = dedupe.keep_latest(df, ["k"], "at", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in narrow  # wide rows are not shuffled


def test_times_as_order(table):
    from datetime import datetime

    data = [(datetime(2024, 1, 1, 0, 0, 0, k), str(U[0]), k) for k in (5, 3, 9)]
    df = table(data, "at timestamp, msg_id string, k int")
    assert [r["k"] for r in dedupe.keep_first(df, dedupe.uuid_hex("msg_id"), "at").collect()] == [3]
    assert [r["k"] for r in dedupe.keep_first(df.withColumn("x", F.lit(1)).drop("x"), dedupe.uuid_hex("msg_id"), "at").collect()] == [3]
