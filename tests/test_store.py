import json
import os
from datetime import datetime

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from factloom.api import Engine
from factloom.functions import names, spans
from factloom.streaming import ingest

FUNC = "repo_id string, rev_hash string, path string, name string, receiver string, namespace string, lang string, a int, b int"


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"))


def functions(spark, *rows):
    none = F.lit(None).cast("array<struct<type:string,name:string>>")
    df = spark.createDataFrame(rows, FUNC).withColumns({"parameters": none, "returns": none, "span": spans.make("a", F.lit(0), "b", F.lit(0)), "extras": F.lit(None).cast("string")}).drop("a", "b")
    return df.withColumn("signature", names.signature())


def test_functions_and_rules(spark, engine):
    engine.upload_revision("r", "abc", 5)
    engine.upload_functions(functions(spark, ("r", "abc", "p.go", "fn", "", "", "GOLANG", 0, 9), ("r", "abc", "p.go", "fn1", "fr", "", "GOLANG", 20, 30), ("", "abc", "p.go", "lost", "", "", "", 0, 1)))
    assert engine.functions("r", "abc", "p.go").count() == 2
    assert as_set(engine.functions("r", "abc", "p.go", [24]).select("name")) == {("fn1",)}
    assert engine.signatures("r", "abc", "fn1.*").count() == 1 == engine.functions_by_rule("r", "abc", {"name": "fn1.*"}).count()
    with pytest.raises(ValueError):
        engine.functions_by_rule("r", "abc", {})
    assert as_set(engine.files("r", "abc").select("path")) == {("p.go",)} and engine.files("r", "abc", "py$").count() == 0
    assert engine.rev_stat("r", "abc").first()[2:] == (1, 2)
    with pytest.raises(KeyError):
        engine.function("r", "abc", "none")
    # again, changed: the last upload wins
    engine.upload_functions(functions(spark, ("r", "abc", "p.go", "fn", "", "", "JAVA", 0, 9)))
    assert as_set(engine.functions("r", "abc", "p.go").select("name", "lang")) == {("fn", "JAVA"), ("fn1", "GOLANG")}


def test_tags_are_a_set_and_survive(spark, engine):
    engine.upload_functions(functions(spark, ("r", "v", "p", "f", "", "", "", 0, 1)))
    for t in ("A", "B", "A"):
        engine.add_tag("r", "v", "||f||", t)
    engine.upload_functions(functions(spark, ("r", "v", "p", "f", "", "", "", 0, 1)))
    assert engine.functions("r", "v", "p").first()["tags"] == ["A", "B"]
    assert [engine.by_tags("r", "v", t).count() for t in ("A", "A;B", "C", "A;C")] == [1, 1, 0, 0]
    assert engine.functions_by_rule("r", "v", {"tags": '.*"B".*'}).count() == 1


def test_contexts_and_chains(spark, engine):
    f = functions(spark, *((("r", "v", "p", n, "", "", "", k, k + 1)) for k, n in enumerate("abc")))
    engine.upload_functions(f)
    calls = {"a": ["||b||"], "b": ["||c||"], "c": []}
    ctx = f.withColumn("calls", F.transform(F.from_json(F.create_map(*(F.lit(x) for k, v in calls.items() for x in (k, json.dumps(v))))[F.col("name")], "array<string>"), lambda s: F.struct(s.alias("signature")))).withColumn("reverse_calls", F.array().cast("array<struct<signature:string>>"))
    engine.upload_contexts(ctx)
    assert as_set(engine.chain("r", "v", "||a||", 3).select(F.array_join("chain", ">"))) == {("||b||>||c||",)}
    assert engine.by_reference_count("r", "v", 0, 2).count() == 2 and engine.by_reference_count("r", "v", 0, 2, True).count() == 0 and engine.by_reference_count("r", "v", 0, 2, True, compat=True).count() == 2
    assert engine.contexts("r", "v", "p").count() == 3
    with pytest.raises(KeyError):
        engine.chain("r", "v", "none", 1)


def test_revisions_and_deletes(spark, engine):
    for r, v, t in (("r", "abc", 1), ("r", "abcd", 3), ("r", "abc", 2), ("q", "x y/z", 9)):
        engine.upload_revision(r, v, t)
        engine.upload_functions(functions(spark, (r, v, "p", "f", "", "", "", 0, 1)))
    assert [tuple(x) for x in engine.revs("r").select("rev_hash", "create_time").collect()] == [("abcd", 3), ("abc", 2)]
    engine.delete_rev("r", "abc")
    assert as_set(engine.revs("r").select("rev_hash")) == {("abcd",)} and engine.functions("r", "abc", "p").count() == 0 and engine.functions("r", "abcd", "p").count() == 1
    assert engine.delete_repo("q") == ["x y/z"]
    assert as_set(engine.repos()) == {("r",)}


def message(repo, name, rev="v"):
    return json.dumps({"workspace": {"repoId": repo, "revHash": rev}, "funcResult": {"path": "p", "language": "GOLANG", "type": "func", "units": [{"name": name, "span": {"start": {"row": 1, "column": 0}, "end": {"row": 2, "column": 0}}}, None]}})


def test_streaming_ingest(spark, engine, tmp_path):
    src, dead = tmp_path / "in", str(tmp_path / "dead")
    src.mkdir()
    (src / "a.json").write_text("\n".join([message("r", "f"), message("r", "g"), "{bad", message("", "h")]))
    run = lambda: ingest.start(ingest.messages(spark, str(src)), engine.store, "func", str(tmp_path / "cp"), dead).awaitTermination()
    run()
    assert as_set(engine.functions("r", "v", "p").select("name")) == {("f",), ("g",)}
    assert spark.read.json(dead + "/func").count() == 2
    (src / "b.json").write_text(message("r", "f"))
    run()
    assert engine.functions("r", "v", "p").count() == 2 and as_set(engine.repos()) == {("r",)}


def test_the_last_upload_of_a_batch_wins(spark, engine, tmp_path):
    """Two hundred keys, each uploaded twice in one micro-batch, in one file and in two."""
    src = tmp_path / "in"
    src.mkdir()

    def upload(k, lang):
        m = json.loads(message("r", f"f{k}"))
        m["funcResult"]["units"][0]["lang"] = lang
        return json.dumps(m)

    (src / "z.json").write_text("\n".join([upload(k, "OLD") for k in range(200)] + [upload(k, "NEW") for k in range(100)]))
    (src / "a.json").write_text("\n".join(upload(k, "NEW") for k in range(100, 200)))
    os.utime(src / "z.json", (1_700_000_000, 1_700_000_000))
    os.utime(src / "a.json", (1_700_000_100, 1_700_000_100))
    ingest.start(ingest.messages(spark, str(src)), engine.store, "func", str(tmp_path / "cp"), str(tmp_path / "dead")).awaitTermination()
    assert as_set(engine.functions("r", "v", "p").groupBy("lang").count()) == {("NEW", 200)}
    assert "_seq" not in engine.functions("r", "v", "p").columns


def test_the_last_row_of_a_write_wins(spark, engine):
    rows = [("r", "v", "p", f"f{k % 200}", "", "", "OLD" if k < 200 else "NEW", 0, 1) for k in range(400)]
    engine.upload_functions(functions(spark, *rows).withColumn("ingest_ts", F.current_timestamp()))
    assert as_set(engine.functions("r", "v", "p").groupBy("lang").count()) == {("NEW", 200)}


def test_other_topics(spark):
    unit = {"name": "C", "module": "m", "extras": {"a": 1}, "span": {"start": {"row": 0, "column": 0}, "end": {"row": 1, "column": 1}}}
    c = json.dumps({"workspace": {"repoId": "r", "revHash": "v"}, "clazzFileResult": {"path": "p", "units": [unit]}})
    x = json.dumps({"workspace": {"repoId": "r", "revHash": "v"}, "functionContexts": [{"name": "f", "path": "p", "calls": [{"signature": "s"}], "reverseCalls": None}]})
    good, bad = ingest.decode(spark.createDataFrame([(c,), (x,)], "value string"), "clazz")
    assert bad.count() == 1 and ingest.rows(good, "clazz").first()["signature"] == "m.C"
    good, _ = ingest.decode(spark.createDataFrame([(x,)], "value string"), "funcctx")
    r = ingest.rows(good, "funcctx").first()
    assert (r["signature"], r["calls"], r["reverse_calls"]) == ("||f||", ["s"], None)
    with pytest.raises(ValueError):
        ingest.schema("none")


def test_event_time(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 10, m), "u", "a", 1.0) for m in (0, 10, 50, 59)]
    ev = spark.createDataFrame(rows, "ts timestamp, user_id string, event_type string, value double")
    assert ingest.event_windows(ev, "30 minutes").count() == 2 and ingest.event_windows(ev, "1 hour", slide="30 minutes").count() == 3
    assert sorted(r["n"] for r in ingest.sessions(ev).collect()) == [2, 2]
