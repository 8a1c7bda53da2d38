import json

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from factloom import store as stores
from factloom.api import Engine
from factloom.config import Config, load
from factloom.store import MemoryDriver, ParquetDriver, Store, register_driver
from factloom.streaming import kafka, service
from test_store import functions, message


def test_settings(tmp_path):
    assert load(None, {}) == Config()
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"mode": "worker", "batch": 5, "topics": ["func"]}))
    assert load(str(f), {}) == Config(mode="worker", batch=5, topics=("func",))
    assert load(str(f), {"FACTLOOM_MODE": "gateway", "FACTLOOM_BATCH": "7", "FACTLOOM_TOPICS": "func,clazz", "OTHER": "x"}) == Config(mode="gateway", batch=7, topics=("func", "clazz"))
    f.write_text('{"port": 1}')
    for wrong in (lambda: load(str(f), {}), lambda: Config(mode="x"), lambda: Config(queue="kafka")):
        with pytest.raises(ValueError):
            wrong()


def folders(tmp_path, **more):
    return Config(**{n: str(tmp_path / n) for n in ("store", "queue", "inbox", "checkpoint", "dead_letters")}, topics=("func",), **more)


def run(spark, config):
    for q in service.serve(spark, config):
        q.awaitTermination()


def test_gateway_and_workers(spark, tmp_path):
    config = folders(tmp_path)
    (tmp_path / "inbox" / "func").mkdir(parents=True)
    (tmp_path / "inbox" / "func" / "a.json").write_text("\n".join([message("r", "f"), "{bad", message("r", "g")]))
    run(spark, config)
    e = Engine(spark, config.store)
    assert as_set(e.functions("r", "v", "p").select("name")) == {("f",), ("g",)}
    assert spark.read.text(config.queue + "/func", recursiveFileLookup=True).count() == 2
    assert spark.read.json(config.dead_letters + "/gateway/func").count() == 1
    # a gateway alone fills the queue, a worker alone empties it
    (tmp_path / "inbox" / "func" / "b.json").write_text(message("r", "h"))
    run(spark, folders(tmp_path, mode="gateway"))
    assert e.functions("r", "v", "p").count() == 2
    run(spark, folders(tmp_path, mode="worker"))
    assert e.functions("r", "v", "p").count() == 3


@pytest.mark.parametrize("driver", ["parquet", "memory"])
def test_drivers_keep_the_same_rows(spark, tmp_path, driver):
    e = Engine(spark, str(tmp_path / "s"), driver)
    assert isinstance(e.store.driver, {"parquet": ParquetDriver, "memory": MemoryDriver}[driver]) and not e.store.exists("fact_func")
    e.upload_functions(functions(spark, ("r", "v", "p", "f", "", "", "OLD", 0, 1), ("r", "w", "q", "g", "", "", "", 0, 1), ("q", "v", "p", "h", "", "", "", 0, 1)))
    e.upload_functions(functions(spark, ("r", "v", "p", "f", "", "", "NEW", 0, 1)))
    e.upload_revision("r", "v", 3)
    e.add_tag("r", "v", "||f||", "T")
    assert as_set(e.functions("r", "v", "p").select("lang", F.array_join("tags", ","))) == {("NEW", "T")}
    assert [r["signature"] for r in e.store.scan("fact_func").collect()] == ["||h||", "||f||", "||g||"]
    e.delete_rev("r", "v")
    assert as_set(e.store.read("fact_func").select("repo_id", "rev_hash")) == {("r", "w"), ("q", "v")}
    assert e.delete_repo("r") == ["w"] and as_set(e.store.read("fact_func").select("repo_id")) == {("q",)}


def test_registered_drivers(spark, monkeypatch):
    monkeypatch.setattr(stores, "DRIVERS", dict(stores.DRIVERS))
    register_driver("mine", MemoryDriver)
    assert isinstance(Store(spark, "x", "mine").driver, MemoryDriver)
    with pytest.raises(ValueError):
        register_driver("mine", MemoryDriver)
    with pytest.raises(ValueError):
        Store(spark, "x", "none")
    with pytest.raises(ValueError):
        Store(spark, "x", "memory").read("none")


class Recorder:
    """Stands for Spark's reader and writer: keeps the format and options it is given."""

    def __init__(self, frame=None):
        self.said, self.frame = {}, frame

    def __getattr__(self, name):
        def call(*a, **k):
            self.said[a[0] if name == "option" else name] = a[1] if name == "option" else a
            return self.frame if name == "load" else self

        return call


def test_kafka_options(spark, monkeypatch):
    """Without a broker: what the source asks for and how its rows become messages, and what is sent."""
    rows = spark.createDataFrame([(bytearray(b"a"), 0, 7)], "value binary, partition int, offset bigint")
    reader = Recorder(rows)
    monkeypatch.setattr(type(spark), "readStream", property(lambda self: reader))
    got = kafka.messages(spark, "h:1", "func", 5, "g")
    assert reader.said["subscribe"] == kafka.TOPICS["func"] and reader.said["maxOffsetsPerTrigger"] == 5 and reader.said["kafka.group.id"] == "g" and reader.said["kafka.bootstrap.servers"] == "h:1"
    assert as_set(got) == {("a", "7".zfill(20))}
    writer = Recorder()
    sent = []
    monkeypatch.setattr(type(rows), "write", property(lambda self: sent.append(self) or writer))
    kafka.submit(spark.createDataFrame([("x", 1)], "path string, k int"), "h:1", "clazz")
    kafka.submit(spark.createDataFrame([("whole", 1)], "value string, k int"), "h:1", "clazz")
    assert writer.said["topic"] == kafka.TOPICS["clazz"] and [r["value"] for s in sent for r in s.collect()] == ['{"path":"x","k":1}', "whole"]
