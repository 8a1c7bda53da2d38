"""Continuous ingest of upload messages from a folder of JSON lines into a store.

Any streaming source with a string column ``value`` serves, such as a Kafka topic; the folder
source is what needs no connector. Each micro-batch is written with an idempotent key, so a batch
that runs again after a failure leaves one copy of each fact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions import names
from factloom.store import SEQ, Store, sequence

_POINT = "struct<row:bigint,column:bigint>"
_SPAN = f"struct<start:{_POINT},end:{_POINT}>"
_VALUES = "array<struct<type:string,name:string>>"
_FUNC = f"name string, receiver string, namespace string, parameters {_VALUES}, returns {_VALUES}, defLine int, span {_SPAN}, bodySpan {_SPAN}, extras string, lang string"
_WORKSPACE = "workspace struct<repoId:string,revHash:string>"


def _struct(ddl: str) -> str:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl).simpleString()


def schema(topic: str) -> str:
    file = "path:string,language:string,type:string,units:array<{0}>"
    if topic == "func":
        return f"{_WORKSPACE}, funcResult struct<{file.format(_struct(_FUNC))}>"
    if topic == "clazz":
        return f"{_WORKSPACE}, clazzFileResult struct<{file.format(_struct(f'name string, module string, span {_SPAN}, extras string, lang string'))}>"
    if topic == "funcctx":
        neighbour = _struct("signature string")
        return f"{_WORKSPACE}, functionContexts array<{_struct(f'{_FUNC}, path string, calls array<{neighbour}>, reverseCalls array<{neighbour}>')}>"
    raise ValueError(f"no topic {topic}")


def messages(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of the lines of text files (``value``) and where each came from in time (``came``);
    back-pressure is the number of files per batch."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").load(folder)
    at = F.col("_metadata.file_modification_time").cast("double") * 1000
    return raw.select("value", F.concat_ws("|", F.lpad(at.cast("bigint").cast("string"), 20, "0"), "_metadata.file_path", F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")).alias("came"))


def decode(batch: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """(messages, dead letters) of a batch with a column ``value``. What is no JSON, names no
    repository and revision, or holds no result is a dead letter."""
    more = [c for c in batch.columns if c == SEQ]
    body = {"func": "funcResult", "clazz": "clazzFileResult", "funcctx": "functionContexts"}[topic]
    m = batch.select("value", *more, F.from_json("value", schema(topic), {"mode": "PERMISSIVE"}).alias("m"))
    whole = (F.coalesce("m.workspace.repoId", F.lit("")) != "") & (F.coalesce("m.workspace.revHash", F.lit("")) != "") & F.col(f"m.{body}").isNotNull()
    return m.filter(whole).select("value", *more, "m.*"), m.filter(~F.coalesce(whole, F.lit(False))).select("value")


def rows(decoded: DataFrame, topic: str) -> DataFrame:
    """The facts in decoded messages. If these have a place in the order of delivery, so have the
    facts: that of their message, then that in its list."""
    more = [F.col(SEQ)] if SEQ in decoded.columns else []
    placed = [F.concat_ws("|", SEQ, F.lpad(F.col("unit_ordinal").cast("string"), 12, "0")).alias(SEQ)] if more else []
    scope = [F.col("workspace.repoId").alias("repo_id"), F.col("workspace.revHash").alias("rev_hash")]
    if topic == "funcctx":
        u = decoded.select(*scope, *more, F.posexplode("functionContexts").alias("unit_ordinal", "u"))
        u = u.select("repo_id", "rev_hash", *placed, "u.*").withColumnsRenamed({"defLine": "def_line", "bodySpan": "body_span"})
        only = lambda c: F.transform(c, lambda x: x["signature"])
        return u.withColumns({"signature": names.signature(), "calls": only("calls"), "reverse_calls": only("reverseCalls")}).drop("reverseCalls", "returns", "body_span", "extras")
    r = "funcResult" if topic == "func" else "clazzFileResult"
    u = decoded.select(*scope, *more, F.col(f"{r}.path").alias("path"), F.posexplode(f"{r}.units").alias("unit_ordinal", "u")).filter("u is not null")
    u = u.select("repo_id", "rev_hash", "path", F.col("unit_ordinal").cast("bigint").alias("unit_ordinal"), *placed, "u.*")
    if topic == "func":
        return u.withColumnsRenamed({"defLine": "def_line", "bodySpan": "body_span"}).withColumn("signature", names.signature())
    return u.drop("unit_ordinal").withColumn("signature", names.class_signature())


TABLES = {"func": "fact_func", "clazz": "fact_clazz", "funcctx": "rel_funcctx"}


def sink(store: Store, topic: str, dead_letters: str) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does: the revision first, then the facts, then the dead letters."""

    def write(batch: DataFrame, batch_id: int) -> None:
        came = [F.coalesce("came", F.lit(""))] if "came" in batch.columns else []
        batch = batch.withColumn(SEQ, sequence(*came)).persist()
        try:
            good, bad = decode(batch, topic)
            # all of a batch came at one time; within it the order of delivery decides
            facts = rows(good, topic).withColumn("ingest_ts", F.current_timestamp())
            revs = good.select(F.col("workspace.repoId").alias("repo_id"), F.col("workspace.revHash").alias("rev_hash")).distinct()
            store.write("rev_info", revs.withColumns({"create_time": F.unix_timestamp(), "extras": F.lit(None).cast("string")}))
            store.write(TABLES[topic], facts)
            # a batch that runs again replaces what it left
            bad.write.mode("overwrite").json(f"{dead_letters}/{topic}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def start(stream: DataFrame, store: Store, topic: str, checkpoint: str, dead_letters: str, **trigger) -> StreamingQuery:
    """Run the ingest of one topic; ``trigger`` as for writeStream, by default all that is there."""
    return stream.writeStream.foreachBatch(sink(store, topic, dead_letters)).option("checkpointLocation", f"{checkpoint}/{topic}").trigger(**(trigger or {"availableNow": True})).start()


def depth(query: StreamingQuery) -> dict[str, float]:
    """Gauges of a running ingest: rows of the last batch, input and processing rate."""
    p = query.lastProgress or {}
    return {k: p.get(k) or 0 for k in ("numInputRows", "inputRowsPerSecond", "processedRowsPerSecond")}


def taken(query: StreamingQuery, name: str = "taken") -> int:
    """What a run has counted so far under an observed name, over all its batches."""
    return sum(p["observedMetrics"][name]["n"] for p in query.recentProgress if name in (p.get("observedMetrics") or {}))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts per window of event time and key; events later than ``late`` are dropped in a stream."""
    at = events.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    w = F.window("_at", width, slide or width)
    return at.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", by: str = "user_id") -> DataFrame:
    """Sessions of a key: runs of events with no gap longer than ``gap``."""
    at = events.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    return at.groupBy(F.session_window("_at", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")
