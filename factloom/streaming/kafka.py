"""Kafka as source and sink of upload messages. Needs Spark's Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Topic names.
TOPICS = {"func": "factloom-func", "funcctx": "factloom-funcctx", "clazz": "factloom-clazz"}


def messages(spark: SparkSession, servers: str, topic: str, max_offsets: int = 100_000, group: str | None = None) -> DataFrame:
    """A stream with the columns ``value`` and ``came`` (offset within a partition, where a producer
    keeps the messages of a key), as :func:`factloom.streaming.ingest.start` takes it; back-pressure
    is the number of offsets per batch."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", TOPICS[topic]).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", max_offsets)
    return (r.option("kafka.group.id", group) if group else r).load().select(F.col("value").cast("string").alias("value"), F.lpad(F.col("offset").cast("string"), 20, "0").alias("came"))


def submit(units: DataFrame, servers: str, topic: str) -> None:
    """Send upload units once, from a batch job: the column ``value`` if there is one, else the
    columns of a message as JSON."""
    value = F.col("value") if "value" in units.columns else F.to_json(F.struct("*"))
    units.select(value.alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", TOPICS[topic]).save()


def submit_stream(units: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """The same as a stream; delivery is at least once."""
    out = units.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("kafka")
    return out.option("kafka.bootstrap.servers", servers).option("topic", TOPICS[topic]).option("checkpointLocation", checkpoint).start()
