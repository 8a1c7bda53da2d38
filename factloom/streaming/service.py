"""The jobs of a service: a gateway that takes uploads in, and workers that write them to the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.config import Config
from factloom.store import Store
from factloom.streaming import ingest, kafka


def queued(spark: SparkSession, config: Config, topic: str) -> DataFrame:
    """The messages of a topic's queue as a stream."""
    if config.queue == "kafka":
        return kafka.messages(spark, config.kafka_servers, topic, config.batch, config.kafka_group or None)
    return ingest.messages(spark, f"{config.queue}/{topic}", config.batch)


def gateway(spark: SparkSession, config: Config, topic: str, **trigger) -> StreamingQuery:
    """Take the uploads in ``<inbox>/<topic>`` into the queue; what is no message stays out of it and
    goes to the dead letters."""
    stream = ingest.messages(spark, f"{config.inbox}/{topic}", config.batch)

    def forward(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, bad = ingest.decode(batch, topic)
            # a batch that runs again replaces what it left in a folder; Kafka gets it once more
            if config.queue == "kafka":
                kafka.submit(good, config.kafka_servers, topic)
            else:
                good.select("value").write.mode("overwrite").text(f"{config.queue}/{topic}/batch-{batch_id}")
            bad.write.mode("overwrite").json(f"{config.dead_letters}/gateway/{topic}/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(forward).option("checkpointLocation", f"{config.checkpoint}/gateway/{topic}").trigger(**(trigger or {"availableNow": True})).start()


def serve(spark: SparkSession, config: Config, store: Store | None = None, **trigger) -> list[StreamingQuery]:
    """Start the jobs of the mode, for every topic; without a trigger they do what there is and end,
    the gateway's before the workers'."""
    store = store or Store(spark, config.store, config.driver)
    started = []
    if config.mode in ("all", "gateway"):
        for topic in config.topics:
            (spark.sparkContext._jvm.java.io.File(f"{config.inbox}/{topic}").mkdirs() if ":" not in config.inbox else None)
            started.append(gateway(spark, config, topic, **trigger))
        if not trigger:
            for q in started:
                q.awaitTermination()
    if config.mode in ("all", "worker"):
        for topic in config.topics:
            (spark.sparkContext._jvm.java.io.File(f"{config.queue}/{topic}").mkdirs() if ":" not in config.queue and config.queue != "kafka" else None)
            started.append(ingest.start(queued(spark, config, topic), store, topic, f"{config.checkpoint}/worker", config.dead_letters, **trigger))
    return started
