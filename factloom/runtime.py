"""Session defaults, table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that every job may rely on; a session that sets them itself keeps its own values.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(cpus: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the library's defaults, for tests, the bench and interactive use."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("factloom")
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false"} | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One of the tables kept as ``<base>/<name>.parquet`` (a file or a folder)."""
    importable(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def stream_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The same as a stream of its files."""
    importable(spark)
    path = f"{base}/{name}.parquet"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # a stream's source is a folder
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(base)


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package even if the driver was not started from its folder."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    if root not in (have := env.get("PYTHONPATH", "").split(":")):
        env["PYTHONPATH"] = ":".join(filter(None, [root, *have]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session (tests, a laptop) uses a folder below its
    warehouse; on a cluster that is an error, as no folder is known to be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_factloom"


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back.

    This cuts the lineage: a lost executor costs no recomputation of what lies before, and whatever
    reads the table twice sees the same rows in both reads. The files go when the driver ends or
    when :func:`release` is called.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A folder of one's own in the shared folder, deleted like the tables of :func:`materialize`."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:  # registered late, so that it runs before the session's own clean-up
        atexit.register(release)
    _written.append((spark, path))
    return path


def release() -> None:
    """Delete every table written by :func:`materialize`."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            if path.startswith(("file:", "/")):
                import shutil

                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for steps that are heavy per row.

    Only an input of fewer splits than cores, which is small, is shuffled; larger ones stay as they
    were split. For scans and what is narrow upon them; a plan with shuffles would be run to count.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed so far that no column of ``df`` has them (letter case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df`` in bytes (exact for a table just written)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


