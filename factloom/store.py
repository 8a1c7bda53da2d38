"""The store of facts: upserts, tags and exact deletes over a driver that keeps the rows.

Writes append; what came last wins when a table is read. The Parquet driver keeps one folder per
table, partitioned by repository and revision, and deletes a revision by dropping its partitions;
other drivers can be registered.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators import facts

#: The key of a row within its revision and the column that breaks ties, by table.
KEYS = {
    "fact_func": ("path", "signature", "span.start.row", "span.end.row"),
    "fact_clazz": ("path", "signature", "span.start.row", "span.end.row"),
    "rel_funcctx": ("path", "signature", "span.start.row", "span.end.row"),
    "func_tag": ("signature", "tag"),
    "rev_info": (),
}
SCOPE = ["repo_id", "rev_hash"]
#: Place of a row in the order of delivery within one write: text that sorts.
SEQ = "_seq"


def sequence(*before: Column) -> Column:
    """A place in the order of delivery: by the columns ``before``, then as the rows stand."""
    wide = lambda c: F.lpad(c.cast("string"), 20, "0")
    return F.concat_ws("|", *before, wide(F.monotonically_increasing_id()))


class Driver(ABC):
    """Where a store's rows are kept. Tables are those of :data:`KEYS`; every row has a repository and
    a revision."""

    @abstractmethod
    def exists(self, table: str) -> bool: ...

    @abstractmethod
    def append(self, table: str, rows: DataFrame) -> None: ...

    @abstractmethod
    def rows(self, table: str) -> DataFrame:
        """All rows that were appended and not deleted."""

    @abstractmethod
    def drop(self, table: str, repo_id: str, rev_hash: str) -> None: ...


class ParquetDriver(Driver):
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def exists(self, table: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.base}/{table}"))

    def _schema(self, table: str) -> T.StructType:
        """The columns of all that was ever appended, for a table whose rows are all deleted."""
        fs, path = self._fs()
        at = path(f"{self.base}/_schemas/{table}.json")
        if not fs.exists(at):
            return T.StructType()
        return T.StructType.fromJson(json.loads(self.spark.read.text(at.toString(), wholetext=True).first()[0]))

    def _keep_schema(self, table: str, new: T.StructType) -> None:
        old = self._schema(table)
        if more := [f for f in new.fields if f.name not in old.names]:
            fs, path = self._fs()
            out = fs.create(path(f"{self.base}/_schemas/{table}.json"), True)
            out.write(bytearray(T.StructType([*old.fields, *more]).json().encode()))
            out.close()

    def append(self, table: str, rows: DataFrame) -> None:
        self._keep_schema(table, rows.schema)
        rows.repartition(*SCOPE).write.mode("append").partitionBy(*SCOPE).parquet(f"{self.base}/{table}")

    def rows(self, table: str) -> DataFrame:
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.base}/{table}")
        except AnalysisException as e:
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], self._schema(table))

    def drop(self, table: str, repo_id: str, rev_hash: str) -> None:
        fs, path = self._fs()
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        fs.delete(path(f"{self.base}/{table}/repo_id={escape(repo_id)}/rev_hash={escape(rev_hash)}"), True)


class MemoryDriver(Driver):
    """Rows held by the session's executors, for tests and small jobs; gone with the session."""

    def __init__(self, spark: SparkSession, base: str = "") -> None:
        self.tables: dict[str, DataFrame] = {}

    def exists(self, table: str) -> bool:
        return table in self.tables

    def append(self, table: str, rows: DataFrame) -> None:
        rows = rows.persist()
        rows.count()
        self.tables[table] = self.tables[table].unionByName(rows, allowMissingColumns=True) if table in self.tables else rows

    def rows(self, table: str) -> DataFrame:
        return self.tables[table]

    def drop(self, table: str, repo_id: str, rev_hash: str) -> None:
        if table in self.tables:
            self.tables[table] = self.tables[table].filter(~((F.col("repo_id") == repo_id) & (F.col("rev_hash") == rev_hash)))


DRIVERS: dict[str, Callable[[SparkSession, str], Driver]] = {"parquet": ParquetDriver, "memory": MemoryDriver}


def register_driver(name: str, factory: Callable[[SparkSession, str], Driver]) -> None:
    """Add a driver; ``factory`` gets the session and the place that the store is opened with."""
    if name in DRIVERS:
        raise ValueError(f"driver {name} is registered already")
    DRIVERS[name] = factory


class Store:
    def __init__(self, spark: SparkSession, base: str, driver: str = "parquet") -> None:
        if driver not in DRIVERS:
            raise ValueError(f"no driver {driver}")
        self.spark, self.base, self.driver = spark, base.rstrip("/"), DRIVERS[driver](spark, base)

    def _known(self, table: str) -> str:
        if table not in KEYS:
            raise ValueError(f"no table {table}")
        return table

    def exists(self, table: str) -> bool:
        return self.driver.exists(self._known(table))

    def write(self, table: str, rows: DataFrame, at=None) -> None:
        """Upsert: append rows with the time they came and their place in the order of delivery, which
        settles two uploads of a key in one write: a column ``_seq`` if there is one, else the order
        of ``rows``. Rows need a repository and a revision."""
        whole = rows.filter((F.coalesce("repo_id", F.lit("")) != "") & (F.coalesce("rev_hash", F.lit("")) != ""))
        if "ingest_ts" not in whole.columns or at is not None:
            whole = whole.withColumn("ingest_ts", F.current_timestamp() if at is None else F.lit(at))
        if SEQ not in whole.columns:
            whole = whole.withColumn(SEQ, sequence())
        self.driver.append(self._known(table), whole)

    def read(self, table: str) -> DataFrame:
        """The table as it is now: of each key the row that came last."""
        raw = self.driver.rows(self._known(table))
        raw = raw.withColumns({c: F.col(c).cast("string") for c in SCOPE})
        if table == "rev_info":
            return raw.groupBy(*SCOPE).agg(F.max("create_time").alias("create_time"), F.max_by("extras", "ingest_ts").alias("extras"))
        raw = raw if SEQ in raw.columns else raw.withColumn(SEQ, F.lit(None).cast("string"))
        return facts.latest(raw, [*SCOPE, *KEYS[table]], "ingest_ts", SEQ).drop(SEQ)

    def scan(self, table: str) -> DataFrame:
        """The same in the order of keys."""
        order = [c for c in ("path", "signature") if c in KEYS[self._known(table)]]
        return self.read(table).orderBy(*SCOPE, *order)

    def add_tag(self, rows: DataFrame, tag: str) -> None:
        """Tags are a set of their own: they survive another upload of the function."""
        self.write("func_tag", rows.select(*SCOPE, "signature", F.lit(tag).alias("tag")).distinct())

    def functions_with_tags(self) -> DataFrame:
        f = self.read("fact_func")
        if not self.exists("func_tag"):
            return f.withColumn("tags", F.array().cast("array<string>"))
        return f.join(facts.tags_of(self.read("func_tag")), [*SCOPE, "signature"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))

    def delete_revision(self, repo_id: str, rev_hash: str) -> None:
        for table in KEYS:
            self.driver.drop(table, repo_id, rev_hash)

    def delete_repository(self, repo_id: str) -> list[str]:
        """Delete all revisions of a repository; returns their names."""
        seen: set[str] = set()
        for table in KEYS:
            if self.exists(table):
                raw = self.driver.rows(table)
                seen |= {r[0] for r in raw.filter(F.col("repo_id").cast("string") == repo_id).select(F.col("rev_hash").cast("string")).distinct().collect()}
        for rev in sorted(seen):
            self.delete_revision(repo_id, rev)
        return sorted(seen)
