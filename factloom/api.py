"""The engine: every query and write of the service, as methods that give DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import __version__
from factloom.functions import rules
from factloom.operators import chains, facts
from factloom.store import Store


class Engine:
    """Queries over a :class:`Store`. A missing repository, revision or function gives no rows,
    except where a single one is asked for by signature: that raises KeyError."""

    def __init__(self, spark: SparkSession, base: str, driver: str = "parquet") -> None:
        self.spark, self.store = spark, Store(spark, base, driver)

    def _table(self, name: str, repo: str | None = None, rev: str | None = None, path: str | None = None) -> DataFrame:
        df = self.store.functions_with_tags() if name == "fact_func" else self.store.read(name)
        return facts.in_scope(df, repo, rev, path)

    def _request(self, repo: str, rev: str, path: str, lines: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(repo, rev, path, lines)], "repo_id string, rev_hash string, path string, lines array<int>")

    # scope
    def repos(self) -> DataFrame:
        return facts.repos(self.store.read("rev_info"))

    def revs(self, repo: str) -> DataFrame:
        return facts.revisions(self.store.read("rev_info"), repo)

    def files(self, repo: str, rev: str, include: str | None = None) -> DataFrame:
        return facts.files(self._table("fact_func", repo, rev), include).orderBy("path")

    def rev_stat(self, repo: str, rev: str) -> DataFrame:
        f = self._table("fact_func", repo, rev)
        return f.groupBy("repo_id", "rev_hash").agg(F.count_distinct("path").alias("file_count"), F.count("*").alias("function_count"))

    def delete_rev(self, repo: str, rev: str) -> None:
        self.store.delete_revision(repo, rev)

    def delete_repo(self, repo: str) -> list[str]:
        return self.store.delete_repository(repo)

    # uploads
    def upload_functions(self, rows: DataFrame) -> None:
        self.store.write("fact_func", rows)

    def upload_classes(self, rows: DataFrame) -> None:
        self.store.write("fact_clazz", rows)

    def upload_contexts(self, rows: DataFrame) -> None:
        self.store.write("rel_funcctx", facts.slim(rows))

    def upload_revision(self, repo: str, rev: str, create_time: int, extras: str | None = None) -> None:
        self.store.write("rev_info", self.spark.createDataFrame([(repo, rev, create_time, extras)], "repo_id string, rev_hash string, create_time bigint, extras string"))

    # by file
    def functions(self, repo: str, rev: str, path: str, lines: list[int] | None = None) -> DataFrame:
        f = self._table("fact_func", repo, rev, path)
        return facts.with_lines(f, self._request(repo, rev, path, lines)) if lines else f

    def classes(self, repo: str, rev: str, path: str, lines: list[int] | None = None) -> DataFrame:
        f = self._table("fact_clazz", repo, rev, path)
        return facts.with_lines(f, self._request(repo, rev, path, lines)) if lines else f

    def contexts(self, repo: str, rev: str, path: str, lines: list[int] | None = None) -> DataFrame:
        """Contexts of a file's functions; a function without one is an error."""
        wanted = self.functions(repo, rev, path, lines).select("repo_id", "rev_hash", "signature").distinct()
        found = facts.by_signature(self._table("rel_funcctx", repo, rev), wanted)
        lost = wanted.join(found, ["repo_id", "rev_hash", "signature"], "left_anti").first()
        if lost:
            raise KeyError(lost["signature"])
        return found

    # by rule
    def functions_by_rule(self, repo: str, rev: str, rule: rules.Rule) -> DataFrame:
        return facts.by_rule(self._table("fact_func", repo, rev), rule)

    def classes_by_rule(self, repo: str, rev: str, rule: rules.Rule) -> DataFrame:
        return facts.by_rule(self._table("fact_clazz", repo, rev), rule)

    def contexts_by_rule(self, repo: str, rev: str, rule: rules.Rule) -> DataFrame:
        return facts.by_rule(self._table("rel_funcctx", repo, rev), rule)

    # by signature
    def signatures(self, repo: str, rev: str, pattern: str) -> DataFrame:
        return facts.signatures_matching(self._table("fact_func", repo, rev), pattern)

    def _one(self, name: str, repo: str, rev: str, signature: str) -> DataFrame:
        wanted = self.spark.createDataFrame([(repo, rev, signature)], "repo_id string, rev_hash string, signature string")
        found = facts.by_signature(self._table(name, repo, rev), wanted)
        if found.isEmpty():
            raise KeyError(signature)
        return found

    def function(self, repo: str, rev: str, signature: str) -> DataFrame:
        return self._one("fact_func", repo, rev, signature)

    def context(self, repo: str, rev: str, signature: str) -> DataFrame:
        return self._one("rel_funcctx", repo, rev, signature)

    def chain(self, repo: str, rev: str, signature: str, depth: int, reverse: bool = False) -> DataFrame:
        start = self.context(repo, rev, signature)
        return chains.chains(self._table("rel_funcctx", repo, rev), start, int(depth), reverse)

    # by count and tag
    def by_reference_count(self, repo: str, rev: str, more_than: int, less_than: int, reverse: bool = False, compat: bool = False) -> DataFrame:
        """``compat`` counts calls in both directions, as the service once did."""
        column = "reverse_calls" if reverse and not compat else "calls"
        return facts.reference_count(self._table("rel_funcctx", repo, rev), int(more_than), int(less_than), column)

    def by_tags(self, repo: str, rev: str, tags: str) -> DataFrame:
        return facts.with_tags(facts.in_scope(self.store.read("func_tag"), repo, rev), tags)

    def add_tag(self, repo: str, rev: str, signature: str, tag: str) -> None:
        self.store.add_tag(self.spark.createDataFrame([(repo, rev, signature)], "repo_id string, rev_hash string, signature string"), tag)

    # ops
    def ping(self) -> str:
        return "pong"

    def version(self) -> str:
        return __version__
