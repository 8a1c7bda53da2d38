"""Source trees and git histories as tables of files."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import names, rules
from factloom.operators.facts import SUFFIXES, lang_of_path
from factloom.runtime import materialize, spread

#: Larger files of a git tree are left out, unless all are asked for.
MAX_BYTES = 1_000_000


def scan(spark: SparkSession, root: str, lang: str | None = None, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(path, lang, text) of all source files below ``root``; paths are relative to it.

    Names are filtered before contents are read. Bytes that are no UTF-8 become U+FFFD.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root if ":" in root else f"file:{root}"
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    path = names.relative_path(plain, "/" + base.split(":", 1)[1].lstrip("/"))
    files = raw.select(path.alias("path"), "content").withColumn("lang", lang_of_path("path")).filter("lang is not null")
    if lang:
        files = files.filter(F.col("lang") == lang)
    if include:
        files = files.filter(rules.matches("path", include))
    if exclude:
        files = files.filter(~rules.matches("path", exclude))
    return files.select("path", "lang", F.decode("content", "UTF-8").alias("text"))


def _git(repo: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout


def commits(spark: SparkSession, repo: str, depth: int | None = None) -> DataFrame:
    """(rev_hash, create_time, ordinal) of the history of HEAD, newest first, at most ``depth``."""
    out = _git(repo, "log", "--format=%H %ct", *([f"-{depth}"] if depth else [])).decode().split("\n")
    rows = [(h, int(t), k) for k, (h, t) in enumerate(x.split(" ") for x in out if x)]
    return spark.createDataFrame(rows, "rev_hash string, create_time bigint, ordinal int")


def index(spark: SparkSession, repo: str, revs: Sequence[str], lang: str | None = None, everything: bool = False) -> DataFrame:
    """(rev_hash, path, lang, sha) of the source files of the revisions, without large ones unless
    ``everything`` is asked for. The trees are listed by the tasks, which must see the repository."""
    suffixes = tuple(s for s, x in SUFFIXES.items() if lang in (None, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rev in batch.column(0).to_pylist():
                paths, shas = [], []
                for line in _git(repo, "ls-tree", "-r", "-l", "-z", rev).decode("utf-8", "replace").split("\0"):
                    if line:
                        meta, path = line.split("\t", 1)
                        _, kind, sha, size = meta.split()
                        if kind == "blob" and path.endswith(suffixes) and (everything or int(size) <= MAX_BYTES):
                            paths.append(path)
                            shas.append(sha)
                yield pa.RecordBatch.from_arrays([pa.array([rev] * len(paths), pa.string()), pa.array(paths, pa.string()), pa.array(shas, pa.string())], names=["rev_hash", "path", "sha"])

    names_ = [(_git(repo, "rev-parse", r).decode().strip(),) for r in revs]
    listed = spread(spark.createDataFrame(names_, "rev string")).mapInArrow(run, "rev_hash string, path string, sha string")
    return listed.select("rev_hash", "path", lang_of_path("path").alias("lang"), "sha")


def texts(blobs: DataFrame, repo: str, everything: bool = False) -> DataFrame:
    """``blobs``, rows with a column ``sha``, with the blobs' ``text``; binary ones are left out unless
    ``everything`` is asked for. One git process per task reads them all."""
    schema = T.StructType([*blobs.schema.fields, T.StructField("text", T.StringType())])
    at = blobs.columns.index("sha")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        git = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for batch in batches:
                keep, out = [], []
                for k, sha in enumerate(batch.column(at).to_pylist()):
                    git.stdin.write(sha.encode() + b"\n")
                    git.stdin.flush()
                    head = git.stdout.readline().split()
                    if len(head) != 3:
                        raise RuntimeError(f"no blob {sha}")
                    data = git.stdout.read(int(head[2]) + 1)[:-1]
                    if everything or b"\0" not in data[:8000]:
                        keep.append(k)
                        out.append(data.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep, pa.int64())).columns, pa.array(out, pa.string())], names=schema.names)
        finally:
            git.stdin.close()
            git.wait()

    return spread(blobs).mapInArrow(run, schema)


def tree(spark: SparkSession, repo: str, rev: str = "HEAD", lang: str | None = None, everything: bool = False) -> DataFrame:
    """(rev_hash, path, lang, text) of the source files of one revision, without large and binary
    ones unless ``everything`` is asked for."""
    return texts(index(spark, repo, [rev], lang, everything), repo, everything).drop("sha")


def facts_of(listed: DataFrame, repo: str, what: str, everything: bool = False) -> DataFrame:
    """Facts of all listed files: each content of a language is read and parsed once, however many
    revisions hold it, and its facts are joined to the files."""
    from factloom.sources.extract import extract

    once = listed.select("sha", "lang", F.col("lang").alias("_lang")).distinct()
    found = materialize(extract(texts(once, repo, everything), what, ["sha", "_lang"]), f"facts-{what}")
    files = listed.withColumnRenamed("lang", "_lang")
    return files.join(found, ["sha", "_lang"]).drop("sha", "_lang")


def diff(repo: str, old: str, new: str) -> str:
    return _git(repo, "diff", old, new).decode("utf-8", "replace")


def diffs(spark: SparkSession, repo: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(rev_hash, text): the patch from the first to the second revision of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for old, new in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([diff(repo, old, new)])], names=["rev_hash", "text"])

    return spread(spark.createDataFrame(list(pairs), "old string, new string")).mapInArrow(run, "rev_hash string, text string")
