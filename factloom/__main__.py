"""python -m factloom extract|upload|diff|history ..."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.api import Engine
from factloom.config import MODES, load
from factloom.functions import names
from factloom.operators import facts, graph, history
from factloom.runtime import materialize, session
from factloom.sources import files, patches
from factloom.sources.extract import extract
from factloom.streaming.service import serve


def contexts_of(found: DataFrame, symbols: DataFrame, scope: list[str]) -> DataFrame:
    """Functions with their direct callees and callers, out of extracted functions and symbols. Says
    which files were not parsed, or only in part."""
    found = materialize(found, "extracted")
    for r in found.filter("error is not null").select("path", "error").distinct().toLocalIterator():
        print(f"{r['path']}: {r['error']}", file=sys.stderr)
    found = found.filter("name is not null").drop("error")
    func = graph.require_unique(materialize(found.withColumn("func_id", F.xxhash64(*scope, names.vertex())), "functions"), scope)
    symbols = symbols.filter("symbol is not null").select(*scope, "path", "symbol", "span")
    return graph.contexts(func, graph.call_edges(func, symbols, scope), scope)


def analysed(src: DataFrame, scope: list[str]) -> DataFrame:
    """The same of source texts."""
    return contexts_of(extract(src, "func", [*scope, "path"]), extract(src, "symbol", [*scope, "path"]), scope)


def _facts(listed: DataFrame, repo_dir: str, repo_id: str, what: str, everything: bool = True) -> DataFrame:
    return files.facts_of(listed, repo_dir, what, everything).withColumn("repo_id", F.lit(repo_id))


def upload(spark: SparkSession, engine: Engine, repo_dir: str, repo_id: str, depth: int, langs: list[str] | None = None) -> None:
    """All revisions at once: a content that many of them hold is parsed once."""
    revs = files.commits(spark, repo_dir, depth)
    listed = files.index(spark, repo_dir, [r[0] for r in revs.select("rev_hash").collect()], everything=True)
    listed = materialize(listed.filter(F.col("lang").isin(langs)) if langs else listed, "files")
    engine.store.write("rev_info", revs.select(F.lit(repo_id).alias("repo_id"), "rev_hash", "create_time", F.lit(None).cast("string").alias("extras")))
    ctx = contexts_of(*(_facts(listed, repo_dir, repo_id, what) for what in ("func", "symbol")), ["repo_id", "rev_hash"])
    engine.upload_functions(ctx.drop("calls", "reverse_calls", "func_id"))
    engine.upload_contexts(ctx.drop("func_id", "returns", "body_span", "extras", "unit_ordinal"))
    engine.upload_classes(_facts(listed, repo_dir, repo_id, "class").filter("name is not null").drop("error"))


def diff(spark: SparkSession, repo_dir: str, old: str, new: str, thin: bool) -> DataFrame:
    listed = materialize(files.index(spark, repo_dir, [new], everything=True), "files")
    ctx = contexts_of(*(_facts(listed, repo_dir, ".", what) for what in ("func", "symbol")), ["repo_id", "rev_hash"])
    rev = listed.select("rev_hash").first()
    patch = spark.createDataFrame([(files.diff(repo_dir, old, new), ".", rev[0] if rev else new)], "text string, repo_id string, rev_hash string")
    lines = patches.affected_lines(patch, ["repo_id", "rev_hash"])
    hit = facts.affected(ctx, lines)
    return facts.thin(hit, ctx) if thin else hit.join(ctx.select("func_id", "calls", "reverse_calls"), "func_id", "left")


def history_graphs(spark: SparkSession, repo_dir: str, depth: int | None) -> DataFrame:
    """The lines of the graph text of every revision; what it changed against the one before is filled."""
    revs = [r[0] for r in files.commits(spark, repo_dir, depth).orderBy(F.col("ordinal").desc()).select("rev_hash").collect()]
    listed = files.index(spark, repo_dir, revs)
    func = materialize(_facts(listed, repo_dir, ".", "func", False).filter("name is not null"), "functions")
    lines = patches.affected_lines(files.diffs(spark, repo_dir, list(zip(revs, revs[1:]))).withColumn("repo_id", F.lit(".")), ["repo_id", "rev_hash"])
    sources = lines.filter(facts.lang_of_path("path").isNotNull())
    return history.dot(history.edges(func), history.changed_nodes(func, sources))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="factloom")
    sub = p.add_subparsers(dest="cmd", required=True)
    e = sub.add_parser("extract", help="facts of a source folder as JSON")
    e.add_argument("--src", required=True)
    e.add_argument("--lang")
    e.add_argument("--type", default="func", choices=["func", "class", "symbol", "call", "unit"])
    e.add_argument("--include")
    e.add_argument("--exclude")
    e.add_argument("--output", required=True)
    u = sub.add_parser("upload", help="facts of a git history into a store")
    u.add_argument("--src", required=True)
    u.add_argument("--repo", required=True)
    u.add_argument("--store", required=True)
    u.add_argument("--depth", type=int, default=1)
    u.add_argument("--lang", action="append")
    d = sub.add_parser("diff", help="functions affected between two revisions")
    d.add_argument("--src", required=True)
    d.add_argument("--from", dest="old", required=True)
    d.add_argument("--to", dest="new", default="HEAD")
    d.add_argument("--thin", action="store_true")
    d.add_argument("--output", required=True)
    h = sub.add_parser("history", help="graph texts of a git history")
    h.add_argument("--src", required=True)
    h.add_argument("--depth", type=int)
    h.add_argument("--output", required=True)
    v = sub.add_parser("serve", help="take uploads in and write them to the store, as the mode says")
    v.add_argument("--config")
    v.add_argument("--mode", choices=MODES)
    v.add_argument("--every", help="run on, a batch this often, as in '10 seconds'; else do what there is and end")
    a = p.parse_args(argv)
    spark = session()
    if a.cmd == "serve":
        config = load(a.config)
        for q in serve(spark, replace(config, mode=a.mode) if a.mode else config, **({"processingTime": a.every} if a.every else {})):
            q.awaitTermination()
        return 0
    src = str(Path(a.src).resolve())
    if a.cmd == "extract":
        extract(files.scan(spark, src, a.lang, a.include, a.exclude), a.type, ["path"]).write.mode("overwrite").json(a.output)
    elif a.cmd == "upload":
        upload(spark, Engine(spark, a.store), src, a.repo, a.depth, a.lang)
    elif a.cmd == "diff":
        diff(spark, src, a.old, a.new, a.thin).write.mode("overwrite").json(a.output)
    else:
        graphs = history_graphs(spark, src, a.depth).repartition("rev_hash").sortWithinPartitions("rev_hash", "part", "line")
        graphs.select("rev_hash", "line").write.mode("overwrite").partitionBy("rev_hash").text(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
