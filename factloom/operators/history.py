"""Histories of revisions: snapshots, differences and the graph of a revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import names, spans
from factloom.operators.facts import SCOPE
from factloom.operators.keys import hash64


def neighbours(func: DataFrame, rev: DataFrame) -> DataFrame:
    """(repo_id, from_rev, to_rev) of consecutive revisions of each branch that have functions."""
    there = rev.join(func.select(*SCOPE).distinct(), list(SCOPE), "left_semi").groupBy("repo_id", "branch", "rev_hash").agg(F.min("create_time").alias("at"))
    before = F.lag("rev_hash").over(Window.partitionBy("repo_id", "branch").orderBy("at", "rev_hash"))
    return there.select("repo_id", before.alias("from_rev"), F.col("rev_hash").alias("to_rev")).filter("from_rev is not null").distinct()


def versions(func: DataFrame, rev: DataFrame, kind: str) -> DataFrame:
    """Keys (path, signature) that a revision has and its predecessor lacks (``added``), or the
    other way round (``removed``)."""
    pairs = neighbours(func, rev)
    keys = func.select(*SCOPE, "path", "signature").distinct()
    has, lacks = ("to_rev", "from_rev") if kind == "added" else ("from_rev", "to_rev")
    mine = pairs.join(keys.withColumnRenamed("rev_hash", has), ["repo_id", has])
    other = keys.select(F.col("repo_id").alias("_r"), F.col("rev_hash").alias("_v"), F.col("path").alias("_p"), F.col("signature").alias("_s"))
    on = (F.col("repo_id") == F.col("_r")) & (F.col(lacks) == F.col("_v")) & (F.col("path") == F.col("_p")) & (F.col("signature") == F.col("_s"))
    return mine.join(other, on, "left_anti").select("repo_id", "from_rev", "to_rev", "path", "signature")


def carry_forward(before: DataFrame, touched: DataFrame, now: DataFrame, file_key: list[str]) -> DataFrame:
    """The snapshot after a change: what was there, without the files that were touched, plus what
    the touched files hold now. ``carried`` tells which is which."""
    kept = before.join(touched.select(*file_key), file_key, "left_anti").withColumn("carried", F.lit(True))
    return kept.unionByName(now.join(touched.select(*file_key), file_key, "left_semi").withColumn("carried", F.lit(False)))


def snapshots(func: DataFrame, rev: DataFrame) -> DataFrame:
    """(repo_id, rev_hash, path, signature, carried) of every revision that has a predecessor,
    built from the predecessor's functions and the files whose signatures changed."""
    pairs = neighbours(func, rev)
    keys = func.select(*SCOPE, "path", "signature").distinct()
    # the set of a file's signatures as its size and sums of two hashes, which need no list of it
    h = [hash64("signature"), hash64(F.lit(1), "signature")]
    content = keys.groupBy(*SCOPE, "path").agg(F.struct(F.count("*").alias("n"), F.bit_xor(h[0]).alias("a"), F.bit_xor(h[1]).alias("b")).alias("content"))
    was = pairs.join(content.withColumnsRenamed({"rev_hash": "from_rev", "content": "was"}), ["repo_id", "from_rev"])
    now = pairs.join(content.withColumnsRenamed({"rev_hash": "to_rev", "content": "now"}), ["repo_id", "to_rev"])
    key = ["repo_id", "from_rev", "to_rev", "path"]
    touched = was.join(now, key, "full").filter(~F.col("was").eqNullSafe(F.col("now"))).select(*key)
    before = pairs.join(keys.withColumnRenamed("rev_hash", "from_rev"), ["repo_id", "from_rev"]).select(*key, "signature")
    after = pairs.join(keys.withColumnRenamed("rev_hash", "to_rev"), ["repo_id", "to_rev"]).select(*key, "signature")
    return carry_forward(before, touched, after, key).select("repo_id", F.col("to_rev").alias("rev_hash"), "path", "signature", "carried").distinct()


def edges(func: DataFrame) -> DataFrame:
    """The graph of each revision: revision to top folder, folder to folder, file to function."""
    steps = names.path_prefixes("path")
    files = func.select(*SCOPE, "path").distinct().select(*SCOPE, F.explode(F.arrays_zip(F.concat(F.array("rev_hash"), F.slice(steps, F.lit(1), F.size(steps) - 1)).alias("source"), steps.alias("target"))).alias("e"))
    tree = files.select(*SCOPE, "e.source", "e.target")
    return tree.unionByName(func.select(*SCOPE, F.col("path").alias("source"), names.dot_text("signature").alias("target"))).distinct()


#: Fixed value: the colour of what a revision changed.
CHANGED = "#9cff3c"


def dot(graph_edges: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """(repo_id, rev_hash, part, line): the graph text of each revision, line by line in the order of
    part and line, so that no revision's graph has to be held whole. Nodes named in ``changed``
    (repo_id, rev_hash, target) are filled."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = graph_edges.select(*SCOPE, F.lit(1).alias("part"), F.concat(q("source"), F.lit("->"), q("target"), F.lit(";")).alias("line"))
    if changed is not None:
        line = line.unionByName(changed.select(*SCOPE, F.lit(2).alias("part"), F.concat(q("target"), F.lit(f' [ fillcolor="{CHANGED}", style=filled ];')).alias("line")).distinct())
    ends = graph_edges.select(*SCOPE).distinct().select(*SCOPE, F.inline(F.array(F.struct(F.lit(0).alias("part"), F.lit("digraph G {rankdir=LR;").alias("line")), F.struct(F.lit(3).alias("part"), F.lit("}").alias("line")))))
    return ends.unionByName(line)


def changed_nodes(func: DataFrame, patches_: DataFrame) -> DataFrame:
    """(repo_id, rev_hash, target): the nodes of the files that a revision's patch touches and of the
    functions that hold changed lines. func: functions of each revision; patches: (repo_id, rev_hash,
    path, lines)."""
    key = F.concat_ws("|", *SCOPE)
    hit = patched(func.withColumns({"repo_id": key, "func_id": F.lit(None).cast("bigint")}), patches_.withColumns({"_repo": F.col("repo_id"), "repo_id": key}))
    files = patches_.select(*SCOPE, F.col("path").alias("target"))
    return files.unionByName(hit.filter("signature is not null").select(F.col("_repo").alias("repo_id"), "rev_hash", names.dot_text("signature").alias("target"))).distinct()


def patched(func: DataFrame, lines: DataFrame) -> DataFrame:
    """Functions hit by changed lines: (.., repo_id, path, lines) against functions of that repository
    and path. A changed file without a hit keeps a row."""
    f = func.select(F.col("repo_id").alias("_r"), F.col("path").alias("_p"), "span", "func_id", "signature")
    on = (F.col("repo_id") == F.col("_r")) & (F.col("path") == F.col("_p")) & spans.has_any_line("span", "lines")
    return lines.join(f, on, "left").drop("_r", "_p", "span")
