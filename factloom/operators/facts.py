"""Queries on the tables of facts: by file, line, name, rule, signature, tag and count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import rules, spans
from factloom.functions.lists import json_list, stripped

SCOPE = ("repo_id", "rev_hash")
FUNCTION_KEY = (*SCOPE, "path", "signature", "span.start.row", "span.end.row")


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. Groups are cut down before the shuffle (window group limit)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*(F.col(k) for k in key)).orderBy(*order))).filter("_rn = 1").drop("_rn")


def latest(df: DataFrame, key: Sequence[str], at: str, tie: str) -> DataFrame:
    """Upsert as a view: of rows with the same key the one that came last, ties to the larger id."""
    return first_by(df, key, [F.col(at).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def in_scope(df: DataFrame, repo_id: str | None = None, rev_hash: str | None = None, path: str | None = None) -> DataFrame:
    for c, v in (("repo_id", repo_id), ("rev_hash", rev_hash), ("path", path)):
        df = df if v is None else df.filter(F.col(c) == v)
    return df


def of_files(df: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of any of the files (repo_id, rev_hash, path); repeated files count once."""
    return df.join(files.select(*SCOPE, "path"), [*SCOPE, "path"], "left_semi")


def with_lines(df: DataFrame, requests: DataFrame, span: str = "span") -> DataFrame:
    """Rows whose span holds any requested line: requests are (repo_id, rev_hash, path, lines).

    The files are equal in the join, the lines a condition on top, so it is a hash or merge join.
    """
    asked = requests.select(*(F.col(c).alias(f"_{c}") for c in (*SCOPE, "path")), F.col("lines").alias("_lines"))
    same = [F.col(c) == F.col(f"_{c}") for c in (*SCOPE, "path")]
    return df.join(asked, same[0] & same[1] & same[2] & spans.has_any_line(span, "_lines"), "left_semi")


def by_names(df: DataFrame, names: DataFrame | Sequence[str], column: str = "name") -> DataFrame:
    """Rows by exact name; a name asked for twice gives its rows twice."""
    if not isinstance(names, DataFrame):
        names = df.sparkSession.createDataFrame([(n,) for n in names], "_name string")
    names = names.toDF("_name")
    return df.join(names, F.col(column) == F.col("_name")).drop("_name")


def by_rule(df: DataFrame, rule: rules.Rule) -> DataFrame:
    return df.filter(rules.condition(df, rule))


def signatures_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.filter(rules.matches("signature", pattern)).select("signature")


def by_signature(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (repo_id, rev_hash, signature) its row; of several that with the smallest
    path and start row."""
    hit = df.join(wanted.select(*SCOPE, "signature"), [*SCOPE, "signature"], "left_semi")
    return first_by(hit, [*SCOPE, "signature"], [F.col("path"), F.col("span.start.row"), F.col("span.end.row")])


def tags_of(tags: DataFrame) -> DataFrame:
    """(repo_id, rev_hash, signature, tags): tags are a set, whatever was added how often."""
    return tags.filter(F.col("tag").isNotNull()).groupBy(*SCOPE, "signature").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def with_tags(tags: DataFrame, wanted: str) -> DataFrame:
    """Signatures that have all tags of a ``;`` list."""
    asked = F.array(*(F.lit(t) for t in dict.fromkeys(wanted.split(";"))))
    return tags_of(tags).filter(F.size(F.array_except(asked, "tags")) == 0).select(*SCOPE, "signature")


def reference_count(ctx: DataFrame, more_than: int, less_than: int, column: str = "calls") -> DataFrame:
    """Contexts by the length of a list, both bounds left out; a null list has none."""
    n = F.coalesce(F.size(column), F.lit(0))
    return ctx.filter((F.coalesce(F.when(F.col(column).isNotNull(), n), F.lit(0)) > more_than) & (F.coalesce(F.when(F.col(column).isNotNull(), n), F.lit(0)) < less_than))


def repos(df: DataFrame) -> DataFrame:
    return df.select("repo_id").filter(F.col("repo_id").isNotNull()).distinct()


def revisions(rev: DataFrame, repo_id: str | None = None) -> DataFrame:
    """Revisions of a repository, newest first; one registered twice counts with its last time."""
    once = in_scope(rev, repo_id).groupBy(*SCOPE).agg(F.max("create_time").alias("create_time"))
    return once.orderBy(F.col("create_time").desc(), "rev_hash")


def files(df: DataFrame, pattern: str | None = None) -> DataFrame:
    out = df.select(*SCOPE, "path").distinct()
    return out.filter(rules.matches("path", pattern)) if pattern else out


def revision_stat(df: DataFrame) -> DataFrame:
    """Files and functions per revision, after upserts; equal signatures in two files are two."""
    return latest(df, FUNCTION_KEY, "ingest_ts", "func_id").groupBy(*SCOPE).agg(F.count_distinct("path").alias("file_count"), F.count("*").alias("function_count"))


def revision_rollup(df: DataFrame) -> DataFrame:
    return latest(df, FUNCTION_KEY, "ingest_ts", "func_id").rollup("repo_id", "lang").agg(F.count("*").alias("function_count"))


def slim(ctx: DataFrame) -> DataFrame:
    """A context with full neighbours reduced to their signatures."""
    only = lambda c: F.transform(c, lambda x: x["signature"]) if "struct" in ctx.schema[c].dataType.simpleString() else F.col(c)
    return ctx.withColumns({"calls": only("calls"), "reverse_calls": only("reverse_calls")})


def context_of_lines(func: DataFrame, ctx: DataFrame, requests: DataFrame) -> DataFrame:
    """Contexts of the functions that hold requested lines."""
    hit = with_lines(func, requests).select(*SCOPE, "signature").distinct()
    return by_signature(ctx, hit)


def affected(func: DataFrame, requests: DataFrame) -> DataFrame:
    """Functions per changed file; a file without a hit keeps a row with none."""
    f = func.select(*(F.col(c).alias(f"_{c}") for c in (*SCOPE, "path")), "span", F.col("signature").alias("_signature"), F.col("func_id").alias("_func_id"))
    on = spans.has_any_line("span", "lines")
    for c in (*SCOPE, "path"):
        on &= F.col(c) == F.col(f"_{c}")
    return requests.select(*SCOPE, "path", "lines").join(f, on, "left").select(*SCOPE, "path", "lines", F.col("_func_id").alias("func_id"), F.col("_signature").alias("signature"))


def thin(fragments: DataFrame, ctx: DataFrame) -> DataFrame:
    """Changed files with their first and last line and, per function, its numbers of callers and callees."""
    n = ctx.groupBy(*SCOPE, "signature").agg(F.max(F.coalesce(F.size("calls"), F.lit(0))).alias("_c"), F.max(F.coalesce(F.size("reverse_calls"), F.lit(0))).alias("_r"))
    ends = F.when(F.size("lines") > 0, F.array(F.element_at("lines", 1), F.element_at("lines", -1)))
    some = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    return fragments.join(n, [*SCOPE, "signature"], "left").select(*SCOPE, "path", F.array_join(ends.cast("array<string>"), ",").alias("lines"), "func_id", "signature", some(F.col("_c")).alias("reference_count"), some(F.col("_r")).alias("referenced_count"))


def delete_revisions(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows without those of deleted revisions, matched exactly."""
    return df.join(gone.select(*SCOPE).distinct(), list(SCOPE), "left_anti")


def file_links(ctx: DataFrame, func: DataFrame) -> DataFrame:
    """Links between files by calls: one per call, to the file of the called signature's function
    (of several the first by path and row). Calls of unknown signatures give none."""
    calls = ctx.select(*SCOPE, F.col("path").alias("source"), F.explode(F.filter("calls", lambda s: s.isNotNull())).alias("signature"))
    home = func.groupBy(*SCOPE, "signature").agg(F.min_by("path", F.struct("path", "span.start.row")).alias("target"))
    return calls.join(home, [*SCOPE, "signature"]).select(*SCOPE, "source", "target")


def directory_categories(paths: DataFrame) -> DataFrame:
    """A dense index of each file's folder within its repository, in order of the folders' names."""
    from factloom.functions.names import directory

    dirs = paths.select("repo_id", "path").distinct().withColumn("dir", directory("path"))
    index = dirs.select("repo_id", "dir").distinct().withColumn("category", F.dense_rank().over(Window.partitionBy("repo_id").orderBy("dir")) - 1)
    return dirs.join(index, ["repo_id", "dir"])


LANG_ORDER = ("JAVA", "GOLANG", "PYTHON", "KOTLIN", "JAVASCRIPT")
SUFFIXES = {".java": "JAVA", ".kt": "KOTLIN", ".go": "GOLANG", ".py": "PYTHON", ".js": "JAVASCRIPT"}


def lang_of_path(path: str | Column) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    out = F
    for suffix, lang in SUFFIXES.items():
        out = out.when(path.endswith(suffix), lang)
    return out


def guess_lang(paths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The language with most files; ties go to the order of LANG_ORDER, no file to UNKNOWN."""
    rank = F.array_position(F.array(*(F.lit(x) for x in LANG_ORDER)), F.col("lang"))
    counts = paths.select(*by, lang_of_path("path").alias("lang")).groupBy(*by, "lang").agg(F.count("lang").alias("n"))
    best = F.max_by("lang", F.struct(F.col("n"), -F.coalesce(rank, F.lit(99))))
    return counts.groupBy(*by).agg(F.coalesce(best, F.lit("UNKNOWN")).alias("lang"), F.max("n").alias("n_files"))


def content_groups(files_: DataFrame, lang: str, content: str) -> DataFrame:
    """Distinct (language, content) to parse once, with how many files share it."""
    return files_.filter(F.col(content).isNotNull()).groupBy(F.col(lang).alias("lang"), F.md5(content).alias("content_md5")).agg(F.count("*").alias("n_files"))


def annotation_distribution(func: DataFrame) -> DataFrame:
    """How often each annotation occurs, and on how many functions."""
    each = func.filter(F.col("extras").contains("annotations")).select("func_id", F.explode(stripped(json_list("extras", "$.annotations"))).alias("annotation"))
    return each.filter(F.col("annotation") != "").groupBy("annotation").agg(F.count("*").alias("n"), F.count_distinct("func_id").alias("n_functions"))
