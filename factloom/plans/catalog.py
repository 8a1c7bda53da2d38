"""Named queries over the fact tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import names, rules, spans
from factloom.operators import chains, dedupe, facts, graph, history, tree
from factloom.runtime import materialize, read_table
from factloom.sources import extract, patches
from factloom.sources import symbols as sym
from factloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SCOPE = ["repo_id", "rev_hash"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: read_table(spark, d, name)


func, clazz, ctx, tag, drop, rev, docs = (_t(n) for n in ("fact_func", "fact_clazz", "rel_funcctx", "func_tag", "func_drop", "rev_info", "documents"))


def upserted(spark: SparkSession, d: str) -> DataFrame:
    return facts.latest(func(spark, d), facts.FUNCTION_KEY, "ingest_ts", "func_id")


_UPSERTED = """(select * exclude (rn) from (select *, row_number() over (partition by repo_id, rev_hash, path, signature, span.start.row, span.end.row
 order by ingest_ts desc nulls last, func_id desc nulls last) rn from fact_func) where rn = 1)"""


# requests for lines of files, made of the log of deletions: one per logged file
def requests(spark: SparkSession, d: str) -> DataFrame:
    line = (F.col("drop_id") % 300).cast("int")
    return drop(spark, d).select(*SCOPE, "path", "drop_id", F.array(line, line + 40).alias("lines"))


_REQUESTS = "(select repo_id, rev_hash, path, drop_id, [cast(drop_id % 300 as int), cast(drop_id % 300 + 40 as int)] as lines from func_drop)"


def _hit(span: str, lines: str) -> str:
    return f"(list_has_any(list_transform({lines}, lambda x: x + 1 between {span}.start.row and {span}.end.row), [true]))"


def _touch(a: str, b: str) -> str:
    return (
        f"(case when {a}.end.row < {b}.start.row or {a}.start.row > {b}.end.row then false when {a}.end.row = {b}.start.row then {a}.end.column >= {b}.start.column "
        f"when {a}.start.row = {b}.end.row then {a}.start.column <= {b}.end.column else {a} is not null and {b} is not null end)"
    )


_SAME_FILE = "f.repo_id = r.repo_id and f.rev_hash = r.rev_hash and f.path = r.path"


# ---- filters on functions ----


@query(f"select func_id, path, signature from {_UPSERTED} f where exists (select 1 from {_REQUESTS} r where {_SAME_FILE})")
def functions_of_file(spark, d):
    return facts.of_files(upserted(spark, d), requests(spark, d)).select("func_id", "path", "signature")


@query(f"select func_id, path, signature from {_UPSERTED} f where exists (select 1 from {_REQUESTS} r where {_SAME_FILE} and {_hit('f.span', 'r.lines')})")
def functions_with_lines(spark, d):
    return facts.with_lines(upserted(spark, d), requests(spark, d)).select("func_id", "path", "signature")


@query("select func_id, name from fact_func where list_has_any(list_transform([100, 101], lambda x: x + 1 between span.start.row and span.end.row), [true])")
def units_by_lines(spark, d):
    return func(spark, d).filter(spans.has_any_line("span", [100, 101])).select("func_id", "name")


@query("select f.func_id, f.name from fact_func f join (select unnest(['render', 'setup', 'render']) n) w on f.name = w.n")
def units_by_names(spark, d):
    return facts.by_names(func(spark, d), ["render", "setup", "render"]).select("func_id", "name")


@query("select f.clazz_id, f.name, f.path from fact_clazz f join (select distinct receiver n from fact_func where receiver is not null) w on f.name = w.n")
def units_by_names_in_files(spark, d):
    wanted = func(spark, d).select("receiver").filter(F.col("receiver").isNotNull()).distinct()
    return facts.by_names(clazz(spark, d), wanted).select("clazz_id", "name", "path")


@query("select func_id, name from fact_func where regexp_matches(coalesce(name, ''), '^(render|emit).*[a-z]$')")
def functions_rule_regex(spark, d):
    return facts.by_rule(func(spark, d), {"name": "^(render|emit).*[a-z]$"}).select("func_id", "name")


@query("select func_id, name from fact_func where regexp_matches(coalesce(lang, ''), 'JAVA') and len(parameters) > 1 and regexp_matches(coalesce(parameters[1].type, ''), '^(int|String)$') and regexp_matches(coalesce(json_extract_string(extras, '$.classInfo.packageName'), ''), '^org\\.')")
def functions_rule_multi(spark, d):
    rule = {"lang": "JAVA", "parameters.#": lambda n: n.try_cast("int") > 1, "parameters.0.type": "^(int|String)$", "extras.classInfo.packageName": r"^org\."}
    return facts.by_rule(func(spark, d), rule).select("func_id", "name")


@query("select signature from fact_func where regexp_matches(coalesce(signature, ''), '\\|String,.*\\|void$')")
def signatures_regex(spark, d):
    return facts.signatures_matching(func(spark, d), r"\|String,.*\|void$")


@query(f"""select repo_id, rev_hash, signature, path, func_id from (select *, row_number() over (partition by repo_id, rev_hash, signature order by path, span.start.row, span.end.row) rn
 from {_UPSERTED} f where exists (select 1 from func_tag t where t.repo_id = f.repo_id and t.rev_hash = f.rev_hash and t.signature = f.signature)) where rn = 1""")
def function_by_signature(spark, d):
    return facts.by_signature(upserted(spark, d), tag(spark, d)).select(*SCOPE, "signature", "path", "func_id")


_TAGS = "(select repo_id, rev_hash, signature, list_sort(list(distinct tag)) tags from func_tag where tag is not null group by all)"


@query(f"select repo_id, rev_hash, signature, array_to_string(tags, ';') as tags from {_TAGS}")
def function_tags(spark, d):
    return facts.tags_of(tag(spark, d)).select(*SCOPE, "signature", F.array_join("tags", ";").alias("tags"))


@query(f"select repo_id, rev_hash, signature from {_TAGS} where list_contains(tags, 'FLAKY')")
def functions_with_tag(spark, d):
    return facts.with_tags(tag(spark, d), "FLAKY")


@query(f"select repo_id, rev_hash, signature from {_TAGS} where list_has_all(tags, ['FLAKY', 'DEPRECATED'])")
def functions_with_all_tags(spark, d):
    return facts.with_tags(tag(spark, d), "FLAKY;DEPRECATED")


@query("select distinct repo_id, rev_hash, signature, 'RENDERS' as tag from fact_func where regexp_matches(coalesce(name, ''), '^render')")
def tag_by_regex(spark, d):
    added = facts.by_rule(func(spark, d), {"name": "^render"}).select(*SCOPE, "signature", F.lit("RENDERS").alias("tag"))
    return facts.with_tags(tag(spark, d).select(*SCOPE, "signature", "tag").unionByName(added), "RENDERS").withColumn("tag", F.lit("RENDERS"))


# ---- classes ----


@query(f"select clazz_id, path, name from fact_clazz f where exists (select 1 from {_REQUESTS} r where {_SAME_FILE})")
def classes_of_file(spark, d):
    return facts.of_files(clazz(spark, d), requests(spark, d)).select("clazz_id", "path", "name")


@query(f"select clazz_id, path, name from fact_clazz f where exists (select 1 from {_REQUESTS} r where {_SAME_FILE} and {_hit('f.span', 'r.lines')})")
def classes_with_lines(spark, d):
    return facts.with_lines(clazz(spark, d), requests(spark, d)).select("clazz_id", "path", "name")


@query("select clazz_id, signature from fact_clazz where regexp_matches(coalesce(json_extract_string(extras, '$.extends'), ''), 'Base$') and regexp_matches(coalesce(module, ''), '^org')")
def classes_rule(spark, d):
    return facts.by_rule(clazz(spark, d), {"extras.extends": "Base$", "module": "^org"}).select("clazz_id", "signature")


# ---- contexts ----

_CTX_FIRST = "(select * exclude (rn) from (select *, row_number() over (partition by repo_id, rev_hash, signature order by path, span.start.row, span.end.row) rn from rel_funcctx c where {where}) where rn = 1)"


def _ctx_once(spark, d):
    return facts.latest(ctx(spark, d), ["ctx_id"], "ingest_ts", "ctx_id")


@query(f"""select repo_id, rev_hash, signature, path from {_CTX_FIRST.format(where=f"exists (select 1 from fact_func f join {_REQUESTS} r on {_SAME_FILE} and {_hit('f.span', 'r.lines')} where f.repo_id = c.repo_id and f.rev_hash = c.rev_hash and f.signature = c.signature)")}""")
def ctx_with_lines(spark, d):
    return facts.context_of_lines(func(spark, d), ctx(spark, d), requests(spark, d)).select(*SCOPE, "signature", "path")


@query("select ctx_id, signature from rel_funcctx where regexp_matches(coalesce(name, ''), 'Cache$|^load') and len(calls) > 0")
def ctx_rule(spark, d):
    return facts.by_rule(ctx(spark, d), {"name": "Cache$|^load", "calls.#": lambda n: n.try_cast("int") > 0}).select("ctx_id", "signature")


@query(f"select repo_id, rev_hash, signature, path from {_CTX_FIRST.format(where='exists (select 1 from func_tag t where t.repo_id = c.repo_id and t.rev_hash = c.rev_hash and t.signature = c.signature)')}")
def ctx_by_signature(spark, d):
    return facts.by_signature(ctx(spark, d), tag(spark, d)).select(*SCOPE, "signature", "path")


@query("select ctx_id, cast(coalesce(len(calls), 0) as int) as n from rel_funcctx where coalesce(len(calls), 0) > 2 and coalesce(len(calls), 0) < 6")
def ref_count(spark, d):
    return facts.reference_count(ctx(spark, d), 2, 6).select("ctx_id", F.size("calls").alias("n"))


@query("select ctx_id, cast(coalesce(len(reverse_calls), 0) as int) as n from rel_funcctx where coalesce(len(reverse_calls), 0) > 2 and coalesce(len(reverse_calls), 0) < 6")
def ref_count_reverse(spark, d):
    return facts.reference_count(ctx(spark, d), 2, 6, "reverse_calls").select("ctx_id", F.size("reverse_calls").alias("n"))


@query("select ctx_id, array_to_string(list_transform(calls, lambda x: coalesce(x, '')), ' ; ') as calls, array_to_string(list_transform(reverse_calls, lambda x: coalesce(x, '')), ' ; ') as reverse_calls from rel_funcctx")
def slim_ctx(spark, d):
    full = lambda c: F.transform(c, lambda s: F.struct(s.alias("signature"), F.lit(1).alias("x")))
    out = facts.slim(ctx(spark, d).withColumns({"calls": full("calls"), "reverse_calls": full("reverse_calls")}))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.coalesce(s, F.lit(""))), " ; ")
    return out.select("ctx_id", text("calls").alias("calls"), text("reverse_calls").alias("reverse_calls"))


# ---- repositories, revisions, files ----


@query("select distinct repo_id from fact_func where repo_id is not null")
def repos(spark, d):
    return facts.repos(func(spark, d))


@query("select repo_id, rev_hash, max(create_time) as create_time from rev_info group by all")
def revs(spark, d):
    return facts.revisions(rev(spark, d))


@query("select r.repo_id, r.rev_hash, r.branch, max(r.create_time) as create_time, strftime(make_timestamp(max(r.create_time) * 1000000), '%Y-%m-%d %H:%M:%S') as created from rev_info r group by r.repo_id, r.rev_hash, r.branch")
def rev_info(spark, d):
    return rev(spark, d).groupBy(*SCOPE, "branch").agg(F.max("create_time").alias("create_time")).withColumn("created", F.date_format(F.timestamp_seconds("create_time"), "yyyy-MM-dd HH:mm:ss"))


@query("select distinct repo_id, rev_hash, path from fact_func")
def files(spark, d):
    return facts.files(func(spark, d))


@query("select distinct repo_id, rev_hash, path from fact_func where regexp_matches(path, '(^|/)src/.*\\.(java|py)$')")
def files_regex(spark, d):
    return facts.files(func(spark, d), r"(^|/)src/.*\.(java|py)$")


@query("select distinct repo_id, path from documents where path is not null and regexp_matches(path, '^(src|pkg)/') and not regexp_matches(path, 'test|min\\.js$')")
def file_filter(spark, d):
    return docs(spark, d).filter(F.col("path").isNotNull() & rules.matches("path", "^(src|pkg)/") & ~rules.matches("path", r"test|min\.js$")).select("repo_id", "path").distinct()


@query(f"select repo_id, rev_hash, count(distinct path) as file_count, count(*) as function_count from {_UPSERTED} group by all")
def rev_stat(spark, d):
    return facts.revision_stat(func(spark, d))


@query(f"select repo_id, lang, count(*) as function_count from {_UPSERTED} group by rollup (repo_id, lang)")
def rev_rollup(spark, d):
    return facts.revision_rollup(func(spark, d))


_LANG = "case when path like '%.java' then 'JAVA' when path like '%.kt' then 'KOTLIN' when path like '%.go' then 'GOLANG' when path like '%.py' then 'PYTHON' when path like '%.js' then 'JAVASCRIPT' end"


@query(f"""select repo_id, coalesce(lang, 'UNKNOWN') as lang, n_files from (select *, row_number() over (partition by repo_id order by n_files desc, k) rn from (
 select repo_id, lang, count(lang) as n_files, case lang when 'JAVA' then 1 when 'GOLANG' then 2 when 'PYTHON' then 3 when 'KOTLIN' then 4 when 'JAVASCRIPT' then 5 else 9 end k
 from (select repo_id, {_LANG} lang from documents where source = 'src_file') group by all)) where rn = 1""")
def guess_lang(spark, d):
    return facts.guess_lang(docs(spark, d).filter(F.col("source") == "src_file"), ["repo_id"])


@query("select code_lang as lang, md5(text) as content_md5, count(*) as n_files from documents where text is not null group by all")
def content_dedupe(spark, d):
    return facts.content_groups(docs(spark, d), "code_lang", "text")


@query(f"select * exclude (parameters, returns, span, body_span, ingest_ts), strftime(ingest_ts, '%Y-%m-%d %H:%M:%S') as came from {_UPSERTED}")
def upsert_latest(spark, d):
    """Rows whole, so they stay where they are read; what asks for a few columns takes ``upserted``."""
    last = dedupe.keep_latest(func(spark, d), facts.FUNCTION_KEY, "ingest_ts", "func_id")
    return last.withColumn("came", F.date_format("ingest_ts", "yyyy-MM-dd HH:mm:ss")).drop("parameters", "returns", "span", "body_span", "ingest_ts")


@query("select func_id from fact_func f where not exists (select 1 from func_drop g where g.repo_id = f.repo_id and g.rev_hash = f.rev_hash)")
def delete_rev(spark, d):
    return facts.delete_revisions(func(spark, d), drop(spark, d)).select("func_id")


# ---- scalar functions ----


@query("select func_id, unnest(range(span.start.row, span.end.row + 1)) as line from fact_func where span is not null")
def span_lines(spark, d):
    return func(spark, d).select("func_id", F.explode(spans.rows("span")).alias("line"))


@query("select func_id, coalesce(cast(def_line as bigint) + 1 between span.start.row and span.end.row, false) as hit, concat(span.start.row, ':', span.start.column, ',', span.end.row, ':', span.end.column) as text from fact_func where span is not null")
def span_contains(spark, d):
    return func(spark, d).filter("span is not null").select("func_id", spans.has_line("span", F.col("def_line")).alias("hit"), spans.text("span").alias("text"))


# each function's body against the span of the next function of its file
_PAIRS = "(select func_id a, lead(func_id) over w b, body_span x, lead(span) over w y from fact_func window w as (partition by repo_id, rev_hash, path order by span.start.row nulls first, func_id, ingest_ts))"


def _pairs(spark, d):
    w = Window.partitionBy(*SCOPE, "path").orderBy(F.col("span.start.row").asc_nulls_first(), "func_id", "ingest_ts")
    f = func(spark, d)
    return f.select(F.col("func_id").alias("a"), F.lead("func_id").over(w).alias("b"), F.col("body_span").alias("x"), F.lead("span").over(w).alias("y")).filter("b is not null")


@query(f"select a, b, coalesce({_touch('x', 'y')}, false) as touching from {_PAIRS} where b is not null")
def span_interaction(spark, d):
    return _pairs(spark, d).select("a", "b", spans.touches("x", "y").alias("touching"))


@query(f"select a, b, coalesce(y.end.row >= x.start.row and y.start.row <= x.end.row, false) as overlapping from {_PAIRS} where b is not null")
def span_rows_overlap(spark, d):
    return _pairs(spark, d).select("a", "b", spans.rows_overlap("x", "y").alias("overlapping"))


_TYPES = "array_to_string(list_transform(coalesce({0}, []), lambda x: coalesce(x.type, '')), ',')"
_SIG = f"concat_ws('|', coalesce(namespace, ''), coalesce(receiver, ''), coalesce(name, ''), coalesce({_TYPES.format('parameters')}, ''), coalesce({_TYPES.format('returns')}, ''))"


@query(f"select func_id, {_SIG} as built, {_SIG} = signature as same from fact_func")
def signature_build(spark, d):
    return func(spark, d).select("func_id", names.signature().alias("built"), (names.signature() == F.col("signature")).alias("same"))


@query("select func_id, concat(coalesce(path, ''), '|,|', span.start.row, ':', span.start.column, ',', span.end.row, ':', span.end.column, '|,|', coalesce(signature, '')) as vertex from fact_func where span is not null")
def vertex_build(spark, d):
    return func(spark, d).filter("span is not null").select("func_id", names.vertex().alias("vertex"))


@query("select clazz_id, concat(coalesce(module, ''), '.', coalesce(name, '')) as built from fact_clazz")
def class_signature_build(spark, d):
    return clazz(spark, d).select("clazz_id", names.class_signature().alias("built"))


@query("select distinct concat(repo_id, '|,,|', rev_hash) as workspace, repo_id as repo_part, rev_hash as rev_part from rev_info where repo_id <> '' and rev_hash <> ''")
def workspace_keys(spark, d):
    keys = rev(spark, d).filter((F.col("repo_id") != "") & (F.col("rev_hash") != "")).select(names.workspace().alias("workspace")).distinct()
    repo, rev_ = names.workspace_parts("workspace")
    return keys.select("workspace", repo.alias("repo_part"), rev_.alias("rev_part"))


@query("select func_id, coalesce(json_extract_string(extras, '$.classInfo.className'), '') as class_name, coalesce(cast(len(parameters) as varchar), '') as n_parameters from fact_func")
def json_paths(spark, d):
    f = func(spark, d)
    return f.select("func_id", rules.field(f, "extras.classInfo.className").alias("class_name"), rules.field(f, "parameters.#").alias("n_parameters"))


@query("select distinct signature, replace(replace(replace(signature, ':', ''), '|', '/'), chr(92), chr(92) || chr(92)) as node from fact_func")
def dot_escape(spark, d):
    return func(spark, d).select("signature", names.dot_text("signature").alias("node")).distinct()


@query("select repo_id, path, dir, dense_rank() over (partition by repo_id order by dir) - 1 as category from (select distinct repo_id, path, case when path like '%/%' then regexp_extract(path, '^(.*)/[^/]*$', 1) else '.' end dir from fact_func)")
def dir_category(spark, d):
    return facts.directory_categories(func(spark, d)).withColumn("category", F.col("category").cast("bigint"))


# ---- graph ----

_GRAPH_FUNCS = """one as (select * exclude (rn) from (select *, row_number() over (partition by func_id order by ingest_ts, rev_hash) rn from fact_func) where rn = 1),
lastrev as (select repo_id, path, rev_hash from (select repo_id, path, rev_hash, row_number() over (partition by repo_id, path order by ingest_ts desc, rev_hash desc) rn from one) where rn = 1),
gf as (select o.* from one o join lastrev l on o.repo_id = l.repo_id and o.path = l.path and o.rev_hash = l.rev_hash)"""
_SYMBOLS = """lines as (select repo_id, path, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as r, doc_id from documents where source = 'src_file' and path is not null and text is not null),
pieces as (select repo_id, path, doc_id, r, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+')) p, generate_subscripts(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+'), 1) k from lines),
placed as (select repo_id, path, r, p, sum(length(p)) over (partition by repo_id, path, doc_id, r order by k) - length(p) as c from pieces),
sy as (select distinct repo_id, path, p as symbol, cast(r as bigint) r, cast(c as bigint) c from placed where regexp_full_match(p, '[A-Za-z_][A-Za-z0-9_]*')),
sp as (select repo_id, path, symbol, r, c, {'start': {'row': r, 'column': c}, 'end': {'row': r, 'column': c + length(symbol)}} span from sy)"""
_INSIDE = f"ins as (select * from sp s where exists (select 1 from gf f where f.repo_id = s.repo_id and f.path = s.path and coalesce({_touch('f.body_span', 's.span')}, false)))"
_KNOWN = """defs as (select repo_id, name, count(*) n_defs from gf where octet_length(encode(name)) >= 4 group by all),
refs as (select repo_id, symbol as name, count(*) n_refs from ins group by all),
known as (select d.repo_id, d.name, n_defs, n_refs from defs d join refs r on d.repo_id = r.repo_id and d.name = r.name where n_defs * n_refs <= 1024)"""
_DESC = "concat(span.start.row, ':', span.start.column, ',', span.end.row, ':', span.end.column, '|,|', coalesce(signature, ''))"
_EDGES = f"""g as (select *, {_DESC} dsc from gf),
rf as (select i.repo_id, i.path, i.symbol as name, i.span, d.func_id callee_id, d.dsc callee_desc from ins i join known k on k.repo_id = i.repo_id and k.name = i.symbol join g d on d.repo_id = i.repo_id and d.name = i.symbol),
cand as (select r.repo_id, r.callee_id, f.func_id caller_id, row_number() over (partition by r.repo_id, r.path, r.name, r.span, r.callee_id order by f.unit_ordinal, f.func_id) rn
 from rf r join g f on f.repo_id = r.repo_id and f.path = r.path and f.body_span is not null and {_touch('f.body_span', 'r.span')} where f.dsc <> r.callee_desc),
edges as (select distinct repo_id, caller_id, callee_id from cand where rn = 1)"""


def graph_functions(spark, d, keep: bool = False) -> DataFrame:
    """Of each file the functions of the revision that came last, copies once, without the columns
    that no graph needs. ``keep`` writes them, for what reads them more than once."""
    narrow = func(spark, d).select(*SCOPE, "path", "func_id", "unit_ordinal", "name", "signature", "span", "body_span", "ingest_ts")
    one = facts.first_by(narrow, ["func_id"], [F.col("ingest_ts"), F.col("rev_hash")])
    last = F.max(F.struct("ingest_ts", "rev_hash")).over(Window.partitionBy("repo_id", "path"))
    out = one.withColumn("_last", last["rev_hash"]).filter("rev_hash = _last and repo_id is not null and path is not null").drop("_last", "ingest_ts")
    return materialize(out, "graph-functions") if keep else out


def graph_tokens(spark, d) -> DataFrame:
    """Identifiers of source files; a file that is there twice gives its own twice."""
    files_ = docs(spark, d).filter((F.col("source") == "src_file") & F.col("path").isNotNull())
    s = sym.identifiers(files_, ["repo_id", "path"])
    return s.select("repo_id", "path", "symbol", spans.make("row", "col", "row", F.col("col") + F.length("symbol")).alias("span"))


def graph_symbols(spark, d) -> DataFrame:
    return graph_tokens(spark, d).distinct()


def graph_edges(spark, d, functions: DataFrame | None = None) -> DataFrame:
    return graph.call_edges(functions or graph_functions(spark, d, True), graph_tokens(spark, d))


@query(f"with {_SYMBOLS} select repo_id, path, symbol, r as row, c as col from sp")
def symbol_tokens(spark, d):
    return graph_symbols(spark, d).select("repo_id", "path", "symbol", F.col("span.start.row").alias("row"), F.col("span.start.column").alias("col"))


@query(f"with {_GRAPH_FUNCS}, {_SYMBOLS}, {_INSIDE} select repo_id, path, symbol, r as row, c as col from ins")
def symbols_in_functions(spark, d):
    return graph.symbols_in_bodies(graph_functions(spark, d), graph_tokens(spark, d)).select("repo_id", "path", "symbol", F.col("span.start.row").alias("row"), F.col("span.start.column").alias("col"))


@query(f"with {_GRAPH_FUNCS}, {_SYMBOLS}, {_INSIDE}, {_KNOWN} select * from known")
def name_refs_limited(spark, d):
    f = graph_functions(spark, d, True)
    return graph.names_within_limit(f, graph.symbols_in_bodies(f, graph_tokens(spark, d)))


_TO_EDGES = f"with {_GRAPH_FUNCS}, {_SYMBOLS}, {_INSIDE}, {_KNOWN}, {_EDGES}"


@query(f"{_TO_EDGES} select * from edges")
def call_edges(spark, d):
    return graph_edges(spark, d)


@query(f"{_TO_EDGES} select repo_id, caller_id as func_id, array_to_string(list_sort(list(distinct callee_id)), ',') as calls from edges group by all")
def calls(spark, d):
    return graph.neighbours(graph_edges(spark, d)).filter(F.size("calls") > 0).select("repo_id", "func_id", F.array_join(F.col("calls").cast("array<string>"), ",").alias("calls"))


@query(f"{_TO_EDGES} select repo_id, callee_id as func_id, array_to_string(list_sort(list(distinct caller_id)), ',') as reverse_calls from edges group by all")
def reverse_calls(spark, d):
    return graph.neighbours(graph_edges(spark, d)).filter(F.size("reverse_calls") > 0).select("repo_id", "func_id", F.array_join(F.col("reverse_calls").cast("array<string>"), ",").alias("reverse_calls"))


@query(
    f"""{_TO_EDGES},
a as (select e.repo_id, e.caller_id func_id, array_to_string(list_sort(list(distinct g.signature)), ' ; ') x from edges e join gf g on g.repo_id = e.repo_id and g.func_id = e.callee_id group by all),
b as (select e.repo_id, e.callee_id func_id, array_to_string(list_sort(list(distinct g.signature)), ' ; ') x from edges e join gf g on g.repo_id = e.repo_id and g.func_id = e.caller_id group by all)
select f.repo_id, f.func_id, f.signature, coalesce(a.x, '') as calls, coalesce(b.x, '') as reverse_calls from gf f left join a on a.repo_id = f.repo_id and a.func_id = f.func_id left join b on b.repo_id = f.repo_id and b.func_id = f.func_id"""
)
def func_context(spark, d):
    f = graph_functions(spark, d, True)
    out = graph.contexts(f, graph_edges(spark, d, f))
    return out.select("repo_id", "func_id", "signature", F.array_join("calls", " ; ").alias("calls"), F.array_join("reverse_calls", " ; ").alias("reverse_calls"))


@query(f"{_TO_EDGES}, n as (select e.repo_id, caller_id, callee_id, a.name source, b.name target from edges e join gf a on a.repo_id = e.repo_id and a.func_id = caller_id join gf b on b.repo_id = e.repo_id and b.func_id = callee_id) select repo_id, caller_id as center_id, source, target from n union select repo_id, callee_id, source, target from n")
def star_graph(spark, d):
    f = graph_functions(spark, d, True)
    return graph.star_edges(f, graph_edges(spark, d, f))


# ---- chains over stored contexts ----

DEPTH = 2


def _walk(column: str, depth: int = DEPTH, starts: str = "func_tag") -> str:
    return f"""with recursive e as (select repo_id, rev_hash, signature node, list_distinct(list_filter({column}, lambda x: x is not null)) nxt from (select *, row_number() over (partition by repo_id, rev_hash, signature order by path, span.start.row, span.end.row, {column}) rn from rel_funcctx where signature is not null) where rn = 1),
w(repo_id, rev_hash, start, node, chain) as (
 select distinct repo_id, rev_hash, signature, signature, cast([] as varchar[]) from {starts}
 union all select repo_id, rev_hash, start, s, list_append(chain, s) from (select w.*, unnest(e.nxt) s from w join e on e.repo_id = w.repo_id and e.rev_hash = w.rev_hash and e.node = w.node where len(w.chain) <= {depth}) where not list_contains(chain, s)),
ends as (select w.repo_id, w.rev_hash, w.start, w.chain from w left join e on e.repo_id = w.repo_id and e.rev_hash = w.rev_hash and e.node = w.node where len(w.chain) > {depth} or e.nxt is null or len(e.nxt) = 0)"""


def _chains(spark, d, reverse=False):
    return chains.chains(ctx(spark, d), tag(spark, d), DEPTH, reverse)


@query(_walk("calls") + " select repo_id, rev_hash, start, array_to_string(chain, ' > ') as chain from ends")
def call_chain(spark, d):
    return _chains(spark, d).select(*SCOPE, "start", F.array_join("chain", " > ").alias("chain"))


@query(_walk("reverse_calls") + " select repo_id, rev_hash, start, array_to_string(chain, ' > ') as chain from ends")
def reverse_chain(spark, d):
    return _chains(spark, d, True).select(*SCOPE, "start", F.array_join("chain", " > ").alias("chain"))


@query(_walk("calls") + ", p as (select repo_id, rev_hash, start, chain, unnest(range(1, len(chain) + 1)) n from ends) select distinct repo_id, rev_hash, start, array_to_string(chain[1:n], ' > ') as chain, cast(n as int) as depth from p")
def chain_prefixes(spark, d):
    return chains.prefixes(_chains(spark, d)).select(*SCOPE, "start", F.array_join("chain", " > ").alias("chain"), "depth")


_CHANGED = f"(select f.repo_id, f.rev_hash, f.signature from fact_func f join {_REQUESTS} r on {_SAME_FILE} and {_hit('f.span', 'r.lines')})"


@query(_walk("reverse_calls", DEPTH, _CHANGED) + " select distinct repo_id, rev_hash, start, chain[-1] as reached from ends where len(chain) > 0")
def diff_impact(spark, d):
    """What calls the functions of changed lines in the end, callers followed to a bounded depth."""
    changed = facts.with_lines(func(spark, d), requests(spark, d)).select(*SCOPE, "signature").distinct()
    up = chains.chains(ctx(spark, d), changed, DEPTH, reverse=True).filter(F.size("chain") > 0)
    return up.select(*SCOPE, "start", F.try_element_at("chain", F.lit(-1)).alias("reached")).distinct()


# ---- changes and history ----


@query(f"select r.repo_id, r.rev_hash, r.path, r.drop_id, f.func_id, f.signature from {_REQUESTS} r left join {_UPSERTED} f on {_SAME_FILE} and {_hit('f.span', 'r.lines')}")
def diff_affected(spark, d):
    asked = requests(spark, d)
    ids = asked.select(*SCOPE, "path", "lines", "drop_id")
    return facts.affected(upserted(spark, d), asked.drop("drop_id").distinct()).join(ids, [*SCOPE, "path", "lines"]).select(*SCOPE, "path", "drop_id", "func_id", "signature")


@query(f"""select r.repo_id, r.rev_hash, r.path, concat(r.lines[1], ',', r.lines[-1]) as lines, f.func_id, f.signature, cast(coalesce(n.c, 0) as int) as reference_count, cast(coalesce(n.r, 0) as int) as referenced_count
 from (select distinct * exclude (drop_id) from {_REQUESTS}) r left join {_UPSERTED} f on {_SAME_FILE} and {_hit('f.span', 'r.lines')}
 left join (select repo_id, rev_hash, signature, max(coalesce(len(calls), 0)) c, max(coalesce(len(reverse_calls), 0)) r from rel_funcctx group by all) n on n.repo_id = f.repo_id and n.rev_hash = f.rev_hash and n.signature = f.signature""")
def thin_diff(spark, d):
    return facts.thin(facts.affected(upserted(spark, d), requests(spark, d).drop("drop_id").distinct()), ctx(spark, d))


@query("select c.repo_id, c.rev_hash, c.path as source, t.target from (select repo_id, rev_hash, path, unnest(calls) s from rel_funcctx) c join (select repo_id, rev_hash, signature, min(path) target from fact_func group by all) t on t.repo_id = c.repo_id and t.rev_hash = c.rev_hash and t.signature = c.s")
def file_links(spark, d):
    return facts.file_links(ctx(spark, d), func(spark, d))


_CHAIN = """o as (select r.repo_id, r.rev_hash, r.branch, row_number() over (partition by r.repo_id, r.branch order by min(r.create_time), r.rev_hash) k
 from rev_info r where exists (select 1 from fact_func f where f.repo_id = r.repo_id and f.rev_hash = r.rev_hash) group by r.repo_id, r.rev_hash, r.branch),
pairs as (select a.repo_id, a.rev_hash from_rev, b.rev_hash to_rev from o a join o b on a.repo_id = b.repo_id and a.branch = b.branch and b.k = a.k + 1),
keys as (select distinct repo_id, rev_hash, path, signature from fact_func)"""


@query(f"with {_CHAIN} select distinct p.repo_id, p.from_rev, p.to_rev, k.path, k.signature from pairs p join keys k on k.repo_id = p.repo_id and k.rev_hash = p.to_rev where not exists (select 1 from keys q where q.repo_id = p.repo_id and q.rev_hash = p.from_rev and q.path = k.path and q.signature = k.signature)")
def version_added(spark, d):
    return history.versions(func(spark, d), rev(spark, d), "added")


@query(f"with {_CHAIN} select distinct p.repo_id, p.from_rev, p.to_rev, k.path, k.signature from pairs p join keys k on k.repo_id = p.repo_id and k.rev_hash = p.from_rev where not exists (select 1 from keys q where q.repo_id = p.repo_id and q.rev_hash = p.to_rev and q.path = k.path and q.signature = k.signature)")
def version_removed(spark, d):
    return history.versions(func(spark, d), rev(spark, d), "removed")


@query(f"""with {_CHAIN}, files as (select repo_id, rev_hash, path, string_agg(signature, chr(10) order by signature) s from keys group by all)
select distinct p.repo_id, p.to_rev as rev_hash, k.path, k.signature, coalesce(a.s = b.s, false) as carried from pairs p join keys k on k.repo_id = p.repo_id and k.rev_hash = p.to_rev
 join files b on b.repo_id = k.repo_id and b.rev_hash = k.rev_hash and b.path = k.path left join files a on a.repo_id = p.repo_id and a.rev_hash = p.from_rev and a.path = k.path""")
def history_snapshot(spark, d):
    return history.snapshots(func(spark, d), rev(spark, d))


@query("""with p as (select distinct repo_id, rev_hash, path, string_split(path, '/') parts from fact_func), n as (select *, unnest(range(1, len(parts) + 1)) k from p)
select distinct repo_id, rev_hash, case when k = 1 then rev_hash else array_to_string(parts[1:k - 1], '/') end as source, array_to_string(parts[1:k], '/') as target from n
union select distinct repo_id, rev_hash, path, replace(replace(replace(signature, ':', ''), '|', '/'), chr(92), chr(92) || chr(92)) from fact_func""")
def history_edges(spark, d):
    return history.edges(func(spark, d))


@query("select annotation, count(*) as n, count(distinct func_id) as n_functions from (select func_id, trim(unnest(cast(json_extract(extras, '$.annotations') as varchar[])), chr(32) || chr(9) || chr(10) || chr(13)) annotation from fact_func where json_type(json_extract(extras, '$.annotations')) = 'ARRAY') where annotation is not null and annotation <> '' group by all")
def annotation_distribution(spark, d):
    return facts.annotation_distribution(func(spark, d))


# lines of a patch with the last hunk's header, the place within the hunk and what of it is used up
_PATCHES = r"""with d as (select doc_id, repo_id, string_split(text, chr(10)) ls from documents where source = 'patch' and text is not null),
l as (select doc_id, repo_id, unnest(ls) line, generate_subscripts(ls, 1) n from d),
h as (select *, regexp_extract(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', ['a', 'b', 'c', 'e']) x, regexp_matches(line, '^@@ -\d+(,\d+)? \+\d+(,\d+)? @@') is_head,
  lag(line) over (partition by doc_id order by n) before from l),
k as (select *, count(*) filter (where is_head) over (partition by doc_id order by n) hunk,
  case when line like 'diff --git %' then coalesce(nullif(regexp_extract(line, '^diff --git .* "?b/(.*?)"?\r?$', 1), ''), chr(0))
       when line like '+++ %' and before like '--- %' then case when regexp_matches(line, '^\+\+\+ /dev/null') then chr(0) else regexp_extract(line, '^\+\+\+ (?:b/)?([^\t\r]*)', 1) end end as named from h),
p as (select *, last_value(named ignore nulls) over (partition by doc_id order by n) path,
  first_value(x) over (partition by doc_id, hunk order by n) hx, case when line = chr(13) then '' else substr(line, 1, 1) end mark,
  sum(case when line like chr(92) || '%' then 0 else 1 end) over (partition by doc_id, hunk order by n) - 2 as idx from k),
s as (select *, if(hx.b = '', 1, cast(hx.b as int)) old_n, if(hx.e = '', 1, cast(hx.e as int)) new_n,
  count(*) filter (where not is_head and mark in ('', ' ', '-')) over (partition by doc_id, hunk order by n) - cast(not is_head and mark in ('', ' ', '-') as int) as old_used,
  count(*) filter (where not is_head and mark in ('', ' ', '+')) over (partition by doc_id, hunk order by n) - cast(not is_head and mark in ('', ' ', '+') as int) as new_used,
  count(*) filter (where not is_head and mark not in ('', ' ', '+', '-', chr(92))) over (partition by doc_id, hunk order by n) as strange from p),
added as (select doc_id, repo_id, path, n, cast(cast(hx.c as int) + idx - 1 as int) as at from s
  where hunk > 0 and not is_head and mark = '+' and strange = 0 and (old_used < old_n or new_used < new_n) and path <> chr(0)),
files as (select distinct doc_id, repo_id, path from s where named is not null and path <> chr(0)),
pl as (select f.doc_id, f.repo_id, f.path, coalesce(list(a.at order by a.n) filter (where a.at is not null), []) as lines from files f left join added a on a.doc_id = f.doc_id and a.path = f.path group by all)"""


@query(_PATCHES + " select doc_id, repo_id, path, array_to_string(lines, ',') as lines from pl")
def patch_lines(spark, d):
    lines = patches.affected_lines(docs(spark, d).filter(F.col("source") == "patch"), ["doc_id", "repo_id"])
    return lines.withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


@query(f"{_PATCHES}, {_GRAPH_FUNCS} select pl.doc_id, pl.repo_id, pl.path, f.func_id, f.signature from pl left join gf f on f.repo_id = pl.repo_id and f.path = pl.path and {_hit('f.span', 'pl.lines')}")
def patch_functions(spark, d):
    lines = patches.affected_lines(docs(spark, d).filter(F.col("source") == "patch"), ["doc_id", "repo_id"])
    return history.patched(graph_functions(spark, d), lines).select("doc_id", "repo_id", "path", "func_id", "signature")


# ---- facts out of source texts ----


def _sources(spark, d) -> DataFrame:
    """Source files with the language that their name tells; code_lang may be wrong or missing."""
    return docs(spark, d).filter((F.col("source") == "src_file") & F.col("path").isNotNull()).withColumn("lang", facts.lang_of_path("path"))


_SOURCE_LINES = f"""with f as (select doc_id, {_LANG} lang, text from documents where source = 'src_file' and path is not null and text is not null),
l as (select doc_id, lang, unnest(string_split(text, chr(10))) line from f where lang is not null)"""
_FUNCTION_LINES = r"""case lang when 'PYTHON' then regexp_extract(line, '^\s*(?:async\s+)?def\s+([\pL\w]+)\s*\(', 1)
 when 'GOLANG' then regexp_extract(line, '^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(', 1)
 when 'KOTLIN' then regexp_extract(line, '^\s*(?:[a-z]+\s+)*fun\s+(?:<[^>]*>\s*)?(\w+)\s*\(', 1) end"""
_CLASS_LINES = r"""case lang when 'PYTHON' then regexp_extract(line, '^\s*class\s+([\pL\w]+)\s*[(:]', 1)
 when 'KOTLIN' then regexp_extract(line, '^\s*(?:[a-z]+\s+)*class\s+(\w+)', 1)
 when 'JAVASCRIPT' then regexp_extract(line, '^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)', 1)
 when 'JAVA' then regexp_extract(line, '^\s*(?:[a-z]+\s+)*(?:class|interface|enum)\s+(\w+)', 1) end"""


@query(f"{_SOURCE_LINES}, m as (select doc_id, lang, {_FUNCTION_LINES} as name from l) select doc_id, lang, name, count(*) as n from m where name <> '' group by all")
def extract_function_names(spark, d):
    """Names of the functions of each file, in the languages whose declarations a line tells."""
    out = extract.extract(_sources(spark, d).filter(F.col("lang").isin("PYTHON", "GOLANG", "KOTLIN")), "func", ["doc_id"]).filter("signature is not null")
    return out.groupBy("doc_id", "lang", "name").agg(F.count("*").alias("n"))


@query(f"{_SOURCE_LINES}, m as (select doc_id, lang, {_CLASS_LINES} as name from l) select doc_id, lang, name, count(*) as n from m where name <> '' group by all")
def extract_class_names(spark, d):
    out = extract.extract(_sources(spark, d).filter("lang <> 'GOLANG'"), "class", ["doc_id"]).filter("signature is not null")
    return out.groupBy("doc_id", "lang", "name").agg(F.count("*").alias("n"))


@query()
def extract_functions(spark, d):
    out = extract.extract(_sources(spark, d), "func", ["doc_id", "path"])
    return out.select("doc_id", "path", "unit_ordinal", "signature", "def_line", spans.text("span").alias("span"), spans.text("body_span").alias("body_span"), "extras", "lang", "error")


@query()
def extract_classes(spark, d):
    return extract.extract(_sources(spark, d), "class", ["doc_id", "path"]).select("doc_id", "path", "signature", spans.text("span").alias("span"), "extras", "lang", "error")


@query()
def extract_symbols(spark, d):
    return extract.extract(_sources(spark, d), "symbol", ["doc_id", "path"]).select("doc_id", "path", "symbol", "kind", "field_name", spans.text("span").alias("span"), "error")


@query()
def extract_calls(spark, d):
    return extract.extract(_sources(spark, d), "call", ["doc_id", "path"]).select("doc_id", "path", "src", "caller", F.array_join("arguments", ",").alias("arguments"), spans.text("span").alias("span"), "error")


@query()
def tree_enclosing(spark, d):
    """The nearest function around every call, by the tree."""
    functions, calls = ["function_declaration", "method_declaration", "method_definition", "function_definition"], ["call_expression", "method_invocation"]
    units = extract.extract(_sources(spark, d), "unit", ["doc_id"], columns=["unit_id", "last_descendant_id", "depth", "kind"], kinds=[*functions, *calls]).filter("error is null")
    # read by both sides of the search, so that files are parsed once
    units = materialize(units.drop("error"), "units")
    up = tree.TreeQuery(units, ["doc_id"]).up().kind(*functions)
    return up.first(units.filter(tree.match(calls))).select("doc_id", "start_id", "unit_id", "kind")


# ---- event time, which the reference lacks ----


@query("select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n from events where ts is not null group by all")
def event_windows(spark, d):
    out = ingest.event_windows(read_table(spark, d, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events where ts is not null),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) k from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, count(*) as n from s group by user_id, k""")
def event_sessions(spark, d):
    out = ingest.sessions(read_table(spark, d, "events"))
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
