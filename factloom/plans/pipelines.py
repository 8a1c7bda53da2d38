"""Queries that run the store, the ingest and the tree searches end to end, beside their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.api import Engine
from factloom.functions import names
from factloom.operators import facts, tree
from factloom.runtime import read_table, scratch, stream_table
from factloom.sources import extract
from factloom.store import SEQ
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


# ---- streaming ingest of the upload messages into a store ----


def _ingested(spark: SparkSession, d: str, topic: str) -> tuple[Engine, str]:
    """All messages of a topic, streamed from the table's files into a store of its own."""
    base = scratch(spark, f"ingest-{topic}")
    raw = stream_table(spark, d, "upload_msg").filter((F.col("topic") == topic) & F.col("payload").isNotNull())
    stream = raw.select(F.col("payload").alias("value"), F.lpad(F.col("delivery_id").cast("string"), 20, "0").alias("came"))
    engine = Engine(spark, f"{base}/store")
    ingest.start(stream, engine.store, topic, f"{base}/checkpoint", f"{base}/dead").awaitTermination()
    return engine, base


_MESSAGES = """with m as (select delivery_id, topic, payload, case when json_valid(payload) then cast(payload as json) end j from upload_msg where payload is not null),
g as (select *, json_extract_string(j, '$.workspace.repoId') repo_id, json_extract_string(j, '$.workspace.revHash') rev_hash, json_extract(j, case topic when 'func' then '$.funcResult' else '$.clazzFileResult' end) r from m),
good as (select * from g where coalesce(repo_id, '') <> '' and coalesce(rev_hash, '') <> '' and json_type(r) = 'OBJECT'),
u as (select delivery_id, topic, repo_id, rev_hash, json_extract_string(r, '$.path') path, unnest(cast(json_extract(r, '$.units') as json[])) u, generate_subscripts(cast(json_extract(r, '$.units') as json[]), 1) k
  from good where json_type(json_extract(r, '$.units')) = 'ARRAY'),
x as (select *, json_extract_string(u, '$.name') as name, case when json_type(u, '$.span.start.row') in ('BIGINT', 'UBIGINT') then cast(json_extract(u, '$.span.start.row') as bigint) end as a,
  case when json_type(u, '$.span.end.row') in ('BIGINT', 'UBIGINT') then cast(json_extract(u, '$.span.end.row') as bigint) end as b from u where json_type(u) = 'OBJECT')"""
_LIST = "case when json_type(u, '$.{0}') = 'ARRAY' then coalesce(array_to_string(list_transform(cast(json_extract(u, '$.{0}') as json[]), lambda v: coalesce(json_extract_string(v, '$.type'), '')), ','), '') else '' end"
_LATEST = "row_number() over (partition by repo_id, rev_hash, path, signature, a, b order by delivery_id desc, k desc) rn"


@query(
    _MESSAGES
    + f""", s as (select *, concat_ws('|', coalesce(json_extract_string(u, '$.namespace'), ''), coalesce(json_extract_string(u, '$.receiver'), ''), coalesce(name, ''), {_LIST.format('parameters')}, {_LIST.format('returns')}) as signature from x where topic = 'func')
select repo_id, rev_hash, path, name, signature, start_row, end_row, lang from (select repo_id, rev_hash, path, name, signature, a as start_row, b as end_row, json_extract_string(u, '$.lang') as lang, {_LATEST} from s) where rn = 1"""
)
def ingest_functions(spark, d):
    engine, _ = _ingested(spark, d, "func")
    return engine.store.read("fact_func").select(*SCOPE, "path", "name", "signature", F.col("span.start.row").alias("start_row"), F.col("span.end.row").alias("end_row"), "lang")


@query(
    _MESSAGES
    + f""", s as (select *, concat(coalesce(json_extract_string(u, '$.module'), ''), '.', coalesce(name, '')) as signature from x where topic = 'clazz')
select repo_id, rev_hash, path, name, signature, start_row, end_row from (select repo_id, rev_hash, path, name, signature, a as start_row, b as end_row, {_LATEST} from s) where rn = 1"""
)
def ingest_classes(spark, d):
    engine, _ = _ingested(spark, d, "clazz")
    return engine.store.read("fact_clazz").select(*SCOPE, "path", "name", "signature", F.col("span.start.row").alias("start_row"), F.col("span.end.row").alias("end_row"))


@query(_MESSAGES + " select topic, count(*) as n from g where (topic, delivery_id) not in (select topic, delivery_id from good) group by topic")
def ingest_dead_letters(spark, d):
    out = None
    for topic in ("func", "clazz"):
        _, base = _ingested(spark, d, topic)
        # lines of a payload make several rows of a text file, so whole ones are counted as they were written
        n = spark.read.schema("value string, batch int").json(f"{base}/dead/{topic}").select(F.lit(topic).alias("topic"))
        out = n if out is None else out.unionByName(n)
    return out.groupBy("topic").agg(F.count("*").alias("n"))


@query(_MESSAGES + " select distinct repo_id, rev_hash from good where topic = 'func'")
def ingest_revisions(spark, d):
    engine, _ = _ingested(spark, d, "func")
    return engine.store.read("rev_info").select(*SCOPE)


# ---- the store ----


def _stored(spark: SparkSession, d: str) -> Engine:
    """All facts written to a store of their own, later ones after earlier ones."""
    engine = Engine(spark, scratch(spark, "store"))
    whole = lambda t, id_: read_table(spark, d, t).withColumn(SEQ, F.lpad(F.col(id_).cast("string"), 20, "0"))
    engine.upload_functions(whole("fact_func", "func_id"))
    engine.upload_classes(whole("fact_clazz", "clazz_id"))
    engine.upload_contexts(whole("rel_funcctx", "ctx_id"))
    engine.store.write("func_tag", read_table(spark, d, "func_tag").select(*SCOPE, "signature", "tag", "ingest_ts"))
    engine.store.write("rev_info", read_table(spark, d, "rev_info").select(*SCOPE, "create_time", "extras"))
    return engine


def _last(table: str, id_: str) -> str:
    key = "repo_id, rev_hash, path, signature, span.start.row, span.end.row"
    return f"(select * exclude (rn) from (select *, row_number() over (partition by {key} order by ingest_ts desc nulls last, {id_} desc) rn from {table} where repo_id <> '' and rev_hash <> '') where rn = 1)"


@query(f"select func_id, repo_id, rev_hash, path, signature from {_last('fact_func', 'func_id')}")
def store_functions(spark, d):
    return _stored(spark, d).store.read("fact_func").select("func_id", *SCOPE, "path", "signature")


@query(f"select clazz_id, repo_id, rev_hash, path, signature from {_last('fact_clazz', 'clazz_id')}")
def store_classes(spark, d):
    return _stored(spark, d).store.read("fact_clazz").select("clazz_id", *SCOPE, "path", "signature")


@query(f"select ctx_id, repo_id, rev_hash, signature, cast(coalesce(len(calls), -1) as int) as n_calls from {_last('rel_funcctx', 'ctx_id')}")
def store_contexts(spark, d):
    return _stored(spark, d).store.read("rel_funcctx").select("ctx_id", *SCOPE, "signature", F.coalesce(F.when(F.col("calls").isNotNull(), F.size("calls")), F.lit(-1)).alias("n_calls"))


@query("select repo_id, rev_hash, max(create_time) as create_time from rev_info where repo_id <> '' and rev_hash <> '' group by all")
def store_revisions(spark, d):
    return _stored(spark, d).store.read("rev_info").select(*SCOPE, "create_time")


@query(
    f"""select f.func_id, array_to_string(list_sort(t.tags), ';') as tags from {_last('fact_func', 'func_id')} f
 join (select repo_id, rev_hash, signature, list(distinct tag) tags from func_tag where tag is not null group by all) t on t.repo_id = f.repo_id and t.rev_hash = f.rev_hash and t.signature = f.signature"""
)
def store_tagged(spark, d):
    return _stored(spark, d).store.functions_with_tags().filter(F.size("tags") > 0).select("func_id", F.array_join("tags", ";").alias("tags"))


_FIRST_REPO = "(select min(repo_id) r from fact_func where repo_id <> '')"
_FIRST_REV = "(select min(struct_pack(a := repo_id, b := rev_hash)) x from fact_func where repo_id <> '' and rev_hash <> '')"


@query(f"select func_id, repo_id, rev_hash from {_last('fact_func', 'func_id')} where (repo_id, rev_hash) <> (select (x.a, x.b) from {_FIRST_REV})")
def store_without_revision(spark, d):
    """What is left after the first revision was deleted."""
    engine = _stored(spark, d)
    first = read_table(spark, d, "fact_func").filter("repo_id <> '' and rev_hash <> ''").agg(F.min(F.struct("repo_id", "rev_hash")).alias("x")).first()["x"]
    engine.delete_rev(first["repo_id"], first["rev_hash"])
    return engine.store.read("fact_func").select("func_id", *SCOPE)


@query(f"select clazz_id, repo_id, rev_hash from {_last('fact_clazz', 'clazz_id')} where repo_id <> (select r from {_FIRST_REPO})")
def store_without_repository(spark, d):
    """What is left after the first repository was deleted."""
    engine = _stored(spark, d)
    engine.delete_repo(read_table(spark, d, "fact_func").filter("repo_id <> ''").agg(F.min("repo_id")).first()[0])
    return engine.store.read("fact_clazz").select("clazz_id", *SCOPE)


@query("select repo_id, rev_hash, create_time, cast(row_number() over (partition by repo_id order by create_time desc, rev_hash) as int) as rank from (select repo_id, rev_hash, max(create_time) create_time from rev_info group by all)")
def revs_newest_first(spark, d):
    once = facts.revisions(read_table(spark, d, "rev_info"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.col("create_time").desc(), "rev_hash")))


@query("select distinct path, case when path like 'src/%' then substr(path, 5) when path = 'src' then '.' else replace(path, chr(92), '/') end as relative from documents where path is not null")
def relative_paths(spark, d):
    return read_table(spark, d, "documents").filter("path is not null").select("path", names.relative_path("path", "src").alias("relative")).distinct()


@query("select distinct path, case when path like '%.java' then 'JAVA' when path like '%.kt' then 'KOTLIN' when path like '%.go' then 'GOLANG' when path like '%.py' then 'PYTHON' when path like '%.js' then 'JAVASCRIPT' end as lang from documents where path is not null")
def langs_of_paths(spark, d):
    return read_table(spark, d, "documents").filter("path is not null").select("path", facts.lang_of_path("path").alias("lang")).distinct()


# ---- searches in trees: regions hold nations, nations hold customers ----


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """(region, unit_id, parent_id, last_descendant_id, depth, kind, field_name) in pre-order."""
    region, nation, customer = (read_table(spark, d, t) for t in ("region", "nation", "customer"))
    n = nation.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    c = n.join(customer, F.col("c_nationkey") == F.col("nation")).select("region", "nation", F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("field_name"))
    none = lambda t: F.lit(None).cast(t)
    nodes = (
        region.select(F.col("r_regionkey").alias("region"), none("int").alias("nation"), none("bigint").alias("customer"), F.lit(0).alias("depth"), F.lit("region").alias("kind"), F.lit("").alias("field_name"))
        .unionByName(n.select("region", "nation", none("bigint").alias("customer"), F.lit(1).alias("depth"), F.lit("nation").alias("kind"), F.lit("").alias("field_name")))
        .unionByName(c.select("region", "nation", "customer", F.lit(2).alias("depth"), F.lit("customer").alias("kind"), "field_name"))
    )
    w = Window.partitionBy("region").orderBy(F.col("nation").asc_nulls_first(), F.col("customer").asc_nulls_first())
    numbered = nodes.withColumn("unit_id", F.row_number().over(w).cast("bigint") - 1)
    parent = F.when(F.col("depth") == 1, F.lit(0).cast("bigint")).when(F.col("depth") == 2, F.max(F.when(F.col("depth") == 1, F.col("unit_id"))).over(Window.partitionBy("region", "nation")))
    last = F.when(F.col("depth") == 0, F.max("unit_id").over(Window.partitionBy("region"))).when(F.col("depth") == 1, F.max("unit_id").over(Window.partitionBy("region", "nation"))).otherwise(F.col("unit_id"))
    return numbered.select("region", "unit_id", parent.alias("parent_id"), last.alias("last_descendant_id"), "depth", "kind", "field_name")


_TREE = """with nodes as (select r_regionkey region, cast(null as int) nation, cast(null as bigint) customer, 0 depth, 'region' kind, '' field_name from region
 union all select n_regionkey, n_nationkey, null, 1, 'nation', '' from nation union all select n_regionkey, n_nationkey, c_custkey, 2, 'customer', c_mktsegment from customer join nation on c_nationkey = n_nationkey),
t as (select *, row_number() over (partition by region order by nation nulls first, customer nulls first) - 1 as unit_id from nodes),
up as (select s.region, s.unit_id start_id, a.unit_id, a.kind, a.field_name, a.depth from t s join t a on a.region = s.region and (a.depth = 0 or a.nation = s.nation and (a.depth = 1 or a.customer = s.customer)))"""


@query(_TREE + " select region, start_id, unit_id from up where kind = 'nation' and start_id in (select unit_id from t c where c.region = up.region and c.kind = 'customer')")
def tree_nearest_ancestor(spark, d):
    units = _tree(spark, d)
    return tree.TreeQuery(units, ["region"]).up().kind("nation").first(units.filter("kind = 'customer'")).select("region", "start_id", "unit_id")


@query(_TREE + " select region, start_id, unit_id, kind from up")
def tree_all_ancestors(spark, d):
    units = _tree(spark, d)
    return tree.TreeQuery(units, ["region"]).up().all(units).select("region", "start_id", "unit_id", "kind")


_BELOW = " select region, unit_id start_id, {0} unit_id from up u where (region, unit_id) in (select region, unit_id from t where kind = '{1}') and (region, start_id) in (select region, unit_id from t where field_name = 'BUILDING') group by region, unit_id"


@query(_TREE + " select u.region, u.unit_id start_id, u.start_id as unit_id from up u join t a on a.region = u.region and a.unit_id = u.unit_id join t b on b.region = u.region and b.unit_id = u.start_id where a.kind = 'nation' and b.field_name = 'BUILDING'")
def tree_all_of_field(spark, d):
    units = _tree(spark, d)
    return tree.TreeQuery(units, ["region"]).down().of_field("BUILDING").all(units.filter("kind = 'nation'")).select("region", "start_id", "unit_id")


@query(_TREE + _BELOW.format("min(start_id)", "region"))
def tree_first_depth_first(spark, d):
    units = _tree(spark, d)
    return tree.TreeQuery(units, ["region"]).down().dfs().of_field("BUILDING").first(units.filter("kind = 'region'")).select("region", "start_id", "unit_id")


@query(_TREE + " select region, 0 as start_id, min(unit_id) as unit_id from t where kind = 'nation' group by region")
def tree_first_breadth_first(spark, d):
    units = _tree(spark, d)
    return tree.TreeQuery(units, ["region"]).bfs().kind("nation", "customer").first(units.filter("kind = 'region'")).select("region", "start_id", "unit_id")


@query(_TREE + " select c.region, p.unit_id as start_id, c.unit_id from t c join t p on p.region = c.region and p.depth = c.depth - 1 and (p.depth = 0 or p.nation = c.nation) where c.kind in ('nation', 'customer') and c.field_name in ('', 'MACHINERY')")
def tree_children(spark, d):
    units = _tree(spark, d)
    return tree.children(units, units, ["region"], ["nation", "customer"], ["", "MACHINERY"]).select("region", "start_id", "unit_id")


# ---- around the ingest and the extraction ----


@query("select topic, count(*) as rows_taken from upload_msg where payload is not null and topic in ('func', 'clazz') group by topic")
def ingest_gauges(spark, d):
    """How many messages each topic's job took in, as its own progress reports say."""
    taken = []
    for topic in ("func", "clazz"):
        base = scratch(spark, f"gauge-{topic}")
        stream = stream_table(spark, d, "upload_msg").filter((F.col("topic") == topic) & F.col("payload").isNotNull()).select(F.col("payload").alias("value"))
        # rows are counted behind the filter, by the stream itself
        seen = stream.observe("taken", F.count(F.lit(1)).alias("n"))
        q = ingest.start(seen, Engine(spark, f"{base}/store").store, topic, f"{base}/checkpoint", f"{base}/dead")
        q.awaitTermination()
        taken.append((topic, ingest.taken(q)))
    return spark.createDataFrame(taken, "topic string, rows_taken bigint")


_SOURCE = """with f as (select doc_id, path, text from documents where source = 'src_file' and path is not null and text is not null),
l as (select doc_id, path, unnest(string_split(text, chr(10))) line from f)"""


@query(
    _SOURCE
    + r""", m as (select doc_id, regexp_extract(line, '^\s*((?:[a-z]+\s+)*)class\s+(\w+)', ['mods', 'name']) x from l where path like '%.java')
select doc_id, x.name as name, array_to_string(regexp_split_to_array(trim(x.mods), '\s+'), ' ') as modifiers, count(*) as n from m where x.name <> '' group by all"""
)
def java_class_modifiers(spark, d):
    docs = read_table(spark, d, "documents").filter("source = 'src_file' and path like '%.java'").withColumn("lang", F.lit("JAVA"))
    out = extract.extract(docs, "class", ["doc_id", "path", "text"]).filter("signature is not null")
    mods = F.coalesce(F.array_join(F.from_json("extras", "modifiers array<string>")["modifiers"], " "), F.lit(""))
    # enums and interfaces have none of their own words here
    plain = out.filter(F.expr(r"text rlike concat('class\\s+', name, '\\b')"))
    return plain.groupBy("doc_id", "name", mods.alias("modifiers")).agg(F.count("*").alias("n"))


@query(_SOURCE + r" select doc_id, count(*) as n from l where path like '%.go' and regexp_matches(line, '^\s*return\b') group by doc_id")
def tree_return_statements(spark, d):
    """Return statements of Go files, found by their kind in the trees."""
    docs = read_table(spark, d, "documents").filter("source = 'src_file' and path like '%.go'").withColumn("lang", F.lit("GOLANG"))
    units = extract.extract(docs, "unit", ["doc_id"]).filter("error is null")
    return units.filter(tree.match(["return_statement"])).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("select func_id, signature as before, signature as after from fact_func where signature is not null")
def function_json_round_trip(spark, d):
    """Functions written as upload messages and decoded again keep what makes their signature."""
    f = read_table(spark, d, "fact_func").filter("signature is not null")
    unit = F.struct("name", "receiver", "namespace", "parameters", "returns", F.col("def_line").alias("defLine"), "span", F.col("body_span").alias("bodySpan"), "extras", "lang")
    work = F.struct(F.lit("r").alias("repoId"), F.lit("v").alias("revHash"))
    # the id and the old signature ride on the path
    message = F.struct(work.alias("workspace"), F.struct(F.concat_ws("\n", "func_id", "signature").alias("path"), F.array(unit).alias("units")).alias("funcResult"))
    good, _ = ingest.decode(f.select(F.to_json(message).alias("value")), "func")
    back = ingest.rows(good, "func")
    parts = F.split("path", "\n")
    return back.select(parts[0].cast("bigint").alias("func_id"), parts[1].alias("before"), F.col("signature").alias("after"))
