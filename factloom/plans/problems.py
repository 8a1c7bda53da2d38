"""Queries on the data-processing problems of the code-fact tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import dedupe, orphans, salted, snapshots, uploads
from factloom.runtime import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- 1: nested records ----

_UNITS = """
with m as (select delivery_id, cast(payload as json) j from upload_msg where payload is not null and json_valid(payload)),
r as (select delivery_id, 'func' kind, json_extract(j, '$.funcResult.units') us from m
      union all select delivery_id, 'clazz', json_extract(j, '$.clazzFileResult.units') from m),
l as (select delivery_id, kind, case when json_type(us) = 'ARRAY' then cast(us as json[]) else [us] end us
      from r where us is not null and json_type(us) <> 'NULL'),
n as (select delivery_id, kind, unnest(us) u, generate_subscripts(us, 1) - 1 as unit_pos from l),
u as (select delivery_id, kind, cast(unit_pos as int) unit_pos, u,
        case when json_type(json_extract(u, '$.extras')) = 'VARCHAR'
             then case when json_valid(json_extract_string(u, '$.extras')) then cast(json_extract_string(u, '$.extras') as json) end
             else json_extract(u, '$.extras') end e
      from n where u is not null and json_type(u) <> 'NULL')"""

_LISTS = (
    _UNITS
    + """,
c as (select delivery_id, unit_pos, 'modifier' child, json_extract(e, '$.modifiers') v from u
      union all select delivery_id, unit_pos, 'interface', json_extract(e, '$.implements') from u
      union all select delivery_id, unit_pos, 'parameter' child, json_extract(u, '$.parameters') v from u
      union all select delivery_id, unit_pos, 'return', json_extract(u, '$.returns') from u
      union all select delivery_id, unit_pos, 'annotation', json_extract(e, '$.annotations') from u
      union all select delivery_id, unit_pos, 'decorator', json_extract(e, '$.decorators') from u
      union all select delivery_id, unit_pos, 'field', json_extract(e, '$.fields') from u
      union all select delivery_id, unit_pos, 'class_annotation', json_extract(e, '$.classInfo.annotations') from u),
d as (select delivery_id, unit_pos, child, case when json_type(v) = 'ARRAY' then cast(v as json[]) else [v] end vs
      from c where v is not null and json_type(v) <> 'NULL'),
x as (select delivery_id, unit_pos, child, unnest(vs) v, generate_subscripts(vs, 1) - 1 as pos from d),
el as (select delivery_id, unit_pos, child, cast(pos as int) pos, v from x where v is not null and json_type(v) <> 'NULL')"""
)


_OF_FIELDS = """,
fa as (select delivery_id, unit_pos, pos, 'field_annotation' child, json_extract(v, '$.annotations') a from el where child = 'field'
       union all select delivery_id, unit_pos, pos, 'field_modifier', json_extract(v, '$.modifiers') from el where child = 'field'),
fb as (select delivery_id, unit_pos, pos, child, case when json_type(a) = 'ARRAY' then cast(a as json[]) else [a] end xs
       from fa where a is not null and json_type(a) <> 'NULL'),
fc as (select delivery_id, unit_pos, pos, child, unnest(xs) a, generate_subscripts(xs, 1) - 1 as sub_pos from fb),
fd as (select delivery_id, unit_pos, pos, child, cast(sub_pos as int) sub_pos, a from fc where a is not null and json_type(a) <> 'NULL')"""


@query(
    _LISTS
    + _OF_FIELDS
    + """
select delivery_id, unit_pos, 'unit' child, -1 pos, -1 sub_pos from u
union all select delivery_id, unit_pos, child, pos, -1 from el where child not in ('modifier', 'interface')
union all select delivery_id, unit_pos, child, pos, sub_pos from fd where child = 'field_annotation'"""
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return uploads.elements(read_table(spark, d, "upload_msg"))


_POINT = "cast(coalesce(json_extract_string(u, '$.{0}.\"$numberLong\"'), json_extract_string(u, '$.{0}')) as bigint)"


@query(
    _UNITS
    + " select delivery_id, unit_pos, kind, "
    + ", ".join(f"json_extract_string(u, '$.{c}') as {c}" for c in ("name", "receiver", "namespace", "module", "lang"))
    + ", json_extract_string(e, '$.classInfo.packageName') as class_package, json_extract_string(e, '$.classInfo.className') as class_name, json_extract_string(e, '$.extends') as base"
    + ", cast(json_extract_string(u, '$.defLine') as int) def_line, "
    + ", ".join(f"{_POINT.format(f'{p}.{e}.{x}')} as {s}_{e}_{x[:3]}" for s, p in (("span", "span"), ("body", "bodySpan")) for e in ("start", "end") for x in ("row", "column"))
    + " from u"
)
def p1_units(spark: SparkSession, d: str) -> DataFrame:
    return uploads.units(read_table(spark, d, "upload_msg"))


def _typed(child: str) -> tuple[str, Query]:
    sql = _LISTS + f" select delivery_id, unit_pos, pos, json_extract_string(v, '$.name') as name, json_extract_string(v, '$.type') as type from el where child = '{child}'"
    return sql, lambda spark, d: uploads.typed(read_table(spark, d, "upload_msg"), child)


for _name, _child in (("p1_parameters", "parameter"), ("p1_returns", "return"), ("p1_fields", "field")):
    SQL[_name], QUERIES[_name] = _typed(_child)


def _words(child: str) -> tuple[str, Query]:
    value = "json_extract_string({0}, '$') as value"
    if child.startswith("field_"):
        sql = _LISTS + _OF_FIELDS + f" select delivery_id, unit_pos, pos, sub_pos, {value.format('a')} from fd where child = '{child}'"
    else:
        sql = _LISTS + f" select delivery_id, unit_pos, pos, {value.format('v')} from el where child = '{child}'"
    return sql, lambda spark, d: uploads.words(read_table(spark, d, "upload_msg"), child)


for _child in ("annotation", "decorator", "class_annotation", "modifier", "interface", "field_annotation", "field_modifier"):
    SQL[f"p1_{_child}s"], QUERIES[f"p1_{_child}s"] = _words(_child)


# ---- 3: orphan references ----

_REFS = """
with refs as (
  select 'rel_funcctx' src_table, ctx_id src_id, 'signature' ref_field, repo_id, rev_hash, signature, ingest_ts from rel_funcctx
  union all select 'rel_funcctx', ctx_id, 'calls', repo_id, rev_hash, unnest(calls), ingest_ts from rel_funcctx
  union all select 'rel_funcctx', ctx_id, 'reverse_calls', repo_id, rev_hash, unnest(reverse_calls), ingest_ts from rel_funcctx
  union all select 'func_tag', tag_id, 'signature', repo_id, rev_hash, signature, ingest_ts from func_tag),
r as (select src_table, src_id, ref_field, repo_id, rev_hash, signature, min(ingest_ts) as seen from refs where signature is not null group by all),
t as (select repo_id, rev_hash, signature, min(ingest_ts) came from fact_func group by all),
g as (select distinct repo_id, rev_hash, signature from func_drop),
o as (select r.*, case when t.signature is null then case when g.signature is not null then 'deleted' else 'missing' end
             when t.came > r.seen then 'late' end status
  from r left join t on r.repo_id = t.repo_id and r.rev_hash = t.rev_hash and r.signature = t.signature
  left join g on r.repo_id = g.repo_id and r.rev_hash = g.rev_hash and r.signature = g.signature)"""


# smallest levels by an upsert of (record, level), then every reference from a level to the one before
_CASCADE = (
    _REFS.replace("with refs", "with recursive refs", 1)
    + """,
nodes as (select distinct 'rel_funcctx' src_table, ctx_id src_id, repo_id, rev_hash, signature from rel_funcctx where signature is not null),
links as (select distinct src_table, src_id, ref_field, repo_id, rev_hash, signature from refs where signature is not null and (ref_field = 'calls' or src_table = 'func_tag')),
steps as (select distinct l.src_table, l.src_id, n.src_table to_table, n.src_id to_id from links l join nodes n on n.repo_id is not distinct from l.repo_id and n.rev_hash is not distinct from l.rev_hash and n.signature = l.signature),
lost(src_table, src_id, level) using key (src_table, src_id) as (
  select distinct src_table, src_id, 0 from o where status is not null
  union
  select distinct s.src_table, s.src_id, w.level + 1 from lost w join steps s on s.to_table = w.src_table and s.to_id = w.src_id
  where not exists (select 1 from recurring.lost k where k.src_table = s.src_table and k.src_id = s.src_id)),
inh as (select distinct l.src_table, l.src_id, l.ref_field, l.repo_id, l.rev_hash, l.signature, a.level from lost a join links l on l.src_table = a.src_table and l.src_id = a.src_id
  join nodes n on n.repo_id is not distinct from l.repo_id and n.rev_hash is not distinct from l.rev_hash and n.signature = l.signature
  join lost b on b.src_table = n.src_table and b.src_id = n.src_id and b.level = a.level - 1 where a.level > 0),
every as (select src_table, src_id, ref_field, repo_id, rev_hash, signature, seen, status, 'direct' kind, 0 level from o where status is not null
 union all select i.src_table, i.src_id, i.ref_field, i.repo_id, i.rev_hash, i.signature, r.seen, 'inherited', 'inherited', i.level from inh i join r on r.src_table = i.src_table and r.src_id = i.src_id and r.ref_field = i.ref_field
   and r.repo_id is not distinct from i.repo_id and r.rev_hash is not distinct from i.rev_hash and r.signature = i.signature)"""
)


def _graph(spark: SparkSession, d: str, deep: bool = False) -> orphans.Graph:
    return orphans.code_graph(*(read_table(spark, d, t) for t in ("fact_func", "rel_funcctx", "func_tag", "func_drop")), calls_between_contexts=deep)


@query(_REFS + " select src_table, src_id, ref_field, signature, status from o where status is not null")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.cascade(_graph(spark, d, deep=True)).filter(F.col("kind") == "direct").select("src_table", "src_id", "ref_field", "signature", "status")


@query(_REFS + " select src_table, ref_field, strftime(seen, '%Y-%m-%d') as day, status, count(*) n_refs, count(distinct src_id) n_records from o where status is not null group by all")
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(orphans.cascade(_graph(spark, d)))


@query(_CASCADE + " select src_table, ref_field, strftime(seen, '%Y-%m-%d') as day, status, kind, count(*) n_refs, count(distinct src_id) n_records from every group by all")
def p3_report_kinds(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(orphans.cascade(_graph(spark, d, deep=True)), "kind")


@query(_CASCADE + " select src_table, src_id, ref_field, repo_id, rev_hash, signature, status, kind, level from every")
def p3_cascade(spark: SparkSession, d: str) -> DataFrame:
    out = orphans.cascade(_graph(spark, d, deep=True))
    return out.select("src_table", "src_id", "ref_field", "repo_id", "rev_hash", "signature", "status", "kind", "level")


# ---- 5: snapshot differences ----


# extras as the sorted leaves of their JSON trees, without what counts as absent
_CHANGES = """
with plain as (select distinct extras from fact_func where extras is not null),
tree as (select p.extras, t.fullkey k, t.type y, t.atom a, case when t.type = 'ARRAY' then json_array_length(p.extras, t.fullkey) end n
  from (select extras from plain where json_valid(extras)) p, json_tree(p.extras) t),
canon as (select extras, string_agg(case when y = 'ARRAY' then k || '#' || n when y in ('DOUBLE', 'BIGINT', 'UBIGINT') then k || '=' || cast(cast(a as double) as varchar) else k || '=' || a end, chr(10) order by k) c
  from tree where n > 0 or a is not null and not (y = 'VARCHAR' and a = '""') group by extras
  union all select extras, '!' || extras from plain where not json_valid(extras) and extras <> ''),
vers as (select f.repo_id, f.rev_hash, f.path, f.signature, md5(cast(row(coalesce(name, ''), coalesce(receiver, ''), coalesce(namespace, ''), coalesce(lang, ''),
    list_transform(coalesce(parameters, []), lambda x: row(x is null, coalesce(x.type, ''), coalesce(x.name, ''))), list_transform(coalesce(returns, []), lambda x: row(x is null, coalesce(x.type, ''), coalesce(x.name, ''))),
    def_line, span.start.row, span.start.column, span.end.row, span.end.column, body_span.start.row, body_span.start.column, body_span.end.row, body_span.end.column, c.c) as varchar)) v
  from fact_func f left join canon c on c.extras = f.extras),
one as (select repo_id, rev_hash, path, signature, min(v) v from vers group by all),
o as (select r.repo_id, r.rev_hash, r.branch, row_number() over (partition by r.repo_id, r.branch order by min(r.create_time) nulls first, r.rev_hash) k
  from rev_info r where exists (select 1 from fact_func f where f.repo_id = r.repo_id and f.rev_hash = r.rev_hash) group by r.repo_id, r.rev_hash, r.branch),
pairs as (select distinct a.repo_id, a.rev_hash from_rev, b.rev_hash to_rev from o a join o b on a.repo_id = b.repo_id and a.branch = b.branch and b.k = a.k + 1),
x as (select p.repo_id, p.from_rev, p.to_rev, f.path, f.signature, f.v, null w from pairs p join one f on f.repo_id = p.repo_id and f.rev_hash = p.from_rev
  union all select p.repo_id, p.from_rev, p.to_rev, t.path, t.signature, null, t.v from pairs p join one t on t.repo_id = p.repo_id and t.rev_hash = p.to_rev),
y as (select repo_id, from_rev, to_rev, path, signature, max(v) v, max(w) w from x group by all)
select repo_id, from_rev, to_rev, path, signature, case when v is null then 'added' when w is null then 'removed' else 'changed' end as change from y where v is distinct from w"""


@query(_CHANGES)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.function_changes(read_table(spark, d, "fact_func"), read_table(spark, d, "rev_info"))


# ---- 6: skewed keys ----

_COUNTS = """
with s as (select 'signature' field, signature, count(distinct func_id) n from fact_func group by signature),
e as (select ctx_id, row_number() over () rid, unnest(reverse_calls) signature from rel_funcctx),
p as (select ctx_id, rid, signature, count(*) n from e where signature is not null group by all),
q as (select ctx_id, signature, max(n) n from p group by all),
c as (select * from s union all select 'reverse_calls', signature, cast(sum(n) as bigint) from q group by signature),
t as (select field, cast(sum(n) as bigint) total from c group by field)
"""


@query(_COUNTS + "select c.field, c.signature, c.n, t.total from c join t on c.field = t.field where c.signature is not null")
def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return salted.signature_counts(read_table(spark, d, "fact_func"), read_table(spark, d, "rel_funcctx"))


@query(_COUNTS + "select c.field, c.signature from c join t on c.field = t.field where c.signature is not null and c.n > 0.02 * t.total")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return salted.heavy_signatures(read_table(spark, d, "fact_func"), read_table(spark, d, "rel_funcctx")).select("field", "signature")


# ---- 7: repeated deliveries ----

_IDS = r"""
with m as (select *, regexp_replace(lower(trim(msg_id, chr(32) || chr(9) || chr(10) || chr(13))), '^(urn:)?(uuid:)?[{(]?|[)}]$|-', '', 'g') u from upload_msg),
k as (select *, case when regexp_full_match(u, '[0-9a-f]{32}') then u else 'row ' || delivery_id end key from m),
w as (select *, min(delivery_id) over (partition by key) first_id from k)
"""


@query(_IDS + "select delivery_id from w where delivery_id > first_id")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_deliveries(read_table(spark, d, "upload_msg"))


@query(_IDS + "select delivery_id, topic, batch_id, msg_id, length(payload) as payload_chars from w where delivery_id = first_id")
def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    kept = dedupe.keep_first(read_table(spark, d, "upload_msg"), dedupe.uuid_hex("msg_id"), "delivery_id")
    return kept.select("delivery_id", "topic", "batch_id", "msg_id", F.length("payload").cast("bigint").alias("payload_chars"))
