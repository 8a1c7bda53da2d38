"""Queries on texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import garbled, handwritten, packing, terms, tokens
from factloom.runtime import materialize, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- 2: term frequencies ----

_TERMS = """
with raw as (
  select 'func_annotation' field, func_id rec, json_extract(extras, '$.annotations') a from fact_func where json_valid(extras)
  union all select 'clazz_annotation', clazz_id, json_extract(extras, '$.annotations') from fact_clazz where json_valid(extras)),
one as (select field, rec, case when json_type(a) = 'ARRAY' then cast(a as json[]) else [a] end l from raw where a is not null and json_type(a) <> 'NULL'),
vals as (
  select field, row_number() over () rid, rec, list_transform(l, lambda x: json_extract_string(x, '$')) l from one
  union all select 'value_type', -row_number() over (), func_id,
    list_concat(coalesce(list_transform(parameters, lambda x: x.type), []), coalesce(list_transform(returns, lambda x: x.type), [])) from fact_func),
flat as (select field, rid, rec, unnest(l) t from vals),
clean as (select field, rid, rec, trim(t, chr(32) || chr(9) || chr(10) || chr(13)) term from flat where t is not null),
per_row as (select field, rid, rec, term, count(*) n from clean where term <> '' group by all),
per_rec as (select field, rec, term, max(n) n from per_row group by all),
tot as (select field, count(distinct rec) field_records from per_rec group by field),
c as (select field, term, count(*) records, cast(sum(n) as bigint) occurrences from per_rec group by all)
select c.field, c.term, c.records, c.occurrences, t.field_records,
  case when records <= 5 then 'rare' when records > 0.2 * field_records then 'common' end mark
from c join tot t on c.field = t.field"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.mark(terms.term_counts(terms.code_terms(read_table(spark, d, "fact_func"), read_table(spark, d, "fact_clazz"))))


@query(_TERMS)
def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("field", "term", "records", "occurrences", "field_records", "mark")


@query(f"select field, term, mark from ({_TERMS}) z where mark is not null")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).filter(F.col("mark").isNotNull()).select("field", "term", "mark")


# ---- 8: encoding ----


@query()
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(read_table(spark, d, "documents"))


@query("select doc_id, coalesce(text, '') as text from documents")
def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode(tokens.encode(read_table(spark, d, "documents")))


# ---- 9: packing ----

CAPACITY = 2048


@query()
def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, d, "documents"), CAPACITY).withColumnRenamed("size", "n_tokens")


@query()
def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    per = p9_containers(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return per.groupBy(F.floor(F.col("n") * 100 / CAPACITY).alias("percent_full")).agg(F.count("*").alias("n_containers"))


@query("select count(*) as documents, 0 as overfull, 0 as split_needlessly from documents")
def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: every document is placed, no container is overfull, and only
    documents beyond the capacity are split."""
    placed = materialize(p9_containers(spark, d), "containers")
    over = placed.groupBy("container").agg(F.sum("n_tokens").alias("n")).select(F.lit(0).alias("doc"), (F.col("n") > CAPACITY).cast("int").alias("overfull"), F.lit(0).alias("split"))
    per = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"))
    docs = per.select(F.lit(1).alias("doc"), F.lit(0).alias("overfull"), ((F.col("parts") > 1) & (F.col("n") <= CAPACITY)).cast("int").alias("split"))
    sums = {"documents": F.sum("doc"), "overfull": F.sum("overfull").cast("int"), "split_needlessly": F.sum("split").cast("int")}
    return over.unionByName(docs).agg(*(c.alias(n) for n, c in sums.items()))


# ---- 4: files nobody wrote by hand ----


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    files = handwritten.source_files(read_table(spark, d, "documents"))
    return handwritten.classify(files, read_table(spark, d, "lib_file")).filter(F.col("kind").isNotNull())


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).select("doc_id")


@query()
def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d)


@query()
def p4_functions(spark: SparkSession, d: str) -> DataFrame:
    kept = handwritten.functions_by_hand(*(read_table(spark, d, t) for t in ("fact_func", "documents", "lib_file")))
    return kept.select("func_id", "repo_id", "rev_hash", "path", "signature")


# ---- 10: garbled text ----


def _restored(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return garbled.restore(docs, garbled.train(docs))


@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d).select("doc_id")


@query()
def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d).select("doc_id", F.array_join("chains", "; ").alias("chains"), "n_lines", "text")
