"""The queries on texts that have no SQL, on whole tables."""

import pytest
import tiktoken

import __spark_entry__ as entry
from conftest import as_set
from factloom.llm import handwritten, queries, tokens


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def run(spark, data, name):
    df = entry.queries()[name](spark, data)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text
    return df.collect()


def test_ids_are_those_of_the_whole_text(spark, data, docs):
    plain = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(tokens.RANKS), special_tokens={})
    got = run(spark, data, "p8_ids")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        assert r["ids"] == plain.encode_ordinary(docs[r["doc_id"]]["text"] or "")


def test_containers(spark, data, docs):
    sizes = {r["doc_id"]: len(r["ids"]) for r in run(spark, data, "p8_ids")}
    got = run(spark, data, "p9_containers")
    fill, placed, parts = {}, {}, {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
        placed[r["doc_id"]] = placed.get(r["doc_id"], 0) + r["n_tokens"]
        parts[r["doc_id"]] = parts.get(r["doc_id"], 0) + 1
    assert placed == sizes and max(fill.values()) <= queries.CAPACITY
    assert all(n == 1 or sizes[d] > queries.CAPACITY for d, n in parts.items())
    bound = -(-sum(sizes.values()) // queries.CAPACITY)
    assert len([c for c, n in fill.items() if n]) <= bound + 2
    assert sum(r["n_containers"] for r in run(spark, data, "p9_fill")) == len(fill)


def test_files_nobody_wrote(spark, data, docs):
    kinds = {r["doc_id"]: r["kind"] for r in run(spark, data, "p4_kinds")}
    assert {r["doc_id"] for r in run(spark, data, "p4_found")} == set(kinds) and set(kinds.values()) <= set(handwritten.KINDS)
    assert all(docs[d]["source"] == "src_file" for d in kinds)
    alone = {d for d, r in docs.items() if r["source"] == "src_file" and handwritten.text_kind(r["text"] or "")}
    assert alone <= set(kinds)
    kept = run(spark, data, "p4_functions")
    bad = {(docs[d]["repo_id"], docs[d]["path"]) for d in kinds}
    assert kept and not {(r["repo_id"], r["path"]) for r in kept} & bad


def test_garbled_documents(spark, data, docs):
    restored = {r["doc_id"]: r for r in run(spark, data, "p10_restored")}
    assert {r["doc_id"] for r in run(spark, data, "p10_found")} == set(restored)
    for d, r in restored.items():
        assert r["text"] is None or r["text"] != docs[d]["text"]
        assert r["chains"] and 0 < r["n_lines"] <= len(docs[d]["text"].split("\n"))


def test_summary_of_containers(spark, data):
    assert as_set(entry.queries()["p9_checks"](spark, data)) == {(spark.read.parquet(f"{data}/documents.parquet").count(), 0, 0)}
