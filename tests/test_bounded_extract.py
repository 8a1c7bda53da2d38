"""Extraction holds the facts of one text at a time, and the tree search reads each file once."""

import tracemalloc

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from factloom.operators import facts
from factloom.sources import extract as ext
from factloom.sources.extract import Facts

FUNCTIONS = ("function_declaration", "method_declaration", "method_definition", "function_definition")
CALLS = ("call_expression", "method_invocation")
SCHEMA = "doc_id bigint, lang string, text string"


def text(k, calls=60):
    return f"package p{k}\n\nfunc f{k}() {{\n" + "".join(f"\tg{i}(h{i}({k}))\n" for i in range(calls)) + "}\n"


@pytest.fixture()
def run(spark, monkeypatch):
    """The function that a task of ``extract`` runs, for a language's documents as one batch."""

    def make(texts, what="unit", **options):
        df, got = spark.createDataFrame([], SCHEMA), []
        with monkeypatch.context() as m:
            m.setattr(ext, "spread", lambda rows: rows)
            m.setattr(type(df), "mapInArrow", lambda self, f, schema: got.append(f))
            ext.extract(df, what, ["doc_id"], **options)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(["GOLANG"] * len(texts)), pa.array(texts)], names=["doc_id", "lang", "text"])
        return got[0](iter([batch]))

    return make


def expected(texts):
    return sorted((k, u["unit_id"], u["kind"], u["content"]) for k, x in enumerate(texts) for u in Facts(x, "GOLANG").units())


@pytest.mark.parametrize("texts", [[text(k) for k in range(60)], [text(1)] * 60, [text(1, 9000), "", text(2)], []], ids=["distinct", "equal", "one large", "none"])
def test_no_batch_is_larger_than_the_bound(run, texts):
    out = list(run(texts))
    assert all(b.num_rows <= ext.BATCH_ROWS for b in out) and (len(out) > 1 or not texts)
    cols = [[x for b in out for x in b.column(b.schema.get_field_index(c)).to_pylist()] for c in ("doc_id", "unit_id", "kind", "content")]
    assert sorted(zip(*cols)) == expected(texts)


def test_memory_does_not_grow_with_the_texts_of_a_batch(run):
    def peak(n):
        tracemalloc.start()
        try:
            rows = sum(b.num_rows for b in run([text(k) for k in range(n)]))
            return tracemalloc.get_traced_memory()[1], rows
        finally:
            tracemalloc.stop()

    (few, rows), (many, more) = peak(60), peak(240)
    assert more == 4 * rows > 4 * 10_000 and many < 1.5 * few


def test_columns_that_are_not_asked_for_are_not_given(run):
    texts = [text(1), text(2)]
    (out,) = run(texts, columns=["unit_id", "kind"])
    assert out.schema.names == ["doc_id", "unit_id", "kind", "error"]
    assert sorted(zip(*(out.column(i).to_pylist() for i in range(3)))) == [x[:3] for x in expected(texts)]


def test_only_units_of_the_kinds_are_given(run):
    texts = [text(1), "package p", text(2)]
    (out,) = run(texts, kinds=["function_declaration", "call_expression"])
    got = [tuple(r.values()) for r in out.select(["doc_id", "unit_id", "kind", "content"]).to_pylist()]
    assert sorted(got) == [x for x in expected(texts) if x[2] in ("function_declaration", "call_expression")] and len(got) == 2 * 121


@pytest.mark.parametrize("x", [text(1), "", "func f() { a(b(c()), func() { d() }) }\nfunc g() {}"])
def test_units_are_numbered_by_the_tree(x):
    f, want = Facts(x, "GOLANG"), []

    def walk(n, parent, depth):
        want.append(row := [len(want), parent, 0, depth, n.kind])
        for c in n.children:
            walk(c, row[0], depth + 1)
        row[2] = len(want) - 1

    walk(f.root, None, 0)
    assert [[u["unit_id"], u["parent_id"], u["last_descendant_id"], u["depth"], u["kind"]] for u in f.units()] == want


def test_calls_have_their_nearest_function(spark, data):
    df = entry.queries()["tree_enclosing"](spark, data)
    # both sides of the search read what one pass over the files wrote
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    want = []
    for doc_id, path, x in duckdb.sql(f"select doc_id, path, text from '{data}/documents.parquet' where source = 'src_file' and path is not null and text is not null").fetchall():
        lang = next((n for s, n in facts.SUFFIXES.items() if path.endswith(s)), None)
        try:
            f = Facts(x, lang)
        except ext.ParseError:
            continue
        ids = {id(n): k for k, (n, _) in enumerate(f.nodes)}
        for n, above in f.nodes if f.src.error is None else ():
            if n.kind in CALLS and (own := next((a for a in reversed(above) if a.kind in FUNCTIONS), None)):
                want.append((doc_id, ids[id(n)], ids[id(own)], own.kind))
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and len(want) > 20
