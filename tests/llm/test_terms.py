from collections import Counter, defaultdict

import numpy as np
from conftest import as_set
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import terms

SCHEMA = "field string, record bigint, terms array<string>, ids string"


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 5000), st.integers(1, 300), min_size=1))
def test_bitmaps_round_trip(postings):
    ids, counts = np.array(sorted(postings)), np.array([postings[k] for k in sorted(postings)])
    a, b = terms.unpack(*terms.pack(ids, counts))
    assert a.tolist() == ids.tolist() and b.tolist() == counts.tolist()


def test_dense_bitmap_is_small():
    ids = np.arange(terms.RANGE)
    raw, counts = terms.pack(ids, np.ones(len(ids)))
    assert len(raw) < terms.RANGE // 100 and counts == b""


def brute(rows):
    per = defaultdict(lambda: defaultdict(int))
    for f, r, ts, *_ in rows:
        if f is None or r is None:
            continue
        for t, n in Counter(t for t in ts or [] if t).items():
            per[f, t][r] = max(per[f, t][r], n)
    total = defaultdict(set)
    for (f, _), recs in per.items():
        total[f] |= set(recs)
    return {(f, t, len(rs), sum(rs.values()), len(total[f])) for (f, t), rs in per.items()}


def test_counts_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(f"f{i % 2}", int(rng.integers(0, 3_000_000)), [f"t{int(x)}" for x in rng.zipf(1.6, 4) % 50], "x") for i in range(3000)]
    rows += rows[:100] + [("f0", 1, None, "x"), ("f0", None, ["t1"], "x"), (None, 1, ["t1"], "x"), ("f0", 2, [None, "", "t1", "t1"], "x"), ("f0", 2, ["t1"], "x"), ("f0", 3, [], "x")]
    got = terms.term_counts(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert as_set(got.select("field", "term", "records", "occurrences", "field_records")) == brute(rows)


def test_empty_table(spark):
    assert terms.term_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_marks(spark):
    rows = [("f", i, ["all"] + (["few"] if i < 5 else []) + (["some"] if i < 6 else [])) for i in range(100)]
    got = terms.mark(terms.term_counts(spark.createDataFrame(rows, "field string, record bigint, terms array<string>")))
    assert as_set(got.select("term", "mark")) == {("all", "common"), ("few", "rare"), ("some", None)}


def test_terms_of_code(spark):
    f = spark.createDataFrame([(1, '{"annotations":[" @A\\n","\\t",null]}', [("int ", "a"), (None, "b")], None), (2, '{"annotations":"@A"}', None, [("", "x")]), (3, None, None, None), (4, "{bad", None, None)], "func_id bigint, extras string, parameters array<struct<type:string,name:string>>, returns array<struct<type:string,name:string>>")
    c = spark.createDataFrame([(1, '{"annotations":["@B"]}')], "clazz_id bigint, extras string")
    got = terms.term_counts(terms.code_terms(f, c))
    assert as_set(got.select("field", "term", "records")) == {("func_annotation", "@A", 2), ("value_type", "int", 1), ("clazz_annotation", "@B", 1)}
