from collections import Counter, defaultdict

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import packing


def check(spark, sizes, capacity, **extra):
    df = spark.createDataFrame([(i, n, 1, 2) for i, n in enumerate(sizes)], "doc_id bigint, n bigint, container bigint, block int")
    rows = packing.pack(df, "doc_id", "n", capacity).collect()
    fill, parts = Counter(), defaultdict(list)
    for r in rows:
        fill[r["container"]] += r["size"]
        parts[r["doc_id"]].append((r["piece"], r["size"]))
    assert max(fill.values(), default=0) <= capacity
    assert {i: sum(s for _, s in p) for i, p in parts.items()} == {i: n or 0 for i, n in enumerate(sizes)}
    for i, p in parts.items():
        n = sizes[i] or 0
        assert sorted(k for k, _ in p) == list(range(len(p))) and (len(p) == 1) == (n <= capacity) and len(p) == max(1, -(-n // capacity))
    return fill


def test_all_items_once(spark):
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.lognormal(4.5, 1.2, 4000)]
    fill = check(spark, sizes, 512)
    assert len(fill) <= sum(sizes) / 512 * 1.01 + 1


@pytest.mark.parametrize("sizes", [[0, None, 0], [5], [600], [512] * 7, [256] * 9, [171] * 300, [1] * 1000, [513, 1024, 1025, None, 0]])
def test_small_cases(spark, sizes):
    check(spark, sizes, 512)


def test_hot_size_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BLOCK", 50)
    fill = check(spark, [100] * 2000 + [412] * 1900 + [7] * 300, 512)
    assert len(fill) == -(-(100 * 2000 + 412 * 1900 + 7 * 300) // 512) or len(fill) <= 1 + (100 * 2000 + 412 * 1900 + 7 * 300) / 512 * 1.02


def test_no_rows_and_bad_capacity(spark):
    df = spark.createDataFrame([], "doc_id bigint, n bigint")
    assert packing.pack(df, "doc_id", "n", 8).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "doc_id", "n", 0)
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), max_size=25))
def test_plan_uses_every_item_within_capacity(histogram):
    used = Counter()
    for sizes, n in packing.plan(histogram, 60):
        assert sum(sizes) <= 60 and n > 0
        for s in sizes:
            used[s] += n
    assert used == Counter(histogram)


def test_exact_complements_are_found():
    assert sorted(packing.plan({50: 2, 10: 2}, 60)) == [((50, 10), 2)]
    assert packing.plan({40: 1, 15: 1, 5: 1}, 60) == [((40, 15, 5), 1)]
    assert packing.plan({30: 1, 15: 1, 10: 1, 5: 1}, 60) == [((30, 15, 10, 5), 1)]
    assert packing.plan({20: 3}, 60) == [((20, 20, 20), 1)]


def test_triples_find_every_exact_fill():
    """5 + 5 + 2 needs a second 5, so 5 + 4 + 3 is the fill of 12."""
    avail = np.zeros(13, np.int64)
    avail[[2, 3, 4, 5]] = 1
    assert sorted(packing._Sums(avail).triple(12)) == [3, 4, 5] and avail.sum() == 4
    rng = np.random.default_rng(3)
    for _ in range(200):
        avail = rng.integers(0, 3, 20)
        avail[0] = 0
        gap = int(rng.integers(3, 20))
        got = packing._Sums(avail).triple(gap)
        able = any(sum(c) == gap and all(avail[x] >= c.count(x) for x in c) for c in itertools.combinations_with_replacement(range(1, 20), 3))
        assert (got is not None) == able
        assert got is None or sum(got) == gap and all(avail[x] >= got.count(x) for x in got)
