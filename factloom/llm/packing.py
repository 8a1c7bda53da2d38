"""Filling containers of a fixed capacity with items of varying size.

Exact-complement hashing: for the largest sizes first, single, pair and triple sums of the sizes
still available are looked up that fill the gap exactly, and consumed as often as availability
allows; what remains is placed by best fit. Only the histogram of sizes, bounded by the capacity,
reaches the driver; the plan it yields is bounded likewise. Items are then ranked within their
size, in two stages so that a size of a third of all items is no hot spot, and the plan turns a
rank into a container.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.tokens import RANKS, count_tokens
from factloom.runtime import materialize

#: Items of one rank block.
ROWS_PER_BLOCK = 500_000


class _Sums:
    """Which sums two available sizes can make; stale after use, but never missing one."""

    def __init__(self, avail: np.ndarray) -> None:
        self.avail = avail
        self.spent = 0
        self.refresh()

    def refresh(self) -> None:
        have = (self.avail > 0).astype(np.float64)
        n = 1 << (2 * len(have)).bit_length()
        both = np.fft.irfft(np.fft.rfft(have, n) ** 2, n)[: len(have)]
        self.pairs = both > 0.5
        self.spent = 0

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two available sizes of sum ``gap``, the larger one as large as can be."""
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = a[(self.avail[a] > 0) & (self.avail[gap - a] > 0)]
        for x in ok[:2]:
            if 2 * x != gap or self.avail[x] > 1:
                return int(x), gap - int(x)
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        a = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        a = a[a > 0]
        for x in a[(self.avail[a] > 0) & self.pairs[gap - a]]:
            self.avail[x] -= 1  # the other two come from what is left
            p = self.pair(gap - int(x))
            self.avail[x] += 1
            if p:
                return int(x), *p
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(sizes in a container, number of such containers) for items of sizes 1 to ``capacity``."""
    avail = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} is not in 1..{capacity}")
        avail[size] = n
    done: list[tuple[tuple[int, ...], int]] = []
    if avail[capacity]:
        done.append(((capacity,), int(avail[capacity])))
        avail[capacity] = 0
    sums = _Sums(avail)
    rest: list[tuple[int, int]] = []
    for size in range(capacity - 1, 0, -1):
        while avail[size]:
            gap = capacity - size
            avail[size] -= 1  # one is set aside while its complement is sought
            found = (gap,) if avail[gap] else sums.pair(gap) or (sums.triple(gap) if gap > 2 else None)
            avail[size] += 1
            if not found:
                rest.append((size, int(avail[size])))
                avail[size] = 0
                break
            combo = (size, *found)
            times = min(int(avail[x]) // combo.count(x) for x in set(combo))
            for x in combo:
                avail[x] -= times
            done.append((combo, times))
            sums.spent += sum(avail[x] == 0 for x in set(combo))
            if sums.spent >= 64:
                sums.refresh()
    return done + _best_fit(rest, capacity)


def _best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of (size, number), largest size first, whole groups of like containers at a time."""
    open_: dict[int, list[list]] = {}
    gaps: list[int] = []

    def put(gap: int, sizes: tuple[int, ...], n: int) -> None:
        if gap not in open_:
            gaps.insert(bisect_left(gaps, gap), gap)
            open_[gap] = []
        open_[gap].append([sizes, n])

    for size, n in items:
        while n:
            k = bisect_left(gaps, size)
            if k == len(gaps):
                each = capacity // size
                if full := n // each:
                    put(capacity - each * size, (size,) * each, full)
                if n % each:
                    put(capacity - n % each * size, (size,) * (n % each), 1)
                break
            gap = gaps[k]
            group = open_[gap][-1]
            times = min(n, group[1])
            group[1] -= times
            if not group[1]:
                open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(k)
            put(gap - size, (*group[0], size), times)
            n -= times
    return [(s, n) for groups in open_.values() for s, n in groups]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For lookups by (size, rank): first rank, first container and items per container of each
    run of ranks, sorted by size and rank."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for sizes, n in patterns:
        for size in sorted(set(sizes)):
            each = sizes.count(size)
            rows.append((size, used.get(size, 0), first, each))
            used[size] = used.get(size, 0) + n * each
        first += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pieces(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece, size): items over the capacity cut into full pieces and a rest, others whole."""
    cut = sizes.select(id_col, F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("_n")).select(id_col, "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("_n") / capacity)).cast("int") - 1)).alias("piece"))
    return cut.select(id_col, "piece", F.least(F.lit(capacity), F.col("_n") - F.col("piece").cast("bigint") * capacity).cast("int").alias("size"))


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece, size, container) of every item: no container holds more than ``capacity``.

    An item is split only if it exceeds the capacity; its pieces are numbered from 0. Items of no
    size (null or 0) need no room and are spread over the containers. Repeated and null ids are
    items like any other. An empty table gives no row; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    cut = materialize(pieces(sizes, id_col, size_col, capacity), "pieces")
    counts = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    total = sum(counts.values())
    counts.pop(0, None)
    patterns = plan(counts, capacity)
    containers = max(1, sum(n for _, n in patterns))
    size_, rank_, first_, each_ = _slots(patterns)
    wide = max(1, total)
    starts = size_ * wide + rank_

    @F.arrow_udf(T.LongType())
    def container(size: pa.Array, rank: pa.Array) -> pa.Array:
        s, r = size.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False)
        if not len(starts):
            return pa.array(r % containers)
        k = np.maximum(np.searchsorted(starts, s * wide + r, "right") - 1, 0)
        return pa.array(np.where(s == 0, r % containers, first_[k] + (r - rank_[k]) // each_[k]))

    blocks = math.ceil(total / ROWS_PER_BLOCK) or 1
    blocked = cut.withColumn("block", F.pmod(F.xxhash64(id_col, "piece"), F.lit(blocks)))
    per_block = blocked.groupBy("size", "block").count()
    before = Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select("size", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("size", "block").orderBy(id_col, "piece"))
    ranked = blocked.withColumn("rank", within).join(offsets, ["size", "block"]).withColumn("rank", F.col("before") + F.col("rank") - 1)
    return ranked.select(id_col, "piece", "size", container("size", "rank").alias("container"))


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str = RANKS) -> DataFrame:
    """Documents, measured in tokens, in containers of ``capacity`` tokens."""
    return pack(count_tokens(docs, path=path), "doc_id", "n_tokens", capacity)
