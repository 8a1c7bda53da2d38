"""Joins of wide rows to a set of keys, without a shuffle of the rows that match none.

A small set is broadcast. A larger one becomes a blocked Bloom filter of bounded size, built by the
tasks and broadcast, and only rows that pass it are shuffled to the exact join behind.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.runtime import plan_bytes

#: Bytes of the filter at most; above two million keys per MB it lets more and more rows pass.
FILTER_BYTES = 32 << 20
#: Bits of a block, bits set per key, bits planned per key, blocks that one task builds at once.
BLOCK, SET, PER_KEY, CHUNK = 512, 6, 16, 1 << 14


def _bits(h2: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(SET):
        yield (h2 >> np.uint64(9 * k)) & np.uint64(BLOCK - 1)


def build(keys: DataFrame, n: int, filter_bytes: int = FILTER_BYTES) -> np.ndarray:
    """The filter of (h1, h2) rows as bytes: each key sets SET bits of one block."""
    blocks = 1
    while blocks * BLOCK < n * PER_KEY and blocks * BLOCK // 8 < filter_bytes:
        blocks *= 2
    width = min(blocks, CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (1, 2))
            block = (h1 % np.uint64(blocks)).astype(np.int64)
            for c in np.unique(block // width):
                mine = block // width == c
                bits = held.setdefault(int(c), np.zeros(width * BLOCK, bool))
                for b in _bits(h2[mine]):
                    bits[(block[mine] - c * width) * BLOCK + b.astype(np.int64)] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in held.values()], pa.binary())], names=["chunk", "bits"])

    chunk = F.pmod(F.col("h1").bitwiseAND(F.lit(blocks - 1)), F.lit(blocks)).cast("int")
    placed = keys.select(F.floor(chunk / width).cast("int").alias("chunk"), "h1", "h2").repartition(max(1, blocks // width), "chunk")
    out = np.zeros(blocks * BLOCK // 8, np.uint8)
    size = width * BLOCK // 8
    for r in placed.mapInArrow(run, "chunk int, bits binary").toLocalIterator():  # bounded by filter_bytes
        out[r["chunk"] * size : (r["chunk"] + 1) * size] |= np.frombuffer(r["bits"], np.uint8)
    return out


def may_hold(spark, bits: np.ndarray) -> object:
    """A function of (h1, h2) columns: false only for keys that the filter does not hold."""
    sent, blocks = spark.sparkContext.broadcast(bits), len(bits) * 8 // BLOCK

    @F.arrow_udf(T.BooleanType())
    def test(a: pa.Array, b: pa.Array) -> pa.Array:
        h1, h2 = (x.to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b))
        start = (h1 % np.uint64(blocks)).astype(np.int64) * BLOCK
        out = np.ones(len(h1), bool)
        for k in _bits(h2):
            at = start + k.astype(np.int64)
            out &= (sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pa.array(out)

    return test


def join_keys(rows: DataFrame, hashes: Sequence[Column], keys: DataFrame, limit: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``keys`` on their first two columns, which are hashes of 64 bits: those
    ``hashes`` of ``rows``. ``keys`` must be a written table; its other columns come along, the
    hashes only from ``keys``.

    Up to ``limit`` bytes on disk the keys are broadcast. Beyond, rows that the filter excludes stay
    where they are read, and AQE splits what is skewed of the rest.
    """
    h = [F.col(c) for c in keys.columns[:2]]
    wide = rows.select("*", hashes[0].alias(keys.columns[0]), hashes[1].alias(keys.columns[1]))
    if plan_bytes(keys) <= limit:
        return wide.join(F.broadcast(keys), keys.columns[:2], how)
    test = may_hold(rows.sparkSession, build(keys.select(h[0].alias("h1"), h[1].alias("h2")), keys.count()))
    return wide.filter(test(*h)).join(keys, keys.columns[:2], how)
