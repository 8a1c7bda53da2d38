"""Occurrences and document frequency of every distinct term.

Vertical layout: each task turns its rows into one compressed bitmap of record ids per term with a
parallel array of occurrence counters, so what is shuffled is a few bytes per term, task and
record. Bitmaps of a term are merged by union; a record that several rows name (copies) keeps its
largest counter. Document frequency is the cardinality of the union, occurrences the sum of the
counters. A term of a third of all records is no hot spot: ids are cut into ranges, the merge works
by (term, range), and only two numbers per range meet in the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.lists import json_list, stripped

#: Record ids of one range; a merged bitmap has at most RANGE / 8 bytes and RANGE counters.
RANGE = 1 << 20
#: Postings that a task holds before it gives out its bitmaps.
HELD = 2_000_000
ANY = ""

_BITMAPS = "field string, term string, range bigint, ids binary, counts binary"


def pack(ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted distinct offsets below RANGE and their counters, compressed.

    The set is kept as a bitmap where that is smaller than the list of gaps; the first byte tells
    which. Counters that are all 1 take no space.
    """
    span = int(ids[-1]) // 8 + 1
    if len(ids) * 3 > span:
        bits = np.zeros(span * 8, np.uint8)
        bits[ids] = 1
        raw = b"B" + np.packbits(bits, bitorder="little").tobytes()
    else:
        gaps = np.diff(ids, prepend=0)
        kind = (b"1", np.uint8) if gaps.max() < 256 else (b"2", np.uint16) if gaps.max() < 65536 else (b"4", np.uint32)
        raw = kind[0] + gaps.astype(kind[1]).tobytes()
    ones = bool((counts == 1).all())
    raw = b"Z" + zlib.compress(raw, 1) if len(raw) > 64 else raw
    return raw, b"" if ones else zlib.compress(counts.astype(np.uint32).tobytes(), 1)


def unpack(raw: bytes, counters: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw[1:]) if raw[:1] == b"Z" else raw
    body = raw[1:]
    if raw[:1] == b"B":
        ids = np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little"))
    else:
        ids = np.cumsum(np.frombuffer(body, {b"1": np.uint8, b"2": np.uint16, b"4": np.uint32}[raw[:1]]), dtype=np.int64)
    return ids, np.frombuffer(zlib.decompress(counters), np.uint32) if counters else np.ones(len(ids), np.uint32)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _emit(names: list[tuple[str, str]], term: np.ndarray, record: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Bitmaps of (term, record, count) triples; equal (term, record) pairs keep the largest count."""
    order = np.lexsort((count, record, term))
    term, record, count = term[order], record[order], count[order]
    last = np.append(_runs(term, record)[1:], len(term)) - 1
    term, record, count = term[last], record[last], count[last]
    block = record // RANGE
    cols: list[list] = [[], [], [], [], []]
    starts = _runs(term, block)
    for a, b in zip(starts, [*starts[1:], len(term)]):
        ids, counts = pack(record[a:b] - block[a] * RANGE, count[a:b])
        for c, x in zip(cols, (*names[term[a]], int(block[a]), ids, counts)):
            c.append(x)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], names=["field", "term", "range", "ids", "counts"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, record, terms) rows into bitmaps; the term ANY of a field holds all its records."""
    index: dict[tuple[str, str], int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if held:
            term, record, count = (np.concatenate(x) for x in zip(*held))
            yield _emit(list(index), term, record, count)
        held.clear()
        index.clear()
        size = 0

    for batch in batches:
        fields, record, lists = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().dictionary_encode()
        words, code = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(record)), sizes)
        field = fields.indices.to_numpy(zero_copy_only=False)
        names = fields.dictionary.to_pylist()
        pair = field[owner].astype(np.int64) * max(1, len(words)) + code
        kinds, local = np.unique(pair, return_inverse=True)
        ids = np.array([index.setdefault((names[p // len(words)], words[p % len(words)]), len(index)) for p in kinds.tolist()], np.int64)
        # occurrences of a term in one row
        key, count = np.unique(owner * max(1, len(kinds)) + local, return_counts=True)
        if len(key):
            held.append((ids[key % len(kinds)], record[key // len(kinds)], count))
            some = np.unique(owner)
            any_ids = np.array([index.setdefault((n, ANY), len(index)) for n in names], np.int64)
            held.append((any_ids[field[some]], record[some], sizes[some].astype(np.int64)))
            size += len(key) + len(some)
        if size > HELD:
            yield from flush()
    yield from flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of each run of bitmaps of one (field, term, range) in a sorted partition."""
    key: tuple | None = None
    parts: list[tuple[bytes, bytes]] = []

    def close() -> tuple:
        if len(parts) == 1:
            ids, counts = unpack(*parts[0])
        else:
            got = [unpack(*p) for p in parts]
            ids, counts = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            order = np.lexsort((counts, ids))
            ids, counts = ids[order], counts[order]
            last = np.append(_runs(ids)[1:], len(ids)) - 1
            ids, counts = ids[last], counts[last]
        return *key, len(ids), int(counts.sum())

    for batch in batches:
        rows = []
        for *k, ids, counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if k != key and parts:
                rows.append(close())
                parts = []
            elif len(parts) >= 64:  # fold, so that a term of very many tasks stays small
                got = [unpack(*p) for p in parts]
                a, c = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
                order = np.lexsort((c, a))
                a, c = a[order], c[order]
                last = np.append(_runs(a)[1:], len(a)) - 1
                parts = [pack(a[last], c[last])]
            key = k
            parts.append((ids, counts))
        if rows:
            yield _counted(rows)
    if parts:
        yield _counted([close()])


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    f, t, r, n, o = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(t, pa.string()), pa.array(r, pa.int64()), pa.array(n, pa.int64()), pa.array(o, pa.int64())], names=["field", "term", "range", "records", "occurrences"])


def term_counts(rows: DataFrame) -> DataFrame:
    """Counts of each term of (field string, record bigint, terms array<string>) rows.

    Result: field, term, records, occurrences and field_records (records that hold any term of the
    field). Null and empty terms, null lists and null records or fields don't count. Several rows
    of a record are copies: a term's occurrences in a record are its most in any one row. Record
    ids must not be negative. An empty table gives no row. Other columns are ignored.
    """
    clean = F.filter("terms", lambda t: t.isNotNull() & (t != ""))
    rows = rows.select("field", F.col("record").cast("bigint").alias("record"), clean.alias("terms")).filter((F.size("terms") > 0) & F.col("field").isNotNull() & F.col("record").isNotNull())
    bitmaps = rows.mapInArrow(_build, _BITMAPS)
    merged = bitmaps.repartition("field", "term", "range").sortWithinPartitions("field", "term", "range").mapInArrow(_merge, "field string, term string, range bigint, records bigint, occurrences bigint")
    totals = merged.groupBy("field", "term").agg(F.sum("records").alias("records"), F.sum("occurrences").alias("occurrences"))
    every = totals.filter(F.col("term") == ANY).select("field", F.col("records").alias("field_records"))
    # one row per field: bounded by the number of fields, not by the data
    return totals.filter(F.col("term") != ANY).join(F.broadcast(every), "field")


def mark(counts: DataFrame, rare: int = 5, common: float = 0.2) -> DataFrame:
    """Adds ``mark``: rare (at most ``rare`` records), else common (more than that share of the
    records holding any term of the field), else null."""
    return counts.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.col("field_records") * common, "common"))


def code_terms(func: DataFrame, clazz: DataFrame) -> DataFrame:
    """(field, record, terms) of the annotations of functions and classes and of value types.

    Terms lose surrounding white space. A lone annotation is a list of one; null or broken extras,
    null lists and null types give none.
    """
    of = lambda field, terms: F.struct(F.lit(field).alias("field"), stripped(terms).alias("terms"))
    notes = F.when(F.col("extras").contains("annotations"), json_list("extras", "$.annotations"))
    types = F.transform(F.concat(F.coalesce("parameters", F.array()), F.coalesce("returns", F.array())), lambda v: v["type"])
    # both fields of a function in one pass over its table
    both = func.select(F.col("func_id").alias("record"), F.explode(F.array(of("value_type", types), of("func_annotation", notes))).alias("x")).select("x.field", "record", "x.terms")
    return both.unionByName(clazz.select(F.lit("clazz_annotation").alias("field"), F.col("clazz_id").alias("record"), stripped(notes).alias("terms")))
