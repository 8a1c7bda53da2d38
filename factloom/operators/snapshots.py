"""What changed between consecutive full snapshots.

Rows are reduced to a key hash and a row hash and bucketed by key, so that all snapshots of a key
meet in one task. There the arrays are sorted in numpy, and the differences of every two
consecutive snapshots come from searchsorted. Full values are read again only for keys that differ:
by a broadcast of these, or behind a filter of them, so the other rows are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.canonical import json_value_hash
from factloom.operators.keyfilter import join_keys
from factloom.operators.keys import hash64
from factloom.runtime import materialize, plan_bytes

#: Rows of compact arrays that one task sorts (about 40 bytes each).
ROWS_PER_BUCKET = 1_000_000
#: Bytes on disk up to which differing keys or revisions are broadcast; beyond, they are shuffled.
BROADCAST_BYTES = 8 << 20
CHANGES = ("added", "removed", "changed")


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if plan_bytes(df) <= BROADCAST_BYTES else df


def chains(snapshots: DataFrame, revisions: DataFrame, chain: Sequence[str], snapshot: Sequence[str], order: str) -> DataFrame:
    """(snapshot..., chain id, ordinal, number of snapshots) of the revisions that have rows.

    A revision registered twice counts with its smaller time; equal times are ordered by the
    revision's name, null times come first. Neighbours are neighbours among those having rows.
    """
    once = revisions.groupBy(*chain, *(c for c in snapshot if c not in chain)).agg(F.min(order).alias("_at"))
    there = once.join(snapshots, list(snapshot), "left_semi")
    w = Window.partitionBy(*chain)
    return there.select(
        *snapshot, hash64(*chain).alias("chain"), (F.row_number().over(w.orderBy(F.col("_at").asc_nulls_first(), *snapshot)) - 1).alias("ord"), F.count("*").over(w).cast("int").alias("n")
    )


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = list(batches)
    names = ["chain", "ord", "key", "change", "source"]
    if not batches:
        return
    chain, ordinal, n, key, row = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in range(5))
    if not len(key):
        return
    chains_, c = np.unique(chain, return_inverse=True)
    size = np.zeros(len(chains_), np.int64)
    size[c] = n
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    keys_, k = np.unique(key, return_inverse=True)
    width = len(keys_)
    place = (base[c] + ordinal) * width + k
    order = np.lexsort((row, place))
    place, row, c, ordinal, k = place[order], row[order], c[order], ordinal[order], k[order]
    first = np.concatenate([[True], place[1:] != place[:-1]])  # copies of a row
    place, row, c, ordinal, k = place[first], row[first], c[first], ordinal[first], k[first]
    last = len(place) - 1
    after = np.minimum(np.searchsorted(place, place + width), last)
    follows = place[after] == place + width
    before = np.minimum(np.searchsorted(place, place - width), last)
    precedes = place[before] == place - width
    more = ordinal + 1 < size[c]
    added, removed, changed = (ordinal > 0) & ~precedes, more & ~follows, more & follows & (row != row[after])
    for kind, hit, start, source in ((0, added, -1, 0), (1, removed, 0, 0), (2, changed, 0, 1)):
        at = np.flatnonzero(hit)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(chains_[c[at]], pa.int64()), pa.array((ordinal[at] + start).astype(np.int32)), pa.array(keys_[k[at]], pa.int64()), pa.array(np.full(len(at), kind, np.int8)), pa.array((ordinal[at] + source).astype(np.int32))], names=names
            )


def snapshot_changes(rows: DataFrame, revisions: DataFrame, chain: Sequence[str], snapshot: Sequence[str], order: str, key: Sequence[str], row_hash: Column) -> DataFrame:
    """Added, removed and changed keys of consecutive snapshots.

    rows: all snapshots; ``snapshot`` names a snapshot's columns, ``key`` a row's, ``row_hash`` is a
    64-bit hash of what is compared. revisions: (chain..., snapshot..., order). Result: the chain's
    first column, from_rev, to_rev, the key columns and change.

    Copies of a key within a snapshot count once. Null key parts are values of their own. Snapshots
    without rows, and rows of unregistered snapshots, take no part. Two keys of one snapshot share
    a hash with odds of n^2 / 2^65. Empty tables give no row.
    """
    spark = rows.sparkSession
    counts = materialize(rows.groupBy(*snapshot).count(), "snapshots")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    revs = materialize(chains(counts, revisions, chain, snapshot, order), "chains")
    rid, kid = hash64(*snapshot), hash64(*key)
    known = revs.select(hash64(*snapshot).alias("rid"), "chain", "ord", "n")
    compact = rows.select(rid.alias("rid"), kid.alias("key"), row_hash.alias("row")).join(_bounded(known), "rid").select("chain", "ord", "n", "key", "row")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / ROWS_PER_BUCKET))
    found = compact.repartition(buckets, "chain", "key").mapInArrow(_differences, "chain bigint, ord int, key bigint, change tinyint, source int")
    # the names of both revisions are put to the differing keys while these are a few longs
    side = lambda prefix, order: revs.select("chain", order.alias("from_ord"), F.col(snapshot[-1]).alias(f"{prefix}_rev"))
    sources = revs.select("chain", F.col("ord").alias("source"), hash64(*snapshot).alias("rid"))
    differing = found.withColumnRenamed("ord", "from_ord").join(_bounded(sources), ["chain", "source"])
    differing = differing.join(_bounded(side("from", F.col("ord"))), ["chain", "from_ord"]).join(_bounded(side("to", F.col("ord") - 1)), ["chain", "from_ord"])
    differing = materialize(differing.select("rid", "key", "from_rev", "to_rev", "change"), "differing-keys")
    # then the full key of the differing rows only
    named = join_keys(rows.select(*(F.col(c).alias(f"_f{i}") for i, c in enumerate((chain[0], *key))), rid.alias("_rid"), kid.alias("_kid")), [F.col("_rid"), F.col("_kid")], differing, BROADCAST_BYTES)
    change = F.element_at(F.array(*(F.lit(c) for c in CHANGES)), F.col("change").cast("int") + 1)
    return named.select(F.col("_f0").alias(chain[0]), "from_rev", "to_rev", *(F.col(f"_f{i + 1}").alias(c) for i, c in enumerate(key)), change.alias("change")).distinct()


def function_row_hash() -> Column:
    """Hash of what makes two versions of a function differ; null and empty values are the same."""
    text = lambda c: F.coalesce(c, F.lit(""))
    units = lambda c: F.transform(F.coalesce(c, F.array()), lambda v: F.struct(v.isNull().alias("x"), text(v["type"]).alias("t"), text(v["name"]).alias("n")))
    points = [F.col(f"{s}.{e}.{x}") for s in ("span", "body_span") for e in ("start", "end") for x in ("row", "column")]
    return hash64(*(text(F.col(c)) for c in ("name", "receiver", "namespace", "lang")), F.size(units("parameters")), units("parameters"), units("returns"), "def_line", *points, json_value_hash("extras"))


def function_changes(func: DataFrame, revisions: DataFrame) -> DataFrame:
    """Functions added, removed and changed between consecutive revisions of each branch.

    Nulls, copies and empty tables as in :func:`snapshot_changes`; extras that are no JSON compare
    as text. Other columns are ignored.
    """
    return snapshot_changes(func, revisions, ["repo_id", "branch"], ["repo_id", "rev_hash"], "create_time", ["path", "signature"], function_row_hash())
