"""Messages delivered more than once: exactly one copy of each stays.

What is shuffled is the identifier (two longs), the order of delivery and the row's position in its
file. Per identifier the winner is selected, the losers' positions become one deletion vector per
file, and the wide payloads are read with these vectors applied - they are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.keys import hash64
from factloom.runtime import materialize, plan_bytes

#: Bytes on disk up to which the deletion vectors are broadcast to the readers.
BROADCAST_BYTES = 8 << 20
#: Rows of a file that one deletion vector covers, so a vector has at most VECTOR / 8 bytes.
VECTOR = 1 << 20


def uuid_hex(c: str | Column) -> Column:
    """The 32 lower-case hex digits of a UUID in any usual notation, null for anything else.

    Surrounding white space, ``urn:uuid:``, braces or brackets, hyphens and letter case don't count.
    """
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t\r\n\x0b\x0c"))), r"^(urn:)?(uuid:)?[{(]?|[)}]$|-", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def _halves(digits: Column) -> list[Column]:
    half = lambda a: F.conv(F.concat(F.lit("0"), F.substring(digits, a, 16)), 16, -10).cast("bigint")
    return [half(1).alias("u1"), half(17).alias("u2")]


def position(df: DataFrame) -> list[Column]:
    """File and row of each row of a file-based table, whatever columns it has."""
    meta = df.metadataColumn("_metadata")
    return [F.xxhash64(meta["file_path"]).alias("_file"), meta["row_index"].alias("_row")]


def _whole(df: DataFrame, c: str) -> Column:
    """A whole number or a time as a long that sorts like it."""
    col = F.col(f"`{c}`") if "." not in c else F.col(c)
    return F.unix_micros(col.cast("timestamp")) if df.select(col).schema[0].dataType.typeName().startswith("timestamp") else col.cast("bigint")


def delivered(df: DataFrame, identifier: Column, order: str) -> DataFrame:
    """(u1, u2, order, file, row) of each message of a file-based table: all that gets shuffled."""
    rows = df.select(identifier.alias("_u"), _whole(df, order).alias("_order"), *position(df))
    return rows.filter(F.col("_u").isNotNull()).select(*_halves(F.col("_u")), "_order", "_file", "_row")


#: Bits of a position's hash in a packed rank, and what makes an order positive.
_BITS, _SIGN = 62, 1 << 63


def _packed(order: Column, file: Column, row: Column) -> Column:
    """Order and position as one number, which a hash aggregation can keep the least of in place (of
    a struct it could not): the order in the high bits, a hash of the position below. Null orders
    come last. Below 2^127, so 38 digits hold it."""
    wide = lambda c: c.cast("decimal(20,0)")
    place = F.xxhash64(file, row).bitwiseAND(F.lit((1 << _BITS) - 1))
    high = F.coalesce(wide(order.cast("bigint")) + F.lit(str(_SIGN)).cast("decimal(20,0)"), F.lit(str(2 * _SIGN)).cast("decimal(20,0)"))
    return (high.cast("decimal(20,0)") * F.lit(str(1 << _BITS)).cast("decimal(19,0)")).cast("decimal(38,0)") + wide(place)


def losers(df: DataFrame, identifier: Column, order: str) -> DataFrame:
    """Positions of all copies but the first: (_order, _first, _file, _row).

    The first is the one with the smallest order, a whole number or a time; equal or null orders (nulls last)
    are settled by a hash of file and row, the same in every run. Messages without an identifier
    have no copies.

    An identifier that a third of all messages carry is settled by two aggregates: the winner is a
    minimum, found with one row per task, and a loser is any row that isn't the winner.
    """
    rows = delivered(df, identifier, order).withColumn("_rank", _packed(F.col("_order"), F.col("_file"), F.col("_row")))
    many = rows.groupBy("u1", "u2").agg(F.min("_rank").alias("_best"), F.min("_order").alias("_first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(many, ["u1", "u2"]).filter("_rank <> _best").select("_order", "_first", "_file", "_row")


def _vector(rows: np.ndarray) -> bytes:
    bits = np.zeros(int(rows.max()) // 8 + 1, np.uint8)
    np.bitwise_or.at(bits, rows // 8, (1 << (rows % 8)).astype(np.uint8))
    return bits.tobytes()


def deletion_vectors(lost: DataFrame) -> DataFrame:
    """(_file, _part, _bits): per file and VECTOR rows, a bitmap of the rows to leave out."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None
        for batch in batches:
            f, p, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = [0, *(np.flatnonzero((f[1:] != f[:-1]) | (p[1:] != p[:-1])) + 1), len(f)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if (k := (f[a], p[a])) != key and held:
                    yield one(key, held)
                    held = []
                key = k
                held.append(r[a:b])
        if held:
            yield one(key, held)

    def one(key, held):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([_vector(np.concatenate(held))], pa.binary())], names=["_file", "_part", "_bits"])

    rows = lost.select("_file", F.expr(f"_row div {VECTOR}").alias("_part"), (F.col("_row") % VECTOR).alias("_at"))
    return rows.repartition("_file", "_part").sortWithinPartitions("_file", "_part").mapInArrow(build, "_file bigint, _part bigint, _bits binary")


def _read_with(df: DataFrame, vectors: DataFrame, columns: Sequence[str], dead: bool) -> DataFrame:
    """The named columns of ``df``'s rows, read from its files with the vectors applied: those that
    live, or those that are ``dead``."""
    vectors = F.broadcast(vectors) if plan_bytes(vectors) <= BROADCAST_BYTES else vectors
    # the payload's columns stay inside one struct, so their names can't clash
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_all"), *position(df)).withColumn("_part", F.expr(f"_row div {VECTOR}"))
    hit = rows.join(vectors, ["_file", "_part"], "inner" if dead else "left")
    at = (F.col("_row") % VECTOR).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    gone = F.coalesce(F.getbit(byte.cast("bigint"), F.pmod(at, F.lit(8))) == 1, F.lit(False))
    return hit.filter(gone if dead else ~gone).select("_all.*")


def keep_first(df: DataFrame, identifier: Column, order: str) -> DataFrame:
    """``df``, read from files, with exactly one copy of each message and all its columns.

    Messages with a null or unreadable identifier all stay. Of equal orders the first by a hash of
    file and row stays, null orders come last; rows repeated in full are copies like any other. An
    empty table gives no row, and columns may have any names.

    The deletion vectors are small beside the payloads; they are broadcast while their measured
    size allows it, else joined by file.
    """
    vectors = materialize(deletion_vectors(losers(df, identifier, order)), "deletion-vectors")
    return _read_with(df, vectors, df.columns, dead=False)


def keep_latest(df: DataFrame, key: Sequence[str], at: str, tie: str) -> DataFrame:
    """``df``, read from files, with the row of each key that came last: that with the largest ``at``,
    then ``tie`` (nulls before all others), then by a hash of its position.

    As for messages, what is shuffled is two hashes of the key, the order and the position, and the
    rows themselves are read with deletion vectors applied. Null key parts are values. An empty
    table gives no row, and columns may have any names.
    """
    cols = [F.col(k) for k in key]
    rows = df.select(hash64(*cols).alias("k1"), hash64(F.lit(1), *cols).alias("k2"), _whole(df, at).alias("_at"), _whole(df, tie).alias("_tie"), *position(df))
    rank = F.struct(F.col("_at").isNotNull().alias("a"), F.col("_at").alias("b"), F.col("_tie").isNotNull().alias("c"), F.col("_tie").alias("d"), F.xxhash64("_file", "_row").alias("e"), F.col("_file").alias("f"), F.col("_row").alias("g"))
    many = rows.groupBy("k1", "k2").agg(F.max(rank).alias("w"), F.count("*").alias("n")).filter("n > 1").select("k1", "k2", "w.f", "w.g")
    lost = rows.join(many, ["k1", "k2"]).filter("_file <> f or _row <> g").select("_file", "_row")
    return _read_with(df, materialize(deletion_vectors(lost), "deletion-vectors"), df.columns, dead=False)


def duplicate_deliveries(messages: DataFrame) -> DataFrame:
    """Deliveries whose message came before under a smaller delivery_id, as the deletion vectors of
    the files give them: what they mark is read, nothing but its delivery_id.

    Null and unreadable msg_ids and null delivery_ids give no row; of equal delivery_ids none is
    smaller. An empty table gives no row.
    """
    lost = losers(messages, uuid_hex("msg_id"), "delivery_id").filter(F.col("_order") > F.col("_first"))
    vectors = materialize(deletion_vectors(lost), "deletion-vectors")
    return _read_with(messages, vectors, ["delivery_id"], dead=True)
