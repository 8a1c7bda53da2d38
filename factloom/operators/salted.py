"""Per-key results where a few keys hold most records.

Two-stage salted aggregation: heavy keys get a salt, partial results are made per (key, salt) and
then merged by the original key. The salt is a hash of the record id rather than a random number:
it spreads a key as evenly, gives a retried task the same result, and puts all copies of a record
under one salt, so that even distinct counts can be merged by adding.

A key is heavy by its share of all rows, which also bounds how many heavy keys there can be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.keys import hash64
from factloom.runtime import fresh, materialize

#: Share of all rows above which a key is heavy, at most; it falls with the number of tasks, so that
#: no key below it is more than a task's due. One salt of a heavy key holds this share.
SHARE = 0.005


def due_share(df: DataFrame) -> float:
    """What a task should get of all rows at most."""
    return min(SHARE, 1 / int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(rows: DataFrame, keys: Sequence[str], share: float | None = None) -> DataFrame:
    """(_key, _salts) of the keys that hold more than ``share`` of the rows: a hash of the key and
    the number of salts it needs. There are fewer than 1 / share of them, with fewer than
    2 / share salts in all.

    Rows are counted before the shuffle, so a hot key sends one number per task; what is shuffled
    is two longs. Keys that share a hash are heavy together, which costs a salt and nothing else.
    """
    share = due_share(rows) if share is None else share
    counts = rows.groupBy(hash64(*keys).alias("_key")).agg(F.count("*").alias("_n"))
    # two steps, so that the total is not a scan of its own and no window holds all keys
    counts = materialize(counts, "key-counts")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return counts.filter(F.col("_n") > total * share).select("_key", F.ceil(F.col("_n") / F.lit(max(total * share, 1.0))).cast("int").alias("_salts"))


def salted(rows: DataFrame, keys: Sequence[str], record: Sequence[str], share: float | None = None) -> DataFrame:
    """``rows`` with a last column ``_salt``: 0, or for heavy keys a number given by the record id.

    If ``rows`` has such a column, the new one's name gets an underscore more.
    """
    n, salt_, own = fresh(rows, "_salts", "_salt", "_key")
    heavy = heavy_keys(rows, keys, share).select(F.col("_key").alias(own), F.col("_salts").alias(n))
    # fewer than 1 / share rows of 12 bytes, whatever the input
    joined = rows.withColumn(own, hash64(*(f"`{k}`" for k in keys))).join(F.broadcast(heavy), own, "left")
    # mixed once more: the record's own hash may decide elsewhere already
    salt = F.when(F.col(n).isNotNull(), F.pmod(hash64(F.lit("salt"), *record), F.col(n))).otherwise(0)
    return joined.withColumn(salt_, salt.cast("int")).drop(n, own)


def salted_aggregate(
    rows: DataFrame, keys: Sequence[str], record: Sequence[str], partial: dict[str, Column], merge: dict[str, Column], share: float | None = None, once: dict[str, Column] | None = None
) -> DataFrame:
    """Aggregate ``rows`` per key in two stages.

    once: aggregates per (key, record), which make one row of a record's copies, as all of them have
    one salt. partial: aggregates per (key, salt), of the rows or of what ``once`` gives. merge:
    aggregates of those columns per key. Null keys are a key of their own, as in groupBy. An empty
    table gives no row.
    """
    split = salted(rows, keys, record, share)
    salt_ = split.columns[-1]
    if once:
        # partitioned by key and salt alone, so the next two steps need no further shuffle
        split = split.repartition(*(F.col(f"`{k}`") for k in keys), F.col(salt_)).groupBy(*keys, salt_, *record).agg(*(c.alias(n) for n, c in once.items()))
    first = split.groupBy(*keys, F.col(salt_).alias("_salt")).agg(*(c.alias(n) for n, c in partial.items()))
    return first.groupBy(*keys).agg(*(c.alias(n) for n, c in merge.items()))


def element_counts(df: DataFrame, values: str, keep: Sequence[str]) -> DataFrame:
    """One row per row and distinct non-null element of the list ``values``: the columns ``keep``,
    ``value`` and ``n``, its number in that list. The list is sorted once and cut into runs."""
    rows = df.select(*keep, F.array_sort(F.filter(values, lambda x: x.isNotNull())).alias("_s")).filter(F.size("_s") > 0)
    start = F.filter(F.sequence(F.lit(1), F.size("_s")), lambda i: (i == 1) | (F.element_at("_s", i) != F.element_at("_s", F.greatest(i - 1, F.lit(1)))))
    rows = rows.withColumn("_i", start)
    runs = F.transform("_i", lambda i, k: F.struct(F.element_at("_s", i).alias("value"), (F.coalesce(F.get("_i", k + 1), F.size("_s") + 1) - i).cast("bigint").alias("n")))
    return rows.select(*keep, F.inline(runs))


def _signatures(func: DataFrame, ctx: DataFrame) -> DataFrame:
    """(field, h1, h2, signature, record, n) of both tables; 128 bits stand for a signature, since two
    of 10^12 share them with odds of 10^-15."""
    f = func.select(F.lit("signature").alias("field"), "signature", F.col("func_id").alias("record"), F.lit(1).cast("bigint").alias("n"))
    c = element_counts(ctx, "reverse_calls", ["ctx_id"]).select(F.lit("reverse_calls").alias("field"), F.col("value").alias("signature"), F.col("ctx_id").alias("record"), "n")
    both = f.unionByName(c)
    return both.select("field", hash64("signature").alias("h1"), hash64(F.lit(1), "signature").alias("h2"), "signature", "record", "n")


def _counted(rows: DataFrame, share: float | None) -> DataFrame:
    """(field, h1, h2, n) written, as it is read for the totals, too."""
    keys = ["field", "h1", "h2"]
    sums = {"n": F.sum("n")}
    # a record's copies: a signature's number in a context is its largest in any of them
    counts = salted_aggregate(rows.drop("signature"), keys, ["record"], sums, sums, share, once={"n": F.max("n")})
    return materialize(counts, "signature-counts")


def signature_counts(func: DataFrame, ctx: DataFrame, share: float | None = None) -> DataFrame:
    """(field, signature, n, total) of fact_func.signature and of rel_funcctx.reverse_calls.

    For ``signature``, n counts records (copies of a func_id once); for ``reverse_calls``, non-null
    elements, repeats within a list included and copies of a ctx_id once (a signature's number in a
    context is its largest in any copy). total is the sum over the field; records with a null
    signature count in it, but have no row. Empty tables give no row; other columns are ignored.

    Counts are shuffled by hashes; each distinct signature is shuffled once per task, for its name.
    """
    rows = _signatures(func, ctx)
    counts = _counted(rows, share)
    totals = counts.groupBy("field").agg(F.sum("n").alias("total"))
    names = rows.select("field", "h1", "h2", "signature").distinct().filter(F.col("signature").isNotNull())
    # two rows
    return names.join(counts, ["field", "h1", "h2"]).join(F.broadcast(totals), "field").select("field", "signature", "n", "total")


def heavy_signatures(func: DataFrame, ctx: DataFrame, over: float = 0.02, share: float | None = None) -> DataFrame:
    """(field, signature, n, total) of signatures that make up more than ``over`` of their field.

    Names are read for the winners alone, of which there are fewer than 2 / ``over``.
    """
    rows = _signatures(func, ctx)
    counts = _counted(rows, share)
    totals = counts.groupBy("field").agg(F.sum("n").alias("total"))
    heavy = counts.join(F.broadcast(totals), "field").filter(F.col("n") > F.col("total") * over)
    named = rows.select("field", "h1", "h2", "signature").join(F.broadcast(heavy), ["field", "h1", "h2"])
    return named.select("field", "signature", "n", "total").filter(F.col("signature").isNotNull()).distinct()
