"""Call chains of bounded depth over stored contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.facts import SCOPE, first_by
from factloom.runtime import materialize


def successors(ctx: DataFrame, reverse: bool = False) -> DataFrame:
    """(repo_id, rev_hash, node, next): one context per signature, that of the smallest path and row."""
    column = "reverse_calls" if reverse else "calls"
    one = first_by(ctx.filter(F.col("signature").isNotNull()), [*SCOPE, "signature"], [F.col("path"), F.col("span.start.row"), F.col("span.end.row"), F.col(column)])
    return one.select(*SCOPE, F.col("signature").alias("node"), F.array_distinct(F.filter(column, lambda s: s.isNotNull())).alias("next"))


def chains(ctx: DataFrame, starts: DataFrame, depth: int, reverse: bool = False, materialize_beyond: int = 2) -> DataFrame:
    """(repo_id, rev_hash, start, chain) of the call chains from each start (repo_id, rev_hash, signature).

    A chain leaves out its start. It ends where a node has no successor or its length exceeds
    ``depth``, so it has up to depth + 1 nodes. A successor that is in the chain already is left
    out; if that leaves none, the chain is not given. The start itself may come back once. A start
    without a context, or with no calls, gives an empty chain; an unknown node within a chain is a
    leaf. Each level is one join, all starts at once.
    """
    if depth < 0:
        raise ValueError("depth must not be negative")
    edges = materialize(successors(ctx, reverse), "successors")
    front = starts.select(*SCOPE, F.col("signature").alias("start")).distinct().select(*SCOPE, "start", F.col("start").alias("node"), F.array().cast("array<string>").alias("chain"))
    done = None
    for level in range(depth + 2):
        seen = front.join(edges, [*SCOPE, "node"], "left") if level <= depth else front.withColumn("next", F.lit(None).cast("array<string>"))
        ends = F.coalesce(F.size("next"), F.lit(0)) <= 0
        ended = seen.filter(ends).select(*SCOPE, "start", "chain")
        done = ended if done is None else done.unionByName(ended)
        if level > depth:
            break
        more = seen.filter(~ends).select(*SCOPE, "start", F.explode(F.filter("next", lambda s: ~F.array_contains("chain", s))).alias("node"), "chain")
        front = more.select(*SCOPE, "start", "node", F.array_append("chain", F.col("node")).alias("chain"))
        if level >= materialize_beyond:
            front = materialize(front, "chains")
    return done


def prefixes(found: DataFrame) -> DataFrame:
    """(repo_id, rev_hash, start, chain, depth): the nodes of the tree that the chains make up."""
    cut = found.select(*SCOPE, "start", F.explode(F.when(F.size("chain") > 0, F.transform(F.sequence(F.lit(1), F.size("chain")), lambda n: F.slice("chain", F.lit(1), n)))).alias("chain"))
    return cut.distinct().withColumn("depth", F.size("chain"))
