"""References to records that do not exist.

Tables refer to each other through a graph of foreign keys. A reference whose target is missing,
deleted or late is a direct orphan, and the record that holds it is an orphaned record. The fixpoint
cascade then goes down the graph: records that refer to orphaned records are indirectly orphaned,
found by one semi-join per level until a level adds none. All of that runs on hashes of keys; texts
are read again for the orphans only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from factloom.operators.keyfilter import join_keys
from factloom.operators.keys import hash64
from factloom.runtime import materialize, plan_bytes


@dataclass(frozen=True)
class Table:
    """A referenced or referring table: its record id, its key and the time a row came."""

    name: str
    rows: DataFrame
    id: str
    key: tuple[str, ...]
    at: str


@dataclass(frozen=True)
class Reference:
    """Column ``column`` of table ``child`` (a value or an array of values) names rows of ``parent``.

    ``scope`` are the columns that child and parent have in common; with the referring value they
    make up the parent's key, the value being its last column. Where the parent need not hold the
    row, the reference is ``optional``: no orphan by itself, it only passes on that of its target.
    """

    child: str
    column: str
    parent: str
    scope: tuple[str, ...] = ()
    optional: bool = False


@dataclass
class Graph:
    tables: dict[str, Table]
    references: Sequence[Reference]
    #: per parent table, a log of deleted keys (columns as in the parent's key)
    deleted: dict[str, DataFrame] = field(default_factory=dict)


def _is_list(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() == "array"


def _tagged(values: Column, field_name: str) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(field_name).alias("ref_field"), v.cast("string").alias("value")))


def _references(graph: Graph, refs: Sequence[Reference]) -> DataFrame:
    """(src_table, src_id, ref_field, key parts..., value, at) of references to one parent.

    A child table is read once for all its referring columns, and repeated elements of a list fall
    away within the row.
    """
    parent = graph.tables[refs[0].parent]
    names = parent.key[:-1]
    out = None
    for child in dict.fromkeys(r.child for r in refs):
        t = graph.tables[child]
        lists = []
        for r in (r for r in refs if r.child == child):
            values = F.array_distinct(r.column) if _is_list(t.rows, r.column) else F.array(r.column)
            lists.append(_tagged(values, r.column))
        scope = next(r.scope for r in refs if r.child == child)
        one = t.rows.select(F.lit(t.name).alias("src_table"), F.col(t.id).alias("src_id"), *(F.col(c).alias(n) for c, n in zip(scope, names)), F.col(t.at).alias("at"), F.explode(F.concat(*lists)).alias("r"))
        one = one.select("src_table", "src_id", "r.ref_field", *names, "r.value", "at").filter(F.col("value").isNotNull())
        out = one if out is None else out.unionByName(one)
    return out


def _key128(names: Sequence[str | Column]) -> list[Column]:
    """The key as two independent 64-bit hashes. At 10^12 distinct keys the odds that any two
    agree in both are about 10^-15, so equality of the pair stands for equality of the key."""
    return [hash64(*names, "value").alias("h1"), hash64(F.lit(1), *names, "value").alias("h2")]


#: Bytes on disk up to which the set of problem keys is broadcast; beyond, it is joined by shuffle.
BROADCAST_BYTES = 8 << 20


def direct(graph: Graph) -> DataFrame:
    """Non-optional references without a target in time: (src_table, src_id, ref_field, key parts..., signature,
    at, status).

    status: ``late`` if targets exist but all came after the referring record first came,
    ``deleted`` if there is none and the deletion log names the key, else ``missing``. One row per
    distinct reference: copies of a record and repeated elements count once, a record's time is the
    earliest of its copies. Null elements are no references; a record with a null id is reported
    under null. Keys are compared exactly, a null part equals a null; a null time is never late. An
    empty table gives no row; other columns are ignored.

    The search for problem keys shuffles only hashes and times, aggregated on both sides before the
    shuffle, so a hot key is one row per task on either side. References are then joined to the
    problem keys: by broadcast while the measured size of these allows it, else by a shuffle of the
    references that pass a filter of the keys.
    """
    out, binding = None, [r for r in graph.references if not r.optional]
    for parent in dict.fromkeys(r.parent for r in binding):
        p = graph.tables[parent]
        names = list(p.key[:-1])
        keyed = lambda df, at: df.select(*names, F.col(p.key[-1]).alias("value"), at).filter(F.col("value").isNotNull())
        rows = _references(graph, [r for r in binding if r.parent == parent])
        targets = keyed(p.rows, F.col(p.at).alias("at")).select(*_key128(names), "at").groupBy("h1", "h2").agg(F.min("at").alias("came"), F.lit(True).alias("is_there"))
        asked = rows.select(*_key128(names), "at").groupBy("h1", "h2").agg(F.min("at").alias("asked"))
        bad = asked.join(targets, ["h1", "h2"], "left").filter(F.col("is_there").isNull() | (F.col("came") > F.col("asked")))
        if parent in graph.deleted:
            gone = keyed(graph.deleted[parent], F.lit(True).alias("gone")).select(*_key128(names), "gone").distinct()
            bad = bad.join(gone, ["h1", "h2"], "left")
        else:
            bad = bad.withColumn("gone", F.lit(None).cast("boolean"))
        bad = materialize(bad.select("h1", "h2", "came", "is_there", "gone"), "problem-keys")
        hit = join_keys(rows, _key128(names), bad, BROADCAST_BYTES)
        once = hit.groupBy("src_table", "src_id", "ref_field", *names, F.col("value").alias("signature")).agg(F.min("at").alias("at"), F.first("came").alias("came"), F.first("is_there").alias("is_there"), F.first("gone").alias("gone"))
        status = F.when(F.col("is_there").isNull(), F.when(F.col("gone"), "deleted").otherwise("missing")).when(F.col("came") > F.col("at"), "late")
        one = once.withColumn("status", status).filter(F.col("status").isNotNull()).drop("came", "is_there", "gone")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def _down(graph: Graph) -> list[Reference]:
    """The references to records that refer to others themselves."""
    return [r for r in graph.references if any(r.parent == x.child for x in graph.references)]


def _narrow(graph: Graph, down: Sequence[Reference]) -> tuple[DataFrame, DataFrame]:
    """(src_table, src_id, h1, h2) of the records that are referred to and (src_table, src_id,
    ref_field, h1, h2) of the references to them: the graph in hashes, read once from the tables."""
    nodes = edges = None
    for parent in dict.fromkeys(r.parent for r in down):
        p = graph.tables[parent]
        names = list(p.key[:-1])
        keyed = p.rows.select(F.lit(p.name).alias("src_table"), F.col(p.id).alias("src_id"), *names, F.col(p.key[-1]).alias("value")).filter(F.col("value").isNotNull())
        n = keyed.select("src_table", "src_id", *_key128([F.lit(parent), *names]))
        e = _references(graph, [r for r in down if r.parent == parent]).select("src_table", "src_id", "ref_field", *_key128([F.lit(parent), *names]))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    return materialize(nodes.distinct(), "referred-records"), materialize(edges, "references")


def _bounded(df: DataFrame) -> DataFrame:
    """To be broadcast if its measured size allows it; for written tables and what is narrow on them."""
    return F.broadcast(df) if plan_bytes(df) <= BROADCAST_BYTES else df


#: Levels after which the sets of orphaned records are made one table.
FOLD = 10


def cascade(graph: Graph, max_levels: int | None = None) -> DataFrame:
    """Direct and inherited orphans: the columns of :func:`direct` plus ``kind`` and ``level``.

    Level 0 holds the direct orphans. A reference to a record orphaned at level n is an inherited
    orphan of level n + 1 with status ``inherited``; a record counts at its smallest level only, and
    one with a null id passes nothing on. The loop ends when no referring record is new, or at once
    where no table refers to one that holds orphans.

    The fixpoint runs on hashes and record ids alone; the texts of inherited orphans are read once
    at the end, and only where they are asked for. Each level is written to the shared folder, so
    that neither lineage nor the loss of an executor grows with the number of levels.
    """
    level0 = direct(graph).withColumns({"kind": F.lit("direct"), "level": F.lit(0)})
    down = _down(graph)
    if not down:
        return level0
    found = materialize(level0, "orphans")
    nodes, edges = _narrow(graph, down)
    record, key = ["src_table", "src_id"], ["h1", "h2"]
    seen, frontier, level, levels = [found.select(*record)], found.select(*record), 0, []
    while max_levels is None or level < max_levels:
        level += 1
        lost = materialize(nodes.join(_bounded(frontier), record, "left_semi").select(*key).distinct(), f"lost-{level}")
        hit = edges.join(_bounded(lost), key, "left_semi").join(_bounded(reduce(DataFrame.unionByName, seen)), record, "left_anti")
        n = Observation()
        # without the level's number, so that every level runs the code compiled for the first
        fresh = materialize(hit.distinct().observe(n, F.count(F.lit(1)).alias("n")), f"inherited-{level}")
        if not n.get["n"]:
            break
        levels.append(fresh.withColumn("level", F.lit(level)))
        frontier = fresh.select(*record)
        seen.append(frontier)
        if len(seen) > FOLD:  # so that plans stay short however deep the graph is
            seen = [materialize(reduce(DataFrame.unionByName, seen).distinct(), f"orphaned-{level}")]
    for k, part in enumerate(levels):
        levels[0] = levels[0].unionByName(part) if k else part
    return found.unionByName(_named(graph, down, levels[0]), allowMissingColumns=True) if levels else found


def _named(graph: Graph, down: Sequence[Reference], inherited: DataFrame) -> DataFrame:
    """Inherited orphans with their keys' texts."""
    keys = materialize(inherited.select("h1", "h2").distinct(), "inherited-keys")
    out = None
    for parent in dict.fromkeys(r.parent for r in down):
        names = list(graph.tables[parent].key[:-1])
        rows = join_keys(_references(graph, [r for r in down if r.parent == parent]), _key128([F.lit(parent), *names]), keys, BROADCAST_BYTES)
        own = inherited.select(*(F.col(c).alias(f"_{c}") for c in ("src_table", "src_id", "ref_field", "h1", "h2")), "level")
        same = rows["src_id"].eqNullSafe(own["_src_id"])
        for c in ("src_table", "ref_field", "h1", "h2"):
            same &= rows[c] == own[f"_{c}"]
        one = rows.join(own, same).groupBy("src_table", "src_id", "ref_field", *names, F.col("value").alias("signature"), "level").agg(F.min("at").alias("at"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.withColumns({"status": F.lit("inherited"), "kind": F.lit("inherited")})


def report(orphans: DataFrame, *by: str) -> DataFrame:
    """Orphans per referring table, field, day and status, and per columns ``by``, such as kind."""
    return orphans.groupBy("src_table", "ref_field", F.date_format("at", "yyyy-MM-dd").alias("day"), "status", *by).agg(F.count("*").alias("n_refs"), F.count_distinct("src_id").alias("n_records"))


def code_graph(func: DataFrame, ctx: DataFrame, tag: DataFrame, drop: DataFrame, calls_between_contexts: bool = False) -> Graph:
    """References of contexts and tags to functions; with ``calls_between_contexts`` also those of
    a context's calls to the contexts of what it calls, along which orphans are inherited. Not every
    function has a context, so these are optional."""
    key = ("repo_id", "rev_hash", "signature")
    tables = {"fact_func": Table("fact_func", func, "func_id", key, "ingest_ts"), "rel_funcctx": Table("rel_funcctx", ctx, "ctx_id", key, "ingest_ts"), "func_tag": Table("func_tag", tag, "tag_id", key, "ingest_ts")}
    scope = ("repo_id", "rev_hash")
    refs = [Reference("rel_funcctx", c, "fact_func", scope) for c in ("signature", "calls", "reverse_calls")] + [Reference("func_tag", "signature", "fact_func", scope)]
    deep = [Reference("rel_funcctx", "calls", "rel_funcctx", scope, True), Reference("func_tag", "signature", "rel_funcctx", scope, True)]
    return Graph(tables, refs + deep * calls_between_contexts, {"fact_func": drop})
