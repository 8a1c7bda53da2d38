"""The reference graph between functions: by name and position, not by types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import names, spans
from factloom.operators.keys import hash64
from factloom.runtime import materialize

#: A name whose definitions times references exceed this has no edges.
REF_LIMIT = 1024
#: Bytes that a name needs at least to be looked up.
NAME_BYTES = 4
#: Rows of a file that make a bucket: a symbol is compared with the bodies that reach into its bucket,
#: so the work grows with the lines of a file and how deep functions nest, not with their product.
BUCKET = 64


def _buckets(span: str) -> Column:
    first, last = (F.floor(F.col(f"{span}.{e}.row") / BUCKET) for e in ("start", "end"))
    return F.explode(F.sequence(first, F.greatest(first, last)))


def _bodies(func: DataFrame, scope: Sequence[str], *columns: Column) -> DataFrame:
    """Function bodies per bucket of rows that they reach into."""
    f = func.filter(F.col("body_span.start.row").isNotNull() & F.col("body_span.end.row").isNotNull())
    return f.select(*scope, "path", F.col("body_span").alias("_body"), *columns, _buckets("body_span").alias("_bucket"))


def _placed(symbols: DataFrame) -> DataFrame:
    whole = symbols.filter(F.col("span.start.row").isNotNull() & F.col("span.end.row").isNotNull())
    return whole.select("*", _buckets("span").alias("_bucket"))


def symbols_in_bodies(func: DataFrame, symbols: DataFrame, scope: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Distinct symbols that lie in the body of some function of their file.

    A semi-join on file and bucket of rows, with the columns as a condition on top.
    """
    at = [*scope, "path", "_bucket"]
    f = _bodies(func, scope).select(*(F.col(c).alias(f"{c}_f") for c in at), "_body")
    on = spans.touches("_body", "span")
    for c in at:
        on &= F.col(c) == F.col(f"{c}_f")
    return _placed(symbols).join(f, on, "left_semi").drop("_bucket").distinct()


def names_within_limit(func: DataFrame, symbols: DataFrame, scope: Sequence[str] = ("repo_id",), limit: int = REF_LIMIT) -> DataFrame:
    """(scope..., name, n_defs, n_refs) of names whose definitions times references are in the limit.

    Both numbers are counted before anything is joined, so a name of a million references costs
    two numbers.
    """
    defs = func.filter(F.octet_length("name") >= NAME_BYTES).groupBy(*scope, "name").agg(F.count("*").alias("n_defs"))
    refs = symbols.groupBy(*scope, F.col("symbol").alias("name")).agg(F.count("*").alias("n_refs"))
    return defs.join(refs, [*scope, "name"]).filter(F.col("n_defs") * F.col("n_refs") <= limit)


def require_unique(func: DataFrame, scope: Sequence[str] = ("repo_id",)) -> DataFrame:
    """``func``, unless two of its functions are one vertex (path, span and signature): ValueError."""
    twice = func.groupBy(*scope, names.vertex().alias("vertex")).count().filter("count > 1").first()
    if twice:
        raise ValueError(f"vertex exists already: {twice['vertex']}")
    return func


def call_edges(func: DataFrame, symbols: DataFrame, scope: Sequence[str] = ("repo_id",), limit: int = REF_LIMIT) -> DataFrame:
    """(scope..., caller_id, callee_id), each edge once, as a written table.

    func: scope, func_id, path, unit_ordinal, name, span, body_span, signature; read three times, so
    it should be a written table. symbols: scope, path, symbol, span; repeated ones count once.

    A reference calls every function of its name; the caller is the first function, in file order,
    whose body touches the reference and which isn't the callee itself. "Itself" means equal span
    and signature, whatever the file, so at most the first two such functions matter and only these
    are kept per reference before definitions are joined. Symbols that name no function fall away
    before they are joined to bodies.
    """
    defs = func.filter(F.octet_length("name") >= NAME_BYTES).select(*scope, "name", F.col("func_id").alias("callee_id"), *_description("callee"))
    defined = defs.select(*scope, F.col("name").alias("symbol")).distinct()
    named = _placed(symbols.select(*scope, "path", "symbol", "span").join(defined, [*scope, "symbol"], "left_semi"))
    bodies = _bodies(func, scope, "unit_ordinal", F.col("func_id").alias("caller_id"), *_description("caller"))
    hit = named.join(bodies, [*scope, "path", "_bucket"]).filter(spans.touches("_body", "span"))
    # as many hosts as functions nest around one place
    hosts = hit.groupBy(*scope, "path", F.col("symbol").alias("name"), "span").agg(F.sort_array(F.collect_set(F.struct("unit_ordinal", "caller_id", "caller_1", "caller_2"))).alias("h"))
    other = F.get(F.filter("h", lambda x: (x["caller_1"] != F.col("h")[0]["caller_1"]) | (x["caller_2"] != F.col("h")[0]["caller_2"])), F.lit(0))
    refs = materialize(hosts.select(*scope, "name", F.col("h")[0].alias("first"), other.alias("second")), "references")
    n_defs, n_refs = (df.groupBy(*scope, "name").agg(F.count("*").alias(n)) for df, n in ((defs, "n_defs"), (refs, "n_refs")))
    known = n_defs.join(n_refs, [*scope, "name"]).filter(F.col("n_defs") * F.col("n_refs") <= limit).select(*scope, "name")
    pairs = refs.join(known, [*scope, "name"], "left_semi").join(defs, [*scope, "name"])
    own = (F.col("first.caller_1") == F.col("callee_1")) & (F.col("first.caller_2") == F.col("callee_2"))
    caller = F.when(own, F.col("second.caller_id")).otherwise(F.col("first.caller_id"))
    edges = pairs.select(*scope, caller.alias("caller_id"), "callee_id").filter(F.col("caller_id").isNotNull()).distinct()
    return materialize(edges, "edges")


def _description(prefix: str) -> list[Column]:
    """Span and signature as 128 bits, which stand for them."""
    return [hash64(names.desc()).alias(f"{prefix}_1"), hash64(F.lit(1), names.desc()).alias(f"{prefix}_2")]


def _both_ways(edges: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope..., func_id, other, calls): each edge from either end."""
    end = lambda me, other, calls: F.struct(F.col(me).alias("func_id"), F.col(other).alias("other"), F.lit(calls).alias("calls"))
    return edges.select(*scope, F.inline(F.array(end("caller_id", "callee_id", True), end("callee_id", "caller_id", False))))


def _sets(value: str) -> list[Column]:
    return [F.sort_array(F.collect_set(F.when(F.col("_calls") == calls, F.col(value)))).alias(n) for n, calls in (("calls", True), ("reverse_calls", False))]


def neighbours(edges: DataFrame, scope: Sequence[str] = ("repo_id",)) -> DataFrame:
    """(scope..., func_id, calls, reverse_calls) of functions that have any, as sorted sets of ids.

    Edges are stored once; the reverse direction is the same rows read the other way.
    """
    return _both_ways(edges, scope).withColumnRenamed("calls", "_calls").groupBy(*scope, "func_id").agg(*_sets("other"))


def contexts(func: DataFrame, edges: DataFrame, scope: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Every function with the sorted signatures of its direct callees and callers: both directions
    of the edges go through one join and one aggregation."""
    sig = func.select(*scope, F.col("func_id").alias("other"), "signature")
    near = _both_ways(edges, scope).withColumnRenamed("calls", "_calls").join(sig, [*scope, "other"]).groupBy(*scope, "func_id").agg(*_sets("signature"))
    none = F.array().cast("array<string>")
    return func.join(near, [*scope, "func_id"], "left").withColumns({"calls": F.coalesce("calls", none), "reverse_calls": F.coalesce("reverse_calls", none)})


def star_edges(func: DataFrame, edges: DataFrame, scope: Sequence[str] = ("repo_id",)) -> DataFrame:
    """(scope..., center_id, source, target): the star of each function, nodes named by function
    name, so neighbours of one name are one node."""
    n = func.select(*scope, "func_id", "name")
    named = edges.join(n.withColumnsRenamed({"func_id": "caller_id", "name": "source"}), [*scope, "caller_id"]).join(n.withColumnsRenamed({"func_id": "callee_id", "name": "target"}), [*scope, "callee_id"])
    centers = named.select(*scope, F.explode(F.array("caller_id", "callee_id")).alias("center_id"), "source", "target")
    return centers.distinct()
