"""Identity keys of facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import spans

WORKSPACE_SEP = "|,,|"
DESC_SEP = "|,|"


def _t(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def types(values: str | Column) -> Column:
    """Types of a list of values, joined by commas; a null list or type is empty text."""
    values = F.col(values) if isinstance(values, str) else values
    return _t(F.array_join(F.transform(values, lambda v: _t(v["type"])), ","))


def signature(namespace="namespace", receiver="receiver", name="name", parameters="parameters", returns="returns") -> Column:
    """``namespace|receiver|name|parameter types|return types``"""
    return F.concat_ws("|", _t(namespace), _t(receiver), _t(name), types(parameters), types(returns))


def class_signature(module="module", name="name") -> Column:
    return F.concat_ws(".", _t(module), _t(name))


def desc(span="span", sig="signature") -> Column:
    return F.concat_ws(DESC_SEP, spans.text(span), _t(sig))


def vertex(path="path", span="span", sig="signature") -> Column:
    return F.concat_ws(DESC_SEP, _t(path), desc(span, sig))


def symbol_desc(kind="kind", symbol="symbol") -> Column:
    return F.format_string("<symbol %s %s>", _t(kind), _t(symbol))


def call_index(src="src", caller="caller") -> Column:
    return F.concat(_t(src), F.lit("->"), _t(caller))


def call_desc(src="src", caller="caller", arguments="arguments") -> Column:
    return F.format_string("<call %s([%s]) in %s>", _t(caller), _t(F.array_join(F.col(arguments), " ")), _t(src))


def workspace(repo="repo_id", rev="rev_hash") -> Column:
    """Key of a revision of a repository; an error if either is missing."""
    repo, rev = F.col(repo), F.col(rev)
    whole = (F.length(_t(repo)) > 0) & (F.length(_t(rev)) > 0)
    return F.when(whole, F.concat_ws(WORKSPACE_SEP, repo, rev)).otherwise(F.raise_error(F.lit("repository and revision must be given")))


def workspace_parts(key: str) -> tuple[Column, Column]:
    parts = F.split(F.col(key), r"\|,,\|")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def dot_text(c: str | Column) -> Column:
    """A signature as a node name of a graph file: no colons, slashes for bars, escaped backslashes."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(F.replace(c, F.lit(":"), F.lit("")), F.lit("|"), F.lit("/")), F.lit("\\"), F.lit("\\\\"))


def path_prefixes(path: str | Column) -> Column:
    """``a/b/c`` as [a, a/b, a/b/c]."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def directory(path: str | Column) -> Column:
    """The folder of a path, ``.`` for none."""
    path = F.col(path) if isinstance(path, str) else path
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit(".")).otherwise(d)


def relative_path(path: Column | str, base: str) -> Column:
    """A path below ``base``, with forward slashes; the base itself is ``.``."""
    path = F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/"))
    base = base.rstrip("/")
    rest = F.when(path.startswith(base + "/"), F.substring(path, len(base) + 2, 1 << 30)).when(path == base, ".").otherwise(path)
    return rest
