"""Rules: conjunctions of predicates on field paths, and linear-time patterns in Java's dialect."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of fields in rules and their columns.
FIELDS = {"defLine": "def_line", "bodySpan": "body_span", "reverseCalls": "reverse_calls"}


def java_pattern(pattern: str) -> str:
    """A pattern without look-around and back-references as Java means it: the dot spares only line
    feeds, and ``$`` is the end of the text. Raises ValueError for what such patterns can't have."""
    out, in_class, k = ["(?d)"], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            after = pattern[k + 1 : k + 2]
            if not after:
                raise ValueError("trailing backslash")
            if after in "123456789" or after == "k":
                raise ValueError("back-references are not supported")
            if after in "GXRZ":
                raise ValueError(f"\\{after} is not supported")
            out.append("\\z" if after == "z" else c + after)
            k += 2
            continue
        if in_class:
            in_class = c != "]"
            out.append("\\" + c if c == "[" and pattern[k + 1 : k + 2] != ":" else c)
        elif c == "[":
            in_class = True
            out.append(c)
            if m := re.match(r"\^?\]", pattern[k + 1 :]):  # a bracket that comes first is a character
                out.append(m[0].replace("]", "\\]"))
                k += len(m[0])
        elif c == "(" and re.match(r"\(\?(=|!|<=|<!|>)", pattern[k:]):
            raise ValueError("look-around is not supported")
        elif c == "$":
            out.append("\\z")
        elif c in "*+?}" and pattern[k + 1 : k + 2] == "+":
            raise ValueError("possessive repetition is not supported")
        else:
            out.append(c)
        k += 1
    return "".join(out)


def matches(c: str | Column, pattern: str) -> Column:
    """Unanchored match; null counts as empty text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit("")).rlike(java_pattern(pattern))


def field(df: DataFrame, path: str) -> Column:
    """The text at a dotted path, as a rule sees it: missing and null are empty text, objects and
    lists are JSON. ``#`` is a list's length, ``#.name`` a field of all its elements, a number an
    element. Below ``extras`` the path goes into the JSON text."""
    head, *rest = path.split(".")
    name = FIELDS.get(head, head)
    if name not in df.columns:
        return F.lit("")
    return F.coalesce(_walk(F.col(f"`{name}`"), df.schema[name].dataType, rest, name == "extras"), F.lit(""))


def _walk(c: Column, kind: T.DataType, rest: list[str], is_json: bool) -> Column:
    if is_json:
        if any(not re.fullmatch(r"\w+", p) for p in rest):
            raise ValueError(f"unsupported path below extras: {'.'.join(rest)}")
        return F.get_json_object(c, "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in rest)) if rest else c
    if not rest:
        if isinstance(kind, (T.ArrayType, T.StructType)):
            return F.when(c.isNotNull(), F.to_json(c))
        return c.cast("string")
    step, *rest = rest
    if isinstance(kind, T.StructType):
        if step not in kind.names:
            return F.lit("")
        return _walk(c[step], kind[step].dataType, rest, False)
    if isinstance(kind, T.ArrayType):
        if step == "#" and not rest:
            return F.when(c.isNotNull(), F.size(c).cast("string"))
        if step == "#" and len(rest) == 1 and isinstance(kind.elementType, T.StructType):
            return F.to_json(F.transform(c, lambda x: x[rest[0]]))
        if step.isdigit():
            return _walk(F.get(c, F.lit(int(step))), kind.elementType, rest, False)
    raise ValueError(f"unsupported path step {step!r}")


Rule = Mapping[str, "str | Callable[[Column], Column]"]


def condition(df: DataFrame, rule: Rule) -> Column:
    """All predicates of a rule; a text is a pattern to match. An empty rule is an error."""
    if not rule:
        raise ValueError("a rule needs at least one predicate")
    return reduce(lambda a, b: a & b, (p(field(df, path)) if callable(p) else matches(field(df, path), p) for path, p in rule.items()))
