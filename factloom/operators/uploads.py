"""The tables inside upload messages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.nested import Shape, pick, shred

RESULTS = ("funcResult", "clazzFileResult")
#: List below a unit -> name of its table.
CHILDREN = {
    "parameters": "parameter",
    "returns": "return",
    "extras.annotations": "annotation",
    "extras.decorators": "decorator",
    "extras.fields": "field",
    "extras.classInfo.annotations": "class_annotation",
    "extras.fields.annotations": "field_annotation",
}
#: Lists of plain words, which are no nested elements of their own.
WORDS = {"extras.modifiers": "modifier", "extras.implements": "interface", "extras.fields.modifiers": "field_modifier"}
TABLES = {f"{r}.units": "unit" for r in RESULTS} | {f"{r}.units.{p}": c for r in RESULTS for p, c in CHILDREN.items()}
WORD_TABLES = {f"{r}.units.{p}": c for r in RESULTS for p, c in WORDS.items()}


def shape(tables: Iterable[str] = TABLES, keep: frozenset[str] | None = None) -> Shape:
    return Shape(
        lists=frozenset(TABLES | WORD_TABLES),
        texts=frozenset(f"{r}.units.extras" for r in RESULTS),
        wrappers=frozenset({"$numberLong", "$numberInt"}),
        tables=frozenset(tables),
        keep=keep,
    )


def of(child: str) -> list[str]:
    return [p for p, c in (TABLES | WORD_TABLES).items() if c == child]


def elements(messages: DataFrame) -> DataFrame:
    """One row per nested record or element: (delivery_id, unit_pos, child, pos, sub_pos).

    Positions count from 0 in the list as delivered and are -1 where a level does not exist. Null
    elements give no row but keep their position; a lone value is a list of one. Null payloads,
    payloads that are no JSON and an empty table give no row. Every delivery counts, repeated rows
    included; other columns are ignored and payloads are read whole.
    """
    rows = shred(messages, ["delivery_id"], "payload", shape())
    child = F.create_map(*(F.lit(x) for p in TABLES.items() for x in p))
    at = lambda k: F.coalesce(F.get("at", F.lit(k)), F.lit(-1))
    return rows.select("delivery_id", at(0).alias("unit_pos"), F.element_at(child, F.col("table")).alias("child"), at(1).alias("pos"), at(2).alias("sub_pos"))


def _table(messages: DataFrame, child: str, keep: Iterable[str]) -> DataFrame:
    return shred(messages, ["delivery_id"], "payload", shape(of(child), frozenset(keep)))


def units(messages: DataFrame) -> DataFrame:
    """The flat table of units; (delivery_id, unit_pos) is the key that all child tables carry.
    Scalars of extras stand here, too."""
    points = {f"{s}_{e}_{x}": f"{p}.{e}.{'row' if x == 'row' else 'column'}:bigint" for s, p in (("span", "span"), ("body", "bodySpan")) for e in ("start", "end") for x in ("row", "col")}
    plain = ("name", "receiver", "namespace", "module", "lang")
    extras = {"class_package": "extras.classInfo.packageName", "class_name": "extras.classInfo.className", "base": "extras.extends"}
    keep = {*plain, *extras.values(), "defLine", *(c.partition(":")[0] for c in points.values())}
    kind = F.when(F.col("table").startswith("func"), "func").otherwise("clazz")
    return pick(_table(messages, "unit", keep), of("unit"), {"unit_pos": F.get("at", F.lit(0)), "kind": kind, **{c: c for c in plain}, **extras, "def_line": "defLine:int", **points})


def typed(messages: DataFrame, child: str) -> DataFrame:
    """Parameters, returns or fields: (delivery_id, unit_pos, pos, name, type)."""
    return pick(_table(messages, child, ("name", "type")), of(child), {"unit_pos": F.get("at", F.lit(0)), "pos": F.get("at", F.lit(1)), "name": "name", "type": "type"})


def words(messages: DataFrame, child: str) -> DataFrame:
    """A table of plain values, such as annotations: (delivery_id, unit_pos, pos, value), for those
    below fields (delivery_id, unit_pos, pos of the field, sub_pos, value)."""
    deep = {"sub_pos": F.get("at", F.lit(2))} if child.startswith("field_") else {}
    return pick(_table(messages, child, ("value",)), of(child), {"unit_pos": F.get("at", F.lit(0)), "pos": F.get("at", F.lit(1)), **deep, "value": "value"})
