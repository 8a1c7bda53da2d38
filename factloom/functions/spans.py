"""Spans of syntax nodes: 0-based rows and columns, both ends included."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<row:bigint,column:bigint>"
SPAN = f"struct<start:{POINT},end:{POINT}>"


def _c(s: str | Column) -> Column:
    return F.col(s) if isinstance(s, str) else s


def make(start_row, start_column, end_row, end_column) -> Column:
    point = lambda r, c: F.struct(_c(r).cast("bigint").alias("row"), _c(c).cast("bigint").alias("column"))
    return F.struct(point(start_row, start_column).alias("start"), point(end_row, end_column).alias("end"))


def rows(s: str | Column) -> Column:
    """All rows of the span; none for a null span."""
    s = _c(s)
    return F.when(s.isNotNull(), F.sequence(s["start"]["row"], s["end"]["row"]))


def has_line(s: str | Column, line) -> Column:
    """Whether the span holds line ``line``. The line counts one row further: 0-based rows are
    compared with line + 1, which is how line numbers are given to every query."""
    s, n = _c(s), (F.lit(line) if isinstance(line, int) else _c(line)) + 1
    return F.coalesce(n.between(s["start"]["row"], s["end"]["row"]), F.lit(False))


def has_any_line(s: str | Column, lines) -> Column:
    """Whether the span holds any of the lines; false for none and for null."""
    lines = F.array(*(F.lit(x) for x in lines)) if isinstance(lines, (list, tuple)) and lines else F.array().cast("array<int>") if isinstance(lines, (list, tuple)) else _c(lines)
    return F.coalesce(F.exists(lines, lambda n: has_line(s, n)), F.lit(False))


def touches(s: str | Column, other: str | Column) -> Column:
    """Whether two spans have a point in common, as seen from ``s``.

    Where ``s`` ends on the row the other starts on, only these two columns are compared, even if
    both spans lie on one row. A null span touches nothing.
    """
    s, o = _c(s), _c(other)
    apart = (s["end"]["row"] < o["start"]["row"]) | (s["start"]["row"] > o["end"]["row"])
    return F.coalesce(
        F.when(apart, False)
        .when(s["end"]["row"] == o["start"]["row"], s["end"]["column"] >= o["start"]["column"])
        .when(s["start"]["row"] == o["end"]["row"], s["start"]["column"] <= o["end"]["column"])
        .otherwise(s.isNotNull() & o.isNotNull()),
        F.lit(False),
    )


def rows_overlap(s: str | Column, other: str | Column) -> Column:
    s, o = _c(s), _c(other)
    return F.coalesce((o["end"]["row"] >= s["start"]["row"]) & (o["start"]["row"] <= s["end"]["row"]), F.lit(False))


def text(s: str | Column) -> Column:
    """``startRow:startColumn,endRow:endColumn``"""
    s = _c(s)
    at = lambda p: F.concat_ws(":", p["row"].cast("string"), p["column"].cast("string"))
    return F.when(s.isNotNull(), F.concat_ws(",", at(s["start"]), at(s["end"])))
