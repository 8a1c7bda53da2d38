"""Deeply nested records into related flat tables.

Every record is stream-parsed into path-value-ordinal triples; the paths are grouped by the
innermost repeated ancestor they share, and each group is pivoted into one table whose rows carry
the ordinals of all their ancestors, which are the link to the parent row. Parsing, grouping and
pivoting happen in the task that reads the record: the whole operator is one narrow pass without a
shuffle, and no more than one Arrow batch of records is held.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.jsonstream import CLOSE, END, KEY, LIST, NULL, OPEN, TEXT, events
from factloom.runtime import spread

CORRUPT = "_corrupt"
ROOT = "_root"
#: Positions that one output batch holds, and known paths after which a task forgets them.
BATCH, PATHS = 1 << 20, 50_000


@dataclass(frozen=True)
class Shape:
    """What is known of the records beforehand; without it every JSON list makes a table.

    lists: paths that hold a list by definition, so that a lone value there is a list of one.
    texts: paths whose string value is itself JSON and stands for what it encodes.
    wrappers: keys that add nothing to a path, as in an object that wraps a number.
    tables: paths of the tables that are wanted; None wants all.
    keep: leaf columns to keep in ``fields``, as names relative to their table; None keeps all.
    """

    lists: frozenset[str] = frozenset()
    texts: frozenset[str] = frozenset()
    wrappers: frozenset[str] = frozenset()
    tables: frozenset[str] | None = None
    keep: frozenset[str] | None = None


class _Known:
    """What the shape says of a path: a node of the tree of its listed paths."""

    def __init__(self) -> None:
        self.below: dict[str, _Known] = {}
        self.is_list = self.is_text = False

    @staticmethod
    def of(shape: Shape) -> _Known:
        root = _Known()
        for paths, mark in ((shape.lists, "is_list"), (shape.texts, "is_text")):
            for p in paths:
                node = root
                for part in re.split(r"(?<!\\)\.", p):
                    node = node.below.setdefault(part, _Known())
                setattr(node, mark, True)
        return root


class _Place:
    """A value's place in the records: its table, and its column there, empty for an element.

    Paths are spelt out only where something is given out, so that depth costs nothing by itself.
    """

    __slots__ = ("above", "name", "known", "below", "inside", "_table", "_column", "_wanted")

    def __init__(self, above: _Place | None, name: str | None, known: _Known | None) -> None:
        self.above, self.name, self.known = above, name, known
        self.below: dict[str, _Place] = {}
        self.inside: _Place | None = None
        self._table: str | None = None
        self._column: str | None = None
        self._wanted: bool | None = None

    def element(self) -> _Place:
        """The place of a list's elements, whose table is named by the list's path."""
        if self.inside is None:
            self.inside = _Place(self, None, self.known)
        return self.inside

    @property
    def column(self) -> str:
        if self._column is None:
            parts, p = [], self
            while p.name is not None:
                parts.append(p.name)
                p = p.above
            self._column = ".".join(reversed(parts))
        return self._column

    @property
    def table(self) -> str:
        if self._table is None:
            p = self
            while p.name is not None:
                p = p.above
            if p.above is None:
                p._table = ROOT
            elif p._table is None:
                chain = [p]  # lists in lists, outermost last
                while chain[-1].above is not None and chain[-1]._table is None:
                    q = chain[-1].above
                    while q.name is not None:
                        q = q.above
                    chain.append(q)
                for inner, outer in zip(chain[-2::-1], chain[:0:-1]):
                    top = outer._table if outer.above is not None else ROOT
                    column = inner.above.column
                    inner._table = column if top == ROOT else f"{top}.{column}" if column else top
            self._table = p._table
        return self._table

    @property
    def path(self) -> str:
        return self.column if self.table == ROOT else f"{self.table}.{self.column}" if self.column else self.table


class Record:
    """The rows of one record in document order: place, depth and position of each, and its cells."""

    __slots__ = ("place", "depth", "at", "cells")

    def __init__(self) -> None:
        self.place: list[_Place] = []
        self.depth: list[int] = []
        self.at: list[int] = []
        self.cells: list[dict[str, str]] = []

    def row(self, place: _Place, depth: int, at: int) -> int:
        self.place.append(place)
        self.depth.append(depth)
        self.at.append(at)
        self.cells.append({})
        return len(self.place) - 1

    def forget(self, row: int, place: _Place) -> None:
        """Take back what the first value of a repeated key left; the last one counts."""
        path, column = place.path, place.column
        mine = lambda text, whole: text == whole or text.startswith(whole + ".")
        self.cells[row] = {c: v for c, v in self.cells[row].items() if not mine(c, column)}
        live = [r for r in range(len(self.place)) if r <= row or not mine(self.place[r].table, path)]
        if len(live) < len(self.place):
            for name in Record.__slots__:
                old = getattr(self, name)
                setattr(self, name, [old[r] for r in live])

    def rows(self) -> Iterator[tuple[_Place, list[int], dict[str, str]]]:
        at: list[int] = []
        for place, depth, k, cells in zip(self.place, self.depth, self.at, self.cells):
            del at[max(0, depth - 1) :]
            if depth:
                at.append(k)
            yield place, at, cells


class Reader:
    """Stream-parses records of one shape."""

    def __init__(self, shape: Shape) -> None:
        self.shape = shape
        self.root, self.size = _Place(None, None, _Known.of(shape)), 0

    def _below(self, place: _Place, key: str) -> _Place:
        if (got := place.below.get(key)) is None:
            if key in self.shape.wrappers:
                got = place
            else:
                known = place.known.below.get(key) if place.known else None
                got = _Place(place, key.replace(".", "\\.") if "." in key else key, known)
                self.size += 1
            place.below[key] = got
        return got

    def _kept(self, place: _Place) -> bool:
        if place._wanted is None:
            s = self.shape
            place._wanted = (s.keep is None or (place.column or "value") in s.keep) and (s.tables is None or place.table in s.tables)
        return place._wanted

    def triples(self, text: str, record: Record) -> Iterator[tuple[int, _Place, str]]:
        """(row, place, value) of every leaf; the rows of repeated elements are added to ``record``
        as they open, so a row stands for its table and all its ordinals.

        A null element gives no row, but those after it keep their positions. A dot inside a key is
        written ``\\.``, so that paths stay unambiguous. ValueError tells that the text is no JSON.
        """
        if self.size > PATHS:
            self.root, self.size = _Place(None, None, self.root.known), 0
        place, row = self.root, record.row(self.root, 0, 0)
        # of what is open: its place, row and depth, the number of elements or -1, the keys seen
        stack: list[tuple[_Place, int, int, int, set[str] | None]] = []
        depth, count, keys = 0, -2, None
        home, home_row = place, row
        todo: list[Iterator] = [events(text)]
        while todo:
            for kind, value in todo[-1]:
                if kind == KEY:
                    place, row = self._below(home, value), home_row
                    if value in keys:
                        record.forget(row, place)
                    else:
                        keys.add(value)
                    continue
                if kind == CLOSE or kind == END:
                    home, home_row, depth, count, keys = stack.pop()
                    continue
                own, was = depth, count
                if count >= 0:  # an element
                    count = was = count + 1
                    if kind == NULL:
                        continue
                    place = home.inside or home.element()
                    own = depth + 1
                    row = record.row(place, own, count - 1)
                elif kind == NULL:
                    continue
                known = place.known
                if known is not None and place.name is not None:
                    if kind == TEXT and known.is_text:
                        try:
                            inner = list(events(value))
                        except ValueError:
                            pass
                        else:
                            todo.append(iter(inner))
                            break
                    if kind != LIST and known.is_list:
                        place = place.inside or place.element()
                        own += 1
                        row = record.row(place, own, 0)
                if kind == OPEN or kind == LIST:
                    stack.append((home, home_row, depth, was, keys))
                    home, home_row, depth = place, row, own
                    count, keys = (-1, set()) if kind == OPEN else (0, None)
                elif place._wanted or place._wanted is None and self._kept(place):
                    yield row, place, value
            else:
                todo.pop()

    def read(self, text: str) -> Record:
        """The record pivoted: one row per repeated element, one cell per column."""
        record = Record()
        for row, place, value in self.triples(text, record):
            record.cells[row][place._column or place.column or "value"] = value
        return record


def _clean(s: str) -> str:
    return s.encode("utf-8", "replace").decode("utf-8")


def _maps(cells: list[dict[str, str]]) -> pa.Array:
    offsets, names, values = [0], [], []
    for c in cells:
        names += c
        values += c.values()
        offsets.append(len(names))
    try:
        return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))
    except (UnicodeEncodeError, pa.ArrowInvalid):  # lone surrogates, which JSON can escape
        return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(map(_clean, names), pa.string()), pa.array(map(_clean, values), pa.string()))


class _Rows:
    """Output rows of a batch."""

    def __init__(self) -> None:
        self.row: list[int] = []
        self.table: list[str] = []
        self.flat: list[int] = []
        self.ends: list[int] = [0]
        self.cells: list[dict[str, str]] = []

    def add(self, row: int, table: str, at: Iterable[int], cells: dict[str, str]) -> None:
        self.row.append(row)
        self.table.append(table)
        self.flat += at
        self.ends.append(len(self.flat))
        self.cells.append(cells)

    def batch(self, read: pa.RecordBatch, n_keys: int, names: list[str]) -> pa.RecordBatch:
        take = pa.array(self.row, pa.int64())
        at = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.array(self.flat, pa.int32()))
        table = pa.array(self.table, pa.string())
        return pa.RecordBatch.from_arrays([*(read.column(i).take(take) for i in range(n_keys)), table, at, _maps(self.cells)], names=names)


def shred(df: DataFrame, keys: Iterable[str], payload: str, shape: Shape = Shape()) -> DataFrame:
    """Rows of all tables found in the JSON records of column ``payload``.

    Result: the key columns, ``table`` (path of the repeated ancestor, ``_root`` for the record
    itself), ``at`` (positions from 0 along that path; all but the last are the parent row's
    ``at``) and ``fields`` (the row's columns by their path below the ancestor, as text; numbers as
    they are written).

    A null payload gives no row; one that is not valid JSON gives a single row of table
    ``_corrupt`` with the payload in ``fields``. Records may be nested to any depth. Repeated
    records and keys are kept as they are. Other columns of ``df`` are neither read nor returned.
    An object that has a key twice counts with its last value.
    """
    keys = list(keys)
    schema = T.StructType(
        [*(df.schema[k] for k in keys), T.StructField("table", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]
    )
    corrupt = shape.tables is None or CORRUPT in shape.tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shape)
        for batch in batches:
            out = _Rows()
            for row, text in enumerate(batch.column(len(keys)).to_pylist()):
                try:
                    record = reader.read(text)
                except ValueError:
                    if corrupt:
                        out.add(row, CORRUPT, (), {"payload": text} if shape.keep is None else {})
                    continue
                for place, at, cells in record.rows():
                    table = place._table or place.table
                    if shape.tables is None or table in shape.tables:
                        out.add(row, table, at, cells)
                        if len(out.flat) > BATCH:
                            yield out.batch(batch, len(keys), schema.names)
                            out = _Rows()
            yield out.batch(batch, len(keys), schema.names)

    rows = df.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{payload}`").alias("_payload")).filter(F.col("_payload").isNotNull())
    return spread(rows).mapInArrow(run, schema)


def pick(shredded: DataFrame, tables: str | Iterable[str], columns: dict[str, Column | str]) -> DataFrame:
    """One flat table out of :func:`shred`'s rows: its keys, ``at`` and the named columns.

    ``columns`` maps a name to a Column, or to a field's name with an optional ``:type``.
    """
    tables = [tables] if isinstance(tables, str) else list(tables)
    keys = [c for c in shredded.columns if c not in ("table", "at", "fields")]
    out = []
    for name, c in columns.items():
        if isinstance(c, str):
            field, _, kind = c.partition(":")
            c = F.element_at("fields", F.lit(field))
            c = c.try_cast(kind) if kind else c
        out.append(c.alias(name))
    return shredded.filter(F.col("table").isin(tables)).select(*(F.col(f"`{k}`") for k in keys), *out)
