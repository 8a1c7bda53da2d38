"""Searches in syntax trees kept as rows.

A unit row has its pre-order number, that of its parent and that of its last descendant, so a
subtree is a range of numbers and an ancestor is a range that holds a number. All searches work on
the units of one file at a time (equal keys), for any number of starting units at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match(kinds: Sequence[str] = (), fields: Sequence[str] = (), prefix: str = "") -> Column:
    """Any of the kinds and any of the fields; an empty list asks for nothing."""
    out = F.lit(True)
    if kinds:
        out &= F.col(f"{prefix}kind").isin(list(kinds))
    if fields:
        out &= F.col(f"{prefix}field_name").isin(list(fields))
    return out


@dataclass(frozen=True)
class TreeQuery:
    """A search from given units: ``TreeQuery(units, ["path"]).up().kind("block").first(starts)``."""

    units: DataFrame
    keys: Sequence[str]
    direction: str = "down"
    order: str = "dfs"
    kinds: Sequence[str] = field(default_factory=tuple)
    fields: Sequence[str] = field(default_factory=tuple)

    def up(self) -> TreeQuery:
        """Ancestors, the unit itself included, nearest first."""
        return replace(self, direction="up")

    def down(self) -> TreeQuery:
        """The subtree, the unit itself included."""
        return replace(self, direction="down")

    def dfs(self) -> TreeQuery:
        return replace(self, order="dfs")

    def bfs(self) -> TreeQuery:
        return replace(self, order="bfs")

    def kind(self, *kinds: str) -> TreeQuery:
        return replace(self, kinds=(*self.kinds, *kinds))

    def of_field(self, *fields: str) -> TreeQuery:
        return replace(self, fields=(*self.fields, *fields))

    def all(self, starts: DataFrame) -> DataFrame:
        """(keys..., start_id, unit columns...) of every match."""
        s = starts.select(*(F.col(k).alias(f"_{k}") for k in self.keys), F.col("unit_id").alias("start_id"), F.col("last_descendant_id").alias("_last"))
        inside = F.col("unit_id").between(F.col("start_id"), F.col("_last")) if self.direction == "down" else F.col("start_id").between(F.col("unit_id"), F.col("last_descendant_id"))
        on = inside
        for k in self.keys:
            on &= F.col(k) == F.col(f"_{k}")
        return self.units.filter(match(self.kinds, self.fields)).join(s, on).drop("_last", *(f"_{k}" for k in self.keys))

    def first(self, starts: DataFrame) -> DataFrame:
        """The first match of each start, in the order of the search."""
        rank = F.struct(-F.col("depth")) if self.direction == "up" else F.struct("unit_id") if self.order == "dfs" else F.struct("depth", "unit_id")
        found = self.all(starts)
        cols = [c for c in found.columns if c not in (*self.keys, "start_id")]
        best = found.groupBy(*self.keys, "start_id").agg(F.min_by(F.struct(*cols), rank).alias("u"))
        return best.select(*self.keys, "start_id", "u.*")


def children(units: DataFrame, starts: DataFrame, keys: Sequence[str], kinds: Sequence[str] = (), fields: Sequence[str] = ()) -> DataFrame:
    """(keys..., start_id, unit columns...) of the direct children that match."""
    s = starts.select(*keys, F.col("unit_id").alias("parent_id"))
    return units.filter(match(kinds, fields)).join(s, [*keys, "parent_id"]).withColumn("start_id", F.col("parent_id"))
