"""Helpers on keys shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash64(*cols: str | Column) -> Column:
    """A 64-bit hash in which nulls count: (null, 'a') and ('a', null) differ."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(*(x for c in cols for x in (c, c.isNull())))
