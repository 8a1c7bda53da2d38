"""Identifiers of source texts with their positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.runtime import spread

_identifier = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def identifiers(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., symbol, row, col) of every identifier in a text; rows end at line feeds, columns
    count characters. Null and empty texts give none."""
    schema = T.StructType([*(files.schema[k] for k in keys), T.StructField("symbol", T.StringType()), T.StructField("row", T.LongType()), T.StructField("col", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, symbol, row, col = [], [], [], []
            for k, t in enumerate(batch.column(len(keys)).to_pylist()):
                for r, line in enumerate((t or "").split("\n")):
                    for m in _identifier.finditer(line):
                        at.append(k)
                        symbol.append(m[0])
                        row.append(r)
                        col.append(m.start())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keys))), pa.array(symbol, pa.string()), pa.array(row, pa.int64()), pa.array(col, pa.int64())], names=schema.names)

    return spread(files.select(*keys, text).filter(F.col(text).isNotNull())).mapInArrow(run, schema)
