"""Unified diffs into changed lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_hunk = re.compile(r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _unquoted(name: str) -> str:
    name = name.split("\t")[0].rstrip("\r")
    if name[:1] == name[-1:] == '"' and len(name) > 1:
        name = name[1:-1].encode("latin-1", "backslashreplace").decode("unicode_escape").encode("latin-1", "replace").decode("utf-8", "replace")
    return name


def parse(patch: str, exact: bool = False) -> dict[str, list[int]]:
    """Changed lines per file of a unified diff, 0-based.

    By default a line's number also counts the deleted lines before it in its hunk; ``exact`` gives
    its place in the new file. Deleted and binary files are left out; a file without added lines
    keeps an empty list. A hunk that ends early or has foreign lines ends there.
    """
    out: dict[str, list[int]] = {}
    name: str | None = None
    left = old = new = index = place = 0
    deleted = False
    for line in patch.split("\n"):
        if old > 0 or new > 0:
            mark = line[:1]
            if mark == "\\":
                continue
            if mark in (" ", "") or line == "\r":
                old, new, place = old - 1, new - 1, place + 1
            elif mark == "+":
                if name is not None:
                    out[name].append(place - 1 if exact else left + index - 1)
                new, place = new - 1, place + 1
            elif mark == "-":
                old -= 1
            else:
                old = new = 0
            index += 1
            if old > 0 or new > 0 or mark in (" ", "+", "-", ""):
                continue
        if line.startswith("diff --git "):
            m = re.match(r'diff --git (?:"?a/.*?"?) ("?b/.*)$', line.rstrip("\r"))
            name, deleted = None, False
            pending = _unquoted(m[1]).removeprefix("b/") if m else None
            if pending is not None:
                name = pending
                out.setdefault(name, [])
        elif line.startswith(("deleted file mode", "Binary files ", "GIT binary patch")):
            deleted = True
            if name is not None and not out.get(name):
                out.pop(name, None)
            name = None
        elif line.startswith("+++ "):
            target = _unquoted(line[4:])
            if target == "/dev/null":
                if name is not None:
                    out.pop(name, None)
                name = None
            elif not deleted:
                target = target.removeprefix("b/")
                if name is not None and name != target and not out.get(name):
                    out.pop(name, None)
                name = target
                out.setdefault(name, [])
        elif m := _hunk.match(line):
            old, new = int(m[1] if m[1] is not None else 1), int(m[3] if m[3] is not None else 1)
            left = place = int(m[2])
            index = 0
    return out


def affected_lines(patches: DataFrame, keys: list[str], text: str = "text", exact: bool = False) -> DataFrame:
    """(keys..., path, lines) of every changed file of every patch. Null and empty patches give none."""
    schema = T.StructType([*(patches.schema[k] for k in keys), T.StructField("path", T.StringType()), T.StructField("lines", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, path, lines = [], [], []
            for k, t in enumerate(batch.column(len(keys)).to_pylist()):
                for p, ls in parse(t or "", exact).items():
                    at.append(k)
                    path.append(p)
                    lines.append(ls)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keys))), pa.array(path, pa.string()), pa.array(lines, pa.list_(pa.int32()))], names=schema.names)

    return patches.select(*keys, text).filter(F.col(text).isNotNull()).mapInArrow(run, schema)
