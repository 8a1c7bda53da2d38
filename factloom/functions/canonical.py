"""JSON values in one canonical form."""

from __future__ import annotations

import json
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.jsonstream import CLOSE, END, KEY, LIST, NULL, OPEN, TEXT, events


def pruned(value: object) -> object:
    """The value without what counts as absent: null, empty text, empty list, empty object.

    Elements of a list keep their place, so an empty one becomes null there. Whole floats equal
    integers.
    """
    if isinstance(value, dict):
        out = {k: x for k, v in value.items() if (x := pruned(v)) is not None}
        return out or None
    if isinstance(value, list):
        return [pruned(v) for v in value] or None
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return None if value == "" else value


def canonical_text(text: str | None) -> str | None:
    """Sorted, compact JSON of the pruned value; null if nothing is left. Text that is no JSON
    stands for itself."""
    if not text:
        return None
    try:
        value = pruned(json.loads(text))
        return None if value is None else json.dumps(value, sort_keys=True, separators=(",", ":"))
    except RecursionError:
        return _canonical_stream(text)
    except ValueError:
        return "!" + text


def _canonical_stream(text: str) -> str | None:
    """The same for values nested deeper than the stack allows, built from the inside out."""
    above: list[tuple[int, list | dict]] = [(LIST, [])]
    key: list[str] = []
    try:
        for kind, value in events(text):
            if kind in (OPEN, LIST):
                above.append((kind, {} if kind == OPEN else []))
                continue
            if kind == KEY:
                key.append(value)
                continue
            if kind in (CLOSE, END):
                inside = above.pop()[1]
                if kind == CLOSE:
                    parts = [f"{json.dumps(k)}:{v}" for k, v in sorted(inside.items()) if v is not None]
                    done = "{" + ",".join(parts) + "}" if parts else None
                else:
                    done = "[" + ",".join("null" if v is None else v for v in inside) + "]" if inside else None
            else:
                done = None if kind == NULL or kind == TEXT and not value else json.dumps(value if kind == TEXT else pruned(json.loads(value)))
            if above[-1][0] == OPEN:
                above[-1][1][key.pop()] = done
            else:
                above[-1][1].append(done)
    except ValueError:
        return "!" + text
    return above[0][1][0]


def _hash(text: str | None) -> int:
    c = canonical_text(text)
    return 0 if c is None else int.from_bytes(blake2b(c.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@F.arrow_udf(T.LongType())
def json_value_hash(texts: pa.Array) -> pa.Array:
    """64-bit hash of the JSON value of each text, 0 for absent ones; every distinct text of a
    batch is parsed once."""
    coded = texts.dictionary_encode()
    of = np.array([0, *map(_hash, coded.dictionary.to_pylist())], np.int64)
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return pa.array(of[codes + 1], pa.int64())
