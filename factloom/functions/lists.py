"""Lists of strings inside JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space around a value: blanks, tabs, line ends.
BLANKS = " \t\r\n"


def json_list(text: str, path: str) -> Column:
    """The JSON list of strings at ``path`` as array<string>; a lone value is a list of one."""
    raw = F.get_json_object(text, path)
    return F.when(raw.startswith("["), F.coalesce(F.from_json(raw, T.ArrayType(T.StringType())), F.array(raw))).when(raw.isNotNull(), F.array(raw))


def stripped(values: Column) -> Column:
    """Each value without the white space around it."""
    return F.transform(values, lambda t: F.btrim(t, F.lit(BLANKS)))
