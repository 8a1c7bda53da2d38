"""JSON as a stream of events, read in one pass without building the value or recursing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring

OPEN, CLOSE, LIST, END, KEY, TEXT, OTHER, NULL = range(8)
Event = tuple[int, str]

_value = re.compile(r'[ \t\n\r]*(?:"([^"\\\x00-\x1f]*)"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false)|(null)|(\{)|(\[)|(\])|("))').match
# a whole pair of key and plain value with what follows, the bulk of most records
_pair = re.compile(r'[ \t\n\r]*"([^"\\\x00-\x1f]*)"[ \t\n\r]*:[ \t\n\r]*(?:"([^"\\\x00-\x1f]*)"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false)|null)[ \t\n\r]*([,}])').match
_key = re.compile(r'[ \t\n\r]*(?:"([^"\\\x00-\x1f]*)"[ \t\n\r]*:|(")|(\}))').match
_colon = re.compile(r"[ \t\n\r]*:").match
_next = re.compile(r"[ \t\n\r]*([,}\]])").match
_rest = re.compile(r"[ \t\n\r]*\Z").match


def events(text: str) -> Iterator[Event]:
    """(kind, text) of each token that matters, in order. Raises ValueError where the text stops
    being JSON, so whoever acts on events must be ready to take them back.

    OPEN and CLOSE are an object's braces, LIST and END a list's brackets; KEY and TEXT come without
    escapes; OTHER is a number or a truth value as written. The depth is bounded by memory alone.
    """
    pos, above, first = 0, [], False
    while True:
        closed = False
        if above and above[-1] == OPEN:
            while m := _pair(text, pos):
                key, value, other, c = m.groups()
                pos, first = m.end(), False
                yield KEY, key
                yield (TEXT, value) if value is not None else (NULL, "") if other is None else (OTHER, other)
                if c == "}":
                    break
            if m:
                closed = True
            elif (m := _key(text, pos)) is None:
                raise ValueError(f"no key at {pos}")
            elif (k := m.lastindex) == 1:
                pos = m.end()
                yield KEY, m[1]
            elif k == 2:
                name, pos = scanstring(text, m.end(), True)
                if (m := _colon(text, pos)) is None:
                    raise ValueError(f"no colon at {pos}")
                pos = m.end()
                yield KEY, name
            elif closed := first:
                pos = m.end()
            else:
                raise ValueError(f"no key at {pos}")
        if not closed:
            if (m := _value(text, pos)) is None:
                raise ValueError(f"no value at {pos}")
            pos = m.end()
            if (k := m.lastindex) == 1:
                yield TEXT, m[1]
            elif k == 2:
                yield OTHER, m[2]
            elif k == 3:
                yield NULL, ""
            elif k == 7:
                value, pos = scanstring(text, pos, True)
                yield TEXT, value
            elif k != 6:
                above.append(OPEN if k == 4 else LIST)
                yield above[-1], ""
                first = True
                continue
            elif not (closed := first and above[-1] == LIST):
                raise ValueError(f"no value at {pos}")
        first = False
        if closed:
            yield above.pop() + 1, ""
        while above:
            if (m := _next(text, pos)) is None:
                raise ValueError(f"nothing to go on with at {pos}")
            pos = m.end()
            if (c := m[1]) == ",":
                break
            if (c == "}") != (above[-1] == OPEN):
                raise ValueError(f"wrong bracket at {pos}")
            yield above.pop() + 1, ""
        else:
            if _rest(text, pos) is None:
                raise ValueError(f"more text at {pos}")
            return
