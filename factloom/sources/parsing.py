"""Syntax trees of source files, for the kinds of nodes that facts are made of.

Python is parsed by its own compiler, and by a scanner of indented lines where that fails; Go, Java,
Kotlin and JavaScript by a scanner of tokens with matched brackets, which finds declarations,
statements, calls and identifiers and steps over what it does not know. Rows and columns are 0-based, columns count UTF-8 bytes, ends are exclusive.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from dataclasses import field as _field

Point = tuple[int, int]


@dataclass
class Node:
    kind: str
    start: int
    end: int
    field: str = ""
    children: list["Node"] = _field(default_factory=list)
    text: str | None = None

    def add(self, *nodes: "Node | None") -> "Node":
        self.children += [n for n in nodes if n is not None]
        return self

    def walk(self) -> Iterator["Node"]:
        yield self
        for c in self.children:
            yield from c.walk()

    def first(self, *kinds: str) -> "Node | None":
        return next((n for n in self.walk() if n.kind in kinds), None)

    def child(self, *kinds: str) -> "Node | None":
        return next((n for n in self.children if n.kind in kinds), None)

    def by_field(self, name: str) -> "Node | None":
        return next((n for n in self.children if n.field == name), None)

    def all(self, *kinds: str) -> list["Node"]:
        return [n for n in self.children if n.kind in kinds]


class Source:
    def __init__(self, text: str) -> None:
        self.text = text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.ascii = text.isascii()
        #: what the compiler says of a text that was only scanned
        self.error: str | None = None

    def point(self, at: int) -> Point:
        row = bisect_right(self.lines, at) - 1
        start = self.lines[row]
        return row, at - start if self.ascii else len(self.text[start:at].encode("utf-8", "replace"))

    def of(self, n: Node) -> str:
        return self.text[n.start : n.end] if n.text is None else n.text


class ParseError(ValueError):
    pass


# ---- tokens ----


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, or the punctuation itself
    text: str
    start: int
    end: int
    line_before: bool


def _lexer(strings: str) -> re.Pattern:
    return re.compile(rf"(?P<space>(?:[ \t\r\f\v﻿\n]+|\\\n)+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>{strings})|(?P<number>\d[\w.]*)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<punct>->|=>|\.\.\.|\?\.|::|.)", re.S)


_QUOTED = r'"(?:[^"\\\n]|\\.)*"?' + r"|'(?:[^'\\\n]|\\.)*'?"
_TRIPLE = r'"""(?:.*?"""|.*\Z)'
_LEXERS = {"GOLANG": _lexer(r"`[^`]*`?|" + _QUOTED), "JAVA": _lexer(_TRIPLE + "|" + _QUOTED), "KOTLIN": _lexer(_TRIPLE + "|" + _QUOTED + r"|`[^`\n]*`"), "JAVASCRIPT": _lexer(r"`(?:[^`\\]|\\.)*`?|" + _QUOTED)}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_regex = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


class Tokens:
    def __init__(self, text: str, lang: str) -> None:
        self.src = Source(text)
        self.lang = lang
        self.t: list[Token] = []
        self.kinds: list[str] = []
        self.pair: dict[int, int] = {}
        lex, script, kotlin = _LEXERS[lang].finditer, lang == "JAVASCRIPT", lang == "KOTLIN"
        found, add, add_kind = lex(text), self.t.append, self.kinds.append
        stack: list[int] = []
        fresh, end, i = True, 0, 0
        while (m := next(found, None)) is not None:  # matches follow each other without a gap
            kind, word, at = m.lastgroup, m[0], end
            end += len(word)
            if kind == "space" or kind == "comment":
                fresh = fresh or "\n" in word
                continue
            k = word if kind == "punct" else kind
            if script and word == "/" and (not self.t or self.t[-1].kind in "(,=:[!&|?{};+-*~^<>%" or self.t[-1].text in ("return", "typeof", "case", "=>")) and (literal := _regex.match(text, at)):
                k, word, end = "string", literal[0], literal.end()
                found = lex(text, end)
            elif kotlin and kind == "string" and word[0] == "`":
                k = "name"
            add(Token(k, word, at, end, fresh))
            add_kind(k)
            fresh = False
            if k in _OPEN:
                stack.append(i)
            elif k in _CLOSE:
                # an unmatched bracket closes the nearest that fits, others stay open
                for d in range(len(stack) - 1, -1, -1):
                    if _OPEN[self.kinds[stack[d]]] == k:
                        self.pair[stack[d]] = i
                        del stack[d:]
                        break
            i += 1
        self.n = len(self.t)

    def __len__(self) -> int:
        return self.n

    def kind(self, i: int) -> str:
        return self.kinds[i] if 0 <= i < self.n else ""

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.n and self.t[i].text in texts and self.kinds[i] != "string"

    def close(self, i: int) -> int:
        """Index of the bracket closing that at i; the last token if there is none."""
        return self.pair.get(i, len(self.t) - 1)

    def node(self, kind: str, a: int, b: int, field: str = "") -> Node:
        """A node over tokens a to b, both included."""
        return Node(kind, self.t[a].start, self.t[b].end, field)

    def split(self, a: int, b: int, sep: str = ",") -> list[tuple[int, int]]:
        """Ranges between separators outside brackets, in tokens a to b - 1; ``<>`` count as brackets."""
        out, start, i, angle = [], a, a, 0
        while i < b:
            k = self.t[i].kind
            if k in _OPEN:
                i = self.close(i)
            elif k == "<":
                angle += 1
            elif k == ">":
                angle = max(0, angle - 1)
            elif k == sep and not angle:
                out.append((start, i))
                start = i + 1
            i += 1
        if start < b:
            out.append((start, b))
        return [(x, y) for x, y in out if x < y]


_ARGUMENT_KIND = {"number": "literal", "string": "string_literal", "name": "identifier"}


#: Kinds of statements by language and keyword, those with bodies first.
_COMPOUND = {
    "GOLANG": {"if": "if_statement", "for": "for_statement", "switch": "expression_switch_statement", "select": "select_statement"},
    "JAVA": {"if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_expression", "try": "try_statement", "synchronized": "synchronized_statement"},
    "KOTLIN": {"if": "if_expression", "for": "for_statement", "while": "while_statement", "do": "do_while_statement", "when": "when_expression", "try": "try_expression"},
    "JAVASCRIPT": {"if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_statement", "try": "try_statement"},
}
_SIMPLE = {
    "GOLANG": {"return": "return_statement", "defer": "defer_statement", "go": "go_statement"},
    "JAVA": {"return": "return_statement", "throw": "throw_statement"},
    "KOTLIN": {"return": "jump_expression", "throw": "jump_expression"},
    "JAVASCRIPT": {"return": "return_statement", "throw": "throw_statement"},
}
_STATEMENTS = {lang: frozenset([*_COMPOUND[lang], *_SIMPLE[lang]]) for lang in _COMPOUND}
_BLOCK = {"GOLANG": "block", "JAVA": "block", "KOTLIN": "control_structure_body", "JAVASCRIPT": "statement_block"}


def _line_end(t: Tokens, i: int, b: int) -> int:
    """The last token of a plain statement whose next token is i."""
    k = i
    while k < b:
        if t.kind(k) in _OPEN:
            k = t.close(k) + 1
            continue
        if t.kind(k) == ";":
            return k
        if t.kind(k) in _CLOSE or t.lang != "JAVA" and t.t[k].line_before:
            return k - 1
        k += 1
    return min(k, b) - 1


def _statement_end(t: Tokens, i: int, b: int) -> int:
    """The last token of the compound statement that begins at i, with what follows by else, catch,
    finally or, for do, while."""
    k, end = i + 1, i
    header = not t.is_(i, "do", "try")
    while k < b:
        while header and k < b and t.kind(k) != "{":
            done = t.kind(k) == "(" and t.lang != "GOLANG"
            k = t.close(k) + 1 if t.kind(k) in _OPEN else k + 1
            if done:
                break
        if t.kind(k) == "(" and t.is_(i, "try"):
            k = t.close(k) + 1
        end = t.close(k) if k < b and t.kind(k) == "{" else _line_end(t, k, b) if k < b else k - 1
        end = max(i, min(end, b - 1))
        k = end + 1
        if t.is_(k, "else") and k < b:
            header = t.is_(k + 1, "if")
            k += 1 + header
        elif t.is_(k, "catch") and t.is_(i, "try") and k < b:
            header = t.kind(k + 1) == "("
            k += 1
        elif t.is_(k, "finally") and t.is_(i, "try") and k < b:
            header = False
            k += 1
        elif t.is_(k, "while") and t.is_(i, "do") and k < b:
            return max(i, min(_line_end(t, k + 1, b), b - 1))
        else:
            break
    return max(i, min(end, b - 1))


def _statement(t: Tokens, i: int, b: int, parent: Node, call: str, stop: Callable[[int], int | None], words: frozenset[str]) -> int:
    """The statement that begins at i, its blocks as nodes of their own; gives the index behind it."""
    word = t.t[i].text
    compound = word in _COMPOUND[t.lang]
    end = _statement_end(t, i, b) if compound else max(i, _line_end(t, i + 1, b))
    n = t.node(_COMPOUND[t.lang].get(word) or _SIMPLE[t.lang][word], i, end)
    parent.add(n)
    k = start = i + 1
    while compound and k <= end:
        if t.is_(k, "else") and t.is_(k + 1, "if") and k < end:
            _calls(t, start, k, n, call, stop, words)
            start = _statement(t, k + 1, end + 1, n, call, stop, words)
            break
        if t.kind(k) != "{":
            k = t.close(k) + 1 if t.kind(k) in _OPEN else k + 1
            continue
        _calls(t, start, k, n, call, stop, words)
        close = min(t.close(k), end)
        n.add(block := t.node(_BLOCK[t.lang], k, close, "body"))
        _calls(t, k + 1, close, block, call, stop, words)
        k = start = close + 1
    _calls(t, start + (word == "do" and t.is_(start, "while")), end + 1, n, call, stop, words)
    return end + 1


def _calls(t: Tokens, a: int, b: int, parent: Node, call: str, stop: Callable[[int], int | None], words: frozenset[str]) -> None:
    """Statements, calls and identifiers in tokens a to b - 1. ``stop(i)`` handles a declaration at i
    and gives the index behind it."""
    statements = _STATEMENTS[t.lang]
    i = a
    while i < b:
        after = stop(i)
        if after is not None:
            i = max(after, i + 1)
            continue
        if t.kind(i) != "name":
            i += 1
            continue
        if t.t[i].text in statements and t.kind(i - 1) not in (".", "?."):
            i = max(_statement(t, i, b, parent, call, stop, words), i + 1)
            continue
        if t.t[i].text not in words or t.is_(i, "this", "super") and t.kind(i + 1) == ".":
            start = end = i
            while t.kind(end + 1) in (".", "?.", "::") and t.kind(end + 2) == "name":
                end += 2
            if t.kind(end + 1) == "(" and end + 1 < b and not t.is_(start - 1, "new"):
                close = t.close(end + 1)
                n = t.node(call, start, close)
                if call == "method_invocation":
                    if end > start:
                        n.add(t.node("identifier" if end - 2 == start else "field_access", start, end - 2, "object"))
                    n.add(t.node("identifier", end, end, "name"))
                else:
                    n.add(t.node("identifier" if end == start else "selector_expression", start, end, "function"))
                args = t.node("argument_list", end + 1, close, "arguments")
                for x, y in t.split(end + 2, close):
                    if y - x == 1 and t.kind(x) in _ARGUMENT_KIND and not t.is_(x, *words):
                        args.add(t.node(_ARGUMENT_KIND[t.kind(x)], x, x))
                    else:
                        arg = t.node("expression", x, y - 1)
                        _calls(t, x, y, arg, call, stop, words)
                        args.add(arg)
                parent.add(n.add(args))
                i = close + 1
                continue
            for k in range(start + 2 * t.is_(start, "this", "super"), end + 1, 2):
                parent.add(t.node("identifier" if k == start else "field_identifier", k, k))
            i = end + 1
            continue
        i += 1


# ---- Go ----

_GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


def parse_go(text: str) -> tuple[Source, Node]:
    t = Tokens(text, "GOLANG")
    root = Node("source_file", 0, len(text))

    def type_kind(a: int, b: int) -> str:
        one = b - a == 1
        if one and t.kind(a) == "name":
            return "type_identifier"
        if t.is_(a, "*"):
            return "pointer_type"
        if t.is_(a, "["):
            return "slice_type" if t.kind(a + 1) == "]" else "array_type"
        if t.kind(a) == "name" and t.kind(a + 1) == "." and b - a == 3:
            return "qualified_type"
        return {"map": "map_type", "func": "function_type", "chan": "channel_type", "interface": "interface_type", "struct": "struct_type"}.get(t.t[a].text, "generic_type")

    def typed(a: int, b: int, field_: str = "type") -> Node:
        n = t.node(type_kind(a, b), a, b - 1, field_)
        for i in range(a, b):  # lists inside function types
            if t.is_(i, "func") and t.kind(i + 1) == "(":
                n.add(params(i + 1))
        return n

    def params(i: int, field_: str = "parameters") -> Node:
        close = t.close(i)
        out = t.node("parameter_list", i, close, field_)
        parts = t.split(i + 1, close)

        def named(a: int, b: int) -> bool:
            return b - a > 1 and t.kind(a) == "name" and t.kind(a + 1) != "." and not t.is_(a, *_GO_WORDS) and not (t.kind(a + 1) == "[" and t.close(a + 1) == b - 1)

        if any(named(a, b) for a, b in parts):
            waiting: list[int] = []
            for a, b in parts:
                if not named(a, b):
                    waiting.append(a)
                    continue
                first = waiting[0] if waiting else a
                many = t.is_(a + 1, "...")
                n = t.node("variadic_parameter_declaration" if many else "parameter_declaration", first, b - 1)
                n.add(*(t.node("identifier", w, w, "name") for w in [*waiting, a]))
                n.add(typed(a + 1 + many, b) if a + 1 + many < b else None)
                out.add(n)
                waiting = []
        else:
            for a, b in parts:
                many = t.is_(a, "...")
                if a + many < b:
                    out.add(t.node("variadic_parameter_declaration" if many else "parameter_declaration", a, b - 1).add(typed(a + many, b)))
        return out

    def result_end(i: int) -> int:
        """Index of the body's brace, or of what ends a declaration without one."""
        while i < len(t):
            if t.kind(i) == "{":
                if not t.is_(i - 1, "interface", "struct"):
                    return i
                i = t.close(i)
            elif t.kind(i) in ("(", "["):
                i = t.close(i)
            elif t.t[i].line_before:
                return i
            i += 1
        return i

    def function(i: int) -> int:
        start, i = i, i + 1
        method = t.kind(i) == "("
        n = Node("method_declaration" if method else "function_declaration", t.t[start].start, 0)
        if method:
            n.add(params(i, "receiver"))
            i = t.close(i) + 1
        if t.kind(i) != "name":
            return start + 1
        n.add(t.node("field_identifier" if method else "identifier", i, i, "name"))
        i += 1
        if t.kind(i) == "[":
            i = t.close(i) + 1
        if t.kind(i) != "(":
            return i
        n.add(params(i))
        last = t.close(i)
        i = last + 1
        body = result_end(i)
        if i < body and not t.t[i].line_before:
            n.add(params(i, "result") if t.kind(i) == "(" else typed(i, body, "result"))
            last = body - 1
        if t.kind(body) == "{":
            last = t.close(body)
            block = t.node("block", body, last, "body")
            _calls(t, body + 1, last, block, "call_expression", declaration, _GO_WORDS)
            n.add(block)
        n.end = t.t[min(last, len(t) - 1)].end
        root_stack[-1].add(n)
        return last + 1

    def struct(i: int) -> Node:
        """The struct type whose keyword is at i."""
        open_ = i + 1
        close = t.close(open_)
        fields = t.node("field_declaration_list", open_, close)
        k = open_ + 1
        while k < close:
            e = k
            while e < close and (e == k or not (t.t[e].line_before or t.kind(e) == ";")):
                e = t.close(e) + 1 if t.kind(e) in _OPEN else e + 1
            stop = e
            if t.kind(stop - 1) == "string":  # a tag
                stop -= 1
            if stop > k:
                f = t.node("field_declaration", k, stop - 1)
                ids = [k]
                while t.kind(ids[-1] + 1) == "," and t.kind(ids[-1] + 2) == "name":
                    ids.append(ids[-1] + 2)
                if t.kind(k) == "name" and stop - ids[-1] > 1 and t.kind(k + 1) != ".":
                    f.add(*(t.node("field_identifier", x, x, "name") for x in ids), typed(ids[-1] + 1, stop))
                else:
                    f.add(typed(k + t.is_(k, "*"), stop))
                fields.add(f)
            k = e + (t.kind(e) == ";")
        return t.node("struct_type", i, close, "type").add(fields)

    def type_spec(i: int) -> int:
        name, k = i, i + 1
        if t.kind(k) == "[" and t.close(k) + 1 < len(t) and t.close(k) > k + 1 and not t.t[t.close(k) + 1].line_before:
            k = t.close(k) + 1
        k += t.is_(k, "=")
        if t.is_(k, "struct") and t.kind(k + 1) == "{":
            s = struct(k)
            root_stack[-1].add(Node("type_spec", t.t[name].start, s.end).add(t.node("type_identifier", name, name, "name"), s))
            return t.close(k + 1) + 1
        e = k
        while e < len(t) and not (t.t[e].line_before and e > k):
            e = t.close(e) + 1 if t.kind(e) in _OPEN else e + 1
        root_stack[-1].add(t.node("type_spec", name, max(name, e - 1)).add(t.node("type_identifier", name, name, "name")))
        return e

    root_stack = [root]

    def declaration(i: int) -> int | None:
        if not t.is_(i, "func", "type"):
            return None
        if t.is_(i, "func") and (t.kind(i + 1) == "name" or i == 0 or t.t[i].line_before) and i not in t_inner:
            return function(i)
        if t.is_(i, "type") and t.kind(i + 1) == "name":
            return type_spec(i + 1)
        if t.is_(i, "type") and t.kind(i + 1) == "(":
            k, close = i + 2, t.close(i + 1)
            while k < close:
                k = type_spec(k) if t.kind(k) == "name" else k + 1
            return close + 1
        return None

    t_inner: set[int] = set()
    i = 0
    while i < len(t):
        if t.is_(i, "package") and t.kind(i + 1) == "name" and not root.children:
            root.add(t.node("package_clause", i, i + 1).add(t.node("package_identifier", i + 1, i + 1)))
            i += 2
            continue
        after = declaration(i)
        if after is None:
            i = t.close(i) + 1 if t.kind(i) in _OPEN else i + 1
        else:
            i = max(after, i + 1)
    return t.src, root


# ---- Java ----

_JAVA_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non".split())
_JAVA_WORDS = _JAVA_MODIFIERS | frozenset("assert boolean break byte case catch char class const continue do double else enum extends finally float for goto if implements import instanceof int interface long new package return short super switch this throw throws try void while true false null var record yield".split())
_JAVA_TYPES = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration"}


def parse_java(text: str) -> tuple[Source, Node]:
    t = Tokens(text, "JAVA")
    root = Node("program", 0, len(text))

    def modifiers(i: int, limit: int) -> tuple[Node | None, int]:
        start, notes = i, []
        while i < limit:
            if t.kind(i) == "@" and t.kind(i + 1) == "name" and not t.is_(i + 1, "interface"):
                e = i + 1
                while t.kind(e + 1) == "." and t.kind(e + 2) == "name":
                    e += 2
                plain = t.kind(e + 1) != "("
                e = e if plain else t.close(e + 1)
                notes.append(t.node("marker_annotation" if plain else "annotation", i, e))
                i = e + 1
            elif t.kind(i) == "name" and t.t[i].text in _JAVA_MODIFIERS:
                i += 1
                if t.kind(i) == "-" and t.is_(i + 1, "sealed"):
                    i += 2
            else:
                break
        return (t.node("modifiers", start, i - 1).add(*notes) if i > start else None), i

    def type_end(i: int) -> int:
        """Index behind the type that begins at i."""
        while t.kind(i) == "@":
            i += 2
        if t.kind(i) != "name":
            return i
        i += 1
        while True:
            if t.kind(i) == "." and t.kind(i + 1) == "name":
                i += 2
            elif t.kind(i) == "<":
                depth = 1
                i += 1
                while i < len(t) and depth:
                    depth += (t.kind(i) == "<") - (t.kind(i) == ">")
                    i += 1
            elif t.kind(i) == "[" and t.kind(i + 1) == "]":
                i += 2
            else:
                return i

    def type_node(a: int, b: int, field_: str) -> Node:
        kind = "void_type" if t.is_(a, "void") else "generic_type" if any(t.kind(k) == "<" for k in range(a, b)) else "type_identifier" if b - a == 1 else "scoped_type"
        return t.node(kind, a, b - 1, field_)

    def type_list(a: int, b: int) -> Node:
        return t.node("type_list", a, b - 1).add(*(type_node(x, y, "") for x, y in t.split(a, b)))

    def params(i: int) -> Node:
        close = t.close(i)
        out = t.node("formal_parameters", i, close, "parameters")
        for a, b in t.split(i + 1, close):
            mods, k = modifiers(a, b)
            e = type_end(k)
            if e >= b or e == k:
                continue
            many = t.kind(e) == "..."
            name = e + many
            if t.kind(name) == "name":
                out.add(t.node("spread_parameter" if many else "formal_parameter", a, b - 1).add(mods, type_node(k, e, "type"), t.node("identifier", name, name, "name")))
        return out

    def local(parent: Node) -> Callable[[int], int | None]:
        def stop(i: int) -> int | None:
            if t.kind(i) == "name" and t.t[i].text in _JAVA_TYPES and t.kind(i + 1) == "name" and t.kind(i - 1) != ".":
                return clazz(i, i, None, parent)
            return None

        return stop

    def clazz(start: int, i: int, mods: Node | None, parent: Node) -> int:
        """The type whose keyword is at i."""
        n = Node(_JAVA_TYPES[t.t[i].text], t.t[start].start, 0).add(mods, t.node("identifier", i + 1, i + 1, "name"))
        k = i + 2
        while k < len(t) and t.kind(k) not in ("{", ";"):
            if t.is_(k, "extends", "implements", "permits"):
                word, a = t.t[k].text, k + 1
                k = a
                while k < len(t) and t.kind(k) != "{" and not t.is_(k, "extends", "implements", "permits"):
                    k += 1
                if a < k and word == "extends" and n.kind == "class_declaration":
                    n.add(t.node("superclass", a - 1, k - 1).add(type_node(a, k, "")))
                elif a < k and word != "permits":
                    n.add(t.node("super_interfaces" if word == "implements" else "extends_interfaces", a - 1, k - 1).add(type_list(a, k)))
            else:
                k += 1
        close = t.close(k) if t.kind(k) == "{" else min(k, len(t) - 1)
        n.end = t.t[close].end
        if t.kind(k) == "{":
            body = t.node({"class_declaration": "class_body", "interface_declaration": "interface_body"}.get(n.kind, "enum_body"), k, close, "body")
            members(k + 1, close, body, n.kind == "enum_declaration")
            n.add(body)
        parent.add(n)
        return close + 1

    def members(i: int, limit: int, body: Node, enum: bool = False) -> None:
        if enum:  # constants up to the first semicolon
            while i < limit and t.kind(i) != ";":
                i = t.close(i) + 1 if t.kind(i) in _OPEN else i + 1
            i += 1
        while i < limit:
            start = i
            mods, k = modifiers(i, limit)
            if t.kind(k) == "name" and t.t[k].text in _JAVA_TYPES and t.kind(k + 1) == "name":
                i = clazz(start, k, mods, body)
                continue
            if t.kind(k) == "<":
                depth, k = 1, k + 1
                while k < limit and depth:
                    depth += (t.kind(k) == "<") - (t.kind(k) == ">")
                    k += 1
            e = type_end(k)
            if e > k and t.kind(e) == "name" and t.kind(e + 1) == "(":
                n = Node("method_declaration", t.t[start].start, 0).add(mods, type_node(k, e, "type"), t.node("identifier", e, e, "name"), params(e + 1))
                last = t.close(e + 1)
                k = last + 1
                while k < limit and t.kind(k) not in ("{", ";"):
                    k = t.close(k) + 1 if t.kind(k) in ("(", "[") else k + 1
                if t.kind(k) == "{":
                    last = t.close(k)
                    block = t.node("block", k, last, "body")
                    _calls(t, k + 1, last, block, "method_invocation", local(block), _JAVA_WORDS)
                    n.add(block)
                else:
                    last = min(k, limit - 1)
                n.end = t.t[last].end
                body.add(n)
                i = last + 1
            elif e > k and t.kind(e) == "name" and t.kind(e + 1) in ("=", ";", ",", "["):
                stop = e
                while stop < limit and t.kind(stop) != ";":
                    stop = t.close(stop) + 1 if t.kind(stop) in _OPEN else stop + 1
                f = t.node("field_declaration", start, min(stop, limit - 1)).add(mods, type_node(k, e, "type"))
                parts = t.split(e, stop)
                f.add(*(t.node("variable_declarator", a, b - 1, "declarator").add(t.node("identifier", a, a, "name")) for a, b in parts if t.kind(a) == "name"))
                body.add(f)
                i = stop + 1
            else:  # constructors, initialisers and what isn't known
                k = max(k, i)
                while k < limit and t.kind(k) not in ("{", ";"):
                    k = t.close(k) + 1 if t.kind(k) in ("(", "[") else k + 1
                i = (t.close(k) if t.kind(k) == "{" else k) + 1

    i = 0
    while i < len(t):
        start = i
        if t.is_(i, "package") and t.kind(i + 1) == "name":
            e = i + 1
            while t.kind(e + 1) == "." and t.kind(e + 2) == "name":
                e += 2
            root.add(t.node("package_declaration", i, e + (t.kind(e + 1) == ";")).add(t.node("scoped_identifier" if e > i + 1 else "identifier", i + 1, e)))
            i = e + 1
            continue
        mods, k = modifiers(i, len(t))
        if t.kind(k) == "name" and t.t[k].text in _JAVA_TYPES and t.kind(k + 1) == "name":
            i = clazz(start, k, mods, root)
        else:
            i = max(k, i)
            i = t.close(i) + 1 if t.kind(i) in _OPEN else i + 1
    return t.src, root


# ---- Kotlin ----

_KOTLIN_WORDS = frozenset("as break class continue do else false for fun if in interface is null object package return super this throw true try typealias val var when while import by get set where companion init".split())


def parse_kotlin(text: str) -> tuple[Source, Node]:
    t = Tokens(text, "KOTLIN")
    root = Node("source_file", 0, len(text))
    mods = frozenset("public private protected internal open abstract final sealed data inner enum annotation override suspend inline operator infix tailrec external lateinit const expect actual value noinline crossinline".split())

    def back(i: int) -> int:
        """Start of the modifiers and annotations before i."""
        while i > 0:
            if t.kind(i - 1) == "name" and t.t[i - 1].text in mods:
                i -= 1
            elif t.kind(i - 1) == "name" and t.kind(i - 2) == "@":
                i -= 2
            elif t.kind(i - 1) == ")":
                a = next((o for o, c in t.pair.items() if c == i - 1), None)
                if a is None or not (t.kind(a - 1) == "name" and t.kind(a - 2) == "@"):
                    break
                i = a - 2
            else:
                break
        return i

    def function(i: int, parent: Node) -> int:
        k = i + 1
        if t.kind(k) == "<":
            depth, k = 1, k + 1
            while k < len(t) and depth:
                depth += (t.kind(k) == "<") - (t.kind(k) == ">")
                k += 1
        a = k
        while k < len(t) and t.kind(k) != "(" and (k == a or not t.t[k].line_before or t.kind(k) == "."):
            k += 1
        if t.kind(k) != "(" or t.kind(k - 1) != "name" or k - 1 < a:
            return i + 1
        n = Node("function_declaration", t.t[back(i)].start, 0).add(t.node("simple_identifier", k - 1, k - 1))
        last = t.close(k)
        n.add(t.node("function_value_parameters", k, last))
        k = last + 1
        if t.kind(k) == ":":  # the type
            k += 1
            while k < len(t) and t.kind(k) not in ("{", "=", "}") and not t.t[k].line_before:
                k = t.close(k) + 1 if t.kind(k) in ("(", "[") else k + 1
            last = k - 1
        if t.kind(k) == "{":
            last = t.close(k)
            body = t.node("function_body", k, last)
            _calls(t, k + 1, last, body, "call_expression", inner(body), _KOTLIN_WORDS)
            n.add(body)
        elif t.kind(k) == "=":
            e = k + 1
            while e < len(t) and (e == k + 1 or not t.t[e].line_before or t.kind(e) in (".", "?.", "?")) and t.kind(e) not in ("}", ";"):
                e = t.close(e) + 1 if t.kind(e) in _OPEN else e + 1
            last = max(k, e - 1)
            body = t.node("function_body", k, last)
            _calls(t, k + 1, last + 1, body, "call_expression", inner(body), _KOTLIN_WORDS)
            n.add(body)
        n.end = t.t[min(last, len(t) - 1)].end
        parent.add(n)
        return last + 1

    def clazz(i: int, parent: Node) -> int:
        kind = "object_declaration" if t.is_(i, "object") else "class_declaration"
        n = Node(kind, t.t[back(i)].start, 0).add(t.node("type_identifier", i + 1, i + 1))
        k, last = i + 2, i + 1
        while k < len(t) and t.kind(k) != "{":
            if t.t[k].line_before and t.kind(k) not in (":", ",") and t.kind(k - 1) not in (":", ","):
                break
            if t.kind(k) in _CLOSE:
                break
            last = t.close(k) if t.kind(k) in ("(", "[") else k
            k = last + 1
        if t.kind(k) == "{":
            last = t.close(k)
            body = t.node("class_body", k, last)
            scan(k + 1, last, body)
            n.add(body)
        n.end = t.t[min(last, len(t) - 1)].end
        parent.add(n)
        return last + 1

    def inner(parent: Node) -> Callable[[int], int | None]:
        def stop(i: int) -> int | None:
            if not t.is_(i, "fun", "class", "interface", "object"):
                return None
            if t.is_(i, "fun") and t.kind(i + 1) in ("name", "<"):
                return function(i, parent)
            if t.is_(i, "class", "interface", "object") and t.kind(i + 1) == "name" and t.kind(i - 1) not in (".", "::"):
                return clazz(i, parent)
            return None

        return stop

    def scan(i: int, limit: int, parent: Node) -> None:
        stop = inner(parent)
        while i < limit:
            after = stop(i)
            if after is not None:
                i = max(after, i + 1)
            elif t.kind(i) == "{" and not t.is_(i - 1, "object"):
                scan(i + 1, t.close(i), parent)
                i = t.close(i) + 1
            else:
                i = t.close(i) + 1 if t.kind(i) in ("(", "[") else i + 1

    i = 0
    if (k := next((x for x in range(len(t)) if t.is_(x, "package") and t.t[x].line_before), None)) is not None and t.kind(k + 1) == "name":
        e = k + 1
        while t.kind(e + 1) == "." and t.kind(e + 2) == "name":
            e += 2
        root.add(t.node("package_header", k, e).add(t.node("identifier", k + 1, e)))
        i = e + 1
    scan(i, len(t), root)
    return t.src, root


# ---- JavaScript ----

_JS_WORDS = frozenset("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null return static super switch this throw true try typeof undefined var void while with yield async await of".split())


def parse_javascript(text: str) -> tuple[Source, Node]:
    t = Tokens(text, "JAVASCRIPT")
    root = Node("program", 0, len(text))

    def params(i: int) -> Node:
        close = t.close(i)
        out = t.node("formal_parameters", i, close, "parameters")
        for a, b in t.split(i + 1, close):
            if t.kind(a) == "name":
                out.add(t.node("identifier", a, a) if b - a == 1 else t.node("assignment_pattern", a, b - 1).add(t.node("identifier", a, a, "left")))
        return out

    def block(i: int) -> Node:
        close = t.close(i)
        n = t.node("statement_block", i, close, "body")
        _calls(t, i + 1, close, n, "call_expression", inner(n), _JS_WORDS)
        return n

    def function(i: int, parent: Node) -> int | None:
        k = i + 1 + (t.kind(i + 1) == "*")
        if t.kind(k) != "name" or t.kind(k + 1) != "(":
            return None
        close = t.close(k + 1)
        if t.kind(close + 1) != "{":
            return None
        start = i - 1 if t.is_(i - 1, "async") else i
        last = t.close(close + 1)
        parent.add(t.node("function_declaration", start, last).add(t.node("identifier", k, k, "name"), params(k + 1), block(close + 1)))
        return last + 1

    def clazz(i: int, parent: Node) -> int | None:
        k = i + 2
        while k < len(t) and t.kind(k) != "{":
            if t.kind(k) in (";", ")", "}"):
                return None
            k = t.close(k) + 1 if t.kind(k) in ("(", "[") else k + 1
        if k >= len(t):
            return None
        close = t.close(k)
        body = t.node("class_body", k, close, "body")
        n = t.node("class_declaration", i, close).add(t.node("identifier", i + 1, i + 1, "name"), body)
        m = k + 1
        while m < close:
            start = m
            while t.is_(m, "static", "async", "get", "set", "*") and t.kind(m + 1) not in ("(", "=", ";"):
                m += 1
            m += t.kind(m) == "#"
            if t.kind(m) in ("name", "string") and t.kind(m + 1) == "(" and t.kind(t.close(m + 1) + 1) == "{":
                brace = t.close(m + 1) + 1
                last = t.close(brace)
                body.add(t.node("method_definition", start, last).add(t.node("property_identifier" if t.kind(m) == "name" else "string", m, m, "name"), params(m + 1), block(brace)))
                m = last + 1
            else:
                m = start
                m = t.close(m) + 1 if t.kind(m) in _OPEN else m + 1
        parent.add(n)
        return close + 1

    def inner(parent: Node) -> Callable[[int], int | None]:
        def stop(i: int) -> int | None:
            if not t.is_(i, "function", "class"):
                return None
            before = i - 1 if not t.is_(i - 1, "async") else i - 2
            statement = before < 0 or t.kind(before) in (";", "{", "}", ")") or t.is_(before, "export", "default", "else") or (t.t[before + 1].line_before and t.kind(before) in ("name", "number", "string", "]"))
            if t.is_(i, "function") and statement:
                return function(i, parent)
            if t.is_(i, "class") and t.kind(i + 1) == "name" and statement:
                return clazz(i, parent)
            return None

        return stop

    _calls(t, 0, len(t), root, "call_expression", inner(root), _JS_WORDS)
    return t.src, root


# ---- Python ----


#: Kinds of statements by the compiler's class.
_PY_STATEMENTS = {
    ast.If: "if_statement", ast.For: "for_statement", ast.AsyncFor: "for_statement", ast.While: "while_statement", ast.Try: "try_statement", ast.TryStar: "try_statement", ast.With: "with_statement", ast.AsyncWith: "with_statement",
    ast.Match: "match_statement", ast.Return: "return_statement", ast.Raise: "raise_statement", ast.Assert: "assert_statement", ast.Delete: "delete_statement", ast.Import: "import_statement", ast.ImportFrom: "import_from_statement",
    ast.Assign: "assignment", ast.AnnAssign: "assignment", ast.AugAssign: "augmented_assignment", ast.Call: "call", ast.Lambda: "lambda",
}
_PY_DEFINITIONS = frozenset([ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef])
#: The compiler's classes that hold no others.
_PY_LEAVES = frozenset([ast.Constant, *(x for base in (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop) for x in base.__subclasses__())])


def parse_python(text: str) -> tuple[Source, Node]:
    text = text.removeprefix("﻿")
    src = Source(text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        src.error = str(e) or type(e).__name__
        return src, _scan_python(text)
    starts = src.lines
    # the compiler counts \r and \r\n as line ends, too
    if "\r" in text.replace("\r\n", ""):
        starts = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]

    def at(row: int, column: int) -> int:
        start = starts[min(row - 1, len(starts) - 1)]
        if src.ascii:
            return start + column
        end = starts[row] if row < len(starts) else len(text)
        if (line := text[start:end]).isascii():
            return start + min(column, len(line))
        return start + len(line.encode("utf-8", "replace")[:column].decode("utf-8", "ignore"))

    def span(n: ast.AST, kind: str, field_: str = "") -> Node:
        return Node(kind, at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset), field_)

    name_at = re.compile(r"(?:async\s+)?(?:def|class)\s+(\w+)")

    def visit(n: ast.AST, parent: Node) -> None:
        for c in ast.iter_child_nodes(n):
            what = type(c)
            if what in _PY_LEAVES:
                continue
            if what in _PY_DEFINITIONS:
                is_class = what is ast.ClassDef
                own = span(c, "class_definition" if is_class else "function_definition")
                m = name_at.match(text, own.start)
                name = Node("identifier", m.start(1), m.end(1), "name") if m else Node("identifier", own.start, own.start, "name", text=c.name)
                body = Node("block", at(c.body[0].lineno, c.body[0].col_offset), own.end, "body")
                if (deco := getattr(c.body[0], "decorator_list", None)) and c.body[0].lineno > deco[0].lineno:
                    body.start = at(deco[0].lineno, deco[0].col_offset) - 1
                own.add(name)
                inside = ast.Module(body=c.body, type_ignores=[])
                head = [x for x in ast.iter_child_nodes(c) if x not in c.body and x not in c.decorator_list]
                for h in head:
                    visit(ast.Module(body=[h], type_ignores=[]), own)
                visit(inside, body)
                own.add(body)
                if c.decorator_list:
                    outer = Node("decorated_definition", at(c.decorator_list[0].lineno, c.decorator_list[0].col_offset) - 1, own.end)
                    for x in c.decorator_list:
                        e = span(x, "expression")
                        outer.add(Node("decorator", e.start - 1, e.end))
                    parent.add(outer.add(own))
                else:
                    parent.add(own)
            elif what is ast.Name:
                parent.add(span(c, "identifier"))
            elif what is ast.Attribute:
                visit(c, parent)
                end = at(c.end_lineno, c.end_col_offset)
                parent.add(Node("identifier", end - len(c.attr), end, "attribute"))
            elif what is ast.arg:
                start = at(c.lineno, c.col_offset)
                parent.add(Node("identifier", start, start + len(c.arg)))
                visit(c, parent)
            elif what is ast.keyword and c.arg:
                start = at(c.lineno, c.col_offset)
                parent.add(Node("identifier", start, start + len(c.arg), "name"))
                visit(c, parent)
            elif what in _PY_STATEMENTS:
                own = span(c, _PY_STATEMENTS[what])
                parent.add(own)
                visit(c, own)
            else:
                visit(c, parent)

    root = Node("module", 0, len(text))
    visit(tree, root)
    return src, root


_PYTHON_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
#: Words that only begin a statement, whatever bracket is still open before them.
_PYTHON_STARTS = frozenset("def class return import while try except finally raise pass break continue del global nonlocal assert with".split())
_PY_LEX = re.compile(
    r"""(?P<space>[ \t\f\v﻿]+|\\\r?\n|(?:(?<=\n)|\A)(?:<{7}|={7}|>{7}|\|{7})[^\n]*|\{%[^\n]*?%\}|\#[^\r\n]*)|(?P<line>\r\n?|\n)"""
    r"""|(?P<string>\b[A-Za-z]{0,2}(?:'{3}(?:[^\\]|\\.)*?'{3}|"{3}(?:[^\\]|\\.)*?"{3})|(?:'{3}(?:[^\\]|\\.)*?'{3}|"{3}(?:[^\\]|\\.)*?"{3})|(?:\b[A-Za-z]{1,2})?(?:'(?:[^'\\\r\n]|\\(?:\r\n|.))*'?|"(?:[^"\\\r\n]|\\(?:\r\n|.))*"?))"""
    r"""|(?P<number>\.?\d[\w.]*)|(?P<name>[^\W\d]\w*)|(?P<punct>\.\.\.|->|:=|[=!<>]=|.)""",
    re.S,
)


def _py_tokens(text: str, at: int = 0, end: int | None = None) -> Iterator[Token]:
    fresh, end = True, len(text) if end is None else end
    while at < end:
        m = _PY_LEX.match(text, at, end)
        kind, at = m.lastgroup, m.end()
        if kind == "line":
            fresh = True
        elif kind != "space":
            yield Token(m[0] if kind == "punct" else kind, m[0], m.start(), at, fresh)
            fresh = False


def _in_fstring(t: Token) -> Iterator[tuple[int, int]]:
    """Ranges of the expressions in an f-string, those in format specs included."""
    head = re.match("[A-Za-z]*", t.text)[0]
    if "f" not in head.lower():
        return
    opened: list[int] = []
    i = len(head)
    while i < len(t.text):
        if not opened and t.text[i : i + 2] in ("{{", "}}"):
            i += 1
        elif t.text[i] == "{":
            opened.append(i + 1)
        elif t.text[i] == "}" and opened:
            start = opened.pop()
            if not opened:
                spec = re.search(r"![rsa]?(?=[:}])|:(?!=)", t.text[start : i + 1])
                yield t.start + start, t.start + (start + spec.start() if spec else i)
                if spec:
                    for m in re.finditer(r"\{([^{}]*)\}", t.text[start + spec.start() : i]):
                        yield t.start + start + spec.start() + m.start(1), t.start + start + spec.start() + m.end(1)
        i += 1


def _scan_python(text: str) -> Node:
    """The tree of a text that the compiler rejects: definitions, decorators and identifiers, by
    indentation. A definition whose brackets stay open is none; what can't be understood is
    stepped over."""
    t = list(_py_tokens(text))
    lines: list[tuple[int, int]] = []  # logical lines, as ranges of tokens
    pair: dict[int, int] = {}
    stack: list[int] = []
    for i, x in enumerate(t):
        if x.line_before and (not stack or x.text in _PYTHON_STARTS or x.text == "async" and i + 1 < len(t) and t[i + 1].text == "def"):
            stack.clear()
            lines.append((i, i))
        if x.kind in _OPEN:
            stack.append(i)
        elif x.kind in _CLOSE and stack and _OPEN[t[stack[-1]].kind] == x.kind:
            pair[stack.pop()] = i
        lines[-1] = lines[-1][0], i + 1

    def identifiers(toks: list[Token], parent: Node, parameters: bool = False) -> None:
        words, inside = [x.text for x in toks[:2]], []
        if words[:1] in (["import"], ["global"], ["nonlocal"]) or words[:1] == ["from"]:
            return
        for i, x in enumerate(toks):
            before, after = toks[i - 1].kind if i else "", toks[i + 1].kind if i + 1 < len(toks) else ""
            if x.kind in _OPEN:
                inside.append(x.kind)
            elif x.kind in _CLOSE and inside:
                inside.pop()
            elif x.kind == "string":
                for a, b in _in_fstring(x):
                    identifiers(list(_py_tokens(text, a, b)), parent)
            elif x.kind != "name" or x.text in _PYTHON_WORDS or words[:1] == ["except"] and i and toks[i - 1].text == "as":
                continue
            elif i == 0 and x.text in ("print", "exec") and after in ("string", "name", "number", ">"):
                continue  # a statement of Python 2
            else:
                named = after == "=" and before in ("(", ",") and inside[-1:] == ["("] and not (parameters and len(inside) == 1)
                parent.add(Node("identifier", x.start, x.end, "attribute" if before == "." else "name" if named else ""))

    def header(a: int, b: int) -> tuple[int, int] | None:
        """Index of the name and that behind the header of a definition in tokens a to b - 1."""
        k = a + 1 + (t[a].text == "async")
        if k >= b or t[k - 1].text not in ("def", "class") or t[k].kind != "name" or t[k].text in _PYTHON_WORDS:
            return None
        e = k + 1
        if e < b and t[e].kind == "[":
            e = pair.get(e, b) + 1
        if e < b and t[e].kind == "(":
            e = pair.get(e, b) + 1
        elif t[k - 1].text == "def":
            return None
        if e > b:
            return None
        while e < b and t[e].kind != ":":
            e = pair.get(e, e) + 1
        return k, min(e + 1, b)

    root = Node("module", 0, len(text))
    open_: list[tuple[int, Node, list[Node]]] = []  # indentation, owner and all nodes that end with it
    decorators: list[tuple[int, int]] = []
    for a, b in lines:
        start = max(text.rfind("\n", 0, t[a].start), text.rfind("\r", 0, t[a].start)) + 1
        indent = len(text[start : t[a].start].expandtabs(8))
        while open_ and indent <= open_[-1][0]:
            open_.pop()
        end = t[b - 1].end
        for _, own, ends in open_:
            if own.children[-1].kind != "block":
                own.add(block := Node("block", t[a].start, end, "body"))
                ends.append(block)
            for n in ends:
                n.end = end
        parent = open_[-1][1].children[-1] if open_ else root
        if t[a].kind == "@":
            decorators.append((a, b))
            continue
        if (h := header(a, b)) is None:
            decorators.clear()
            identifiers(t[a:b], parent)
            continue
        k, e = h
        own = Node("class_definition" if t[k - 1].text == "class" else "function_definition", t[a].start, end)
        own.add(Node("identifier", t[k].start, t[k].end, "name"))
        identifiers(t[k + 1 : e], own, t[k - 1].text == "def")
        ends = [own]
        if e < b:
            own.add(block := Node("block", t[e].start, end, "body"))
            identifiers(t[e:b], block)
        if decorators:
            ends.append(Node("decorated_definition", t[decorators[0][0]].start, end).add(*(Node("decorator", t[x].start, t[y - 1].end) for x, y in decorators), own))
        parent.add(ends[-1])
        decorators.clear()
        if e >= b:
            open_.append((indent, own, ends))
    return root


#: Built-in parsers by language; others come with a language registered for extraction.
PARSERS: dict[str, Callable[[str], tuple[Source, Node]]] = {"GOLANG": parse_go, "JAVA": parse_java, "KOTLIN": parse_kotlin, "JAVASCRIPT": parse_javascript, "PYTHON": parse_python}


def parse(text: str, lang: str, parser: Callable[[str], tuple[Source, Node]] | None = None) -> tuple[Source, Node]:
    if (parser := parser or PARSERS.get(lang)) is None:
        raise ParseError(f"no parser for {lang}")
    try:
        return parser(text)
    except ParseError:
        raise
    except (IndexError, KeyError, RecursionError) as e:
        raise ParseError(f"{type(e).__name__}: {e}") from None
