"""Facts of source files: functions, classes, symbols, calls and syntax nodes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.spans import SPAN
from factloom.operators.facts import SUFFIXES
from factloom.runtime import spread
from factloom.sources.parsing import Node, ParseError, Source, parse

VALUES = "array<struct<type:string,name:string>>"
FUNCTION = f"unit_ordinal bigint, name string, receiver string, namespace string, parameters {VALUES}, returns {VALUES}, def_line int, span {SPAN}, body_span {SPAN}, extras string, lang string, signature string"
CLAZZ = f"name string, module string, span {SPAN}, extras string, lang string, signature string"
SYMBOL = f"symbol string, kind string, field_name string, span {SPAN}"
CALL = f"src string, caller string, arguments array<string>, span {SPAN}"
UNIT = f"unit_id bigint, parent_id bigint, last_descendant_id bigint, depth int, kind string, field_name string, content string, span {SPAN}"
#: Languages whose calls are extracted.
WITH_CALLS = ("GOLANG", "JAVA")
#: Facts that a task gathers before it hands them on.
BATCH_ROWS = 10_000


@dataclass(frozen=True)
class Language:
    """What facts need to know of a language's trees.

    functions, classes: kinds of nodes that declare one. body: kind of a function's body. package:
    kind of the node that names the package, and kinds of the name in it. names: kinds of the child
    that names a declaration. parser: text -> (Source, root Node); None for a built-in one.
    extractors: own functions Facts -> iterator of rows in place of the general ones, by what they
    extract (func, class, symbol, call); a row needs only the columns that the language has.
    """

    functions: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    body: str = "block"
    package: tuple[str, tuple[str, ...]] | None = None
    names: tuple[str, ...] = ("identifier", "field_identifier", "simple_identifier", "property_identifier", "string")
    parser: Callable[[str], tuple[Source, Node]] | None = None
    extractors: Mapping[str, Callable[["Facts"], Iterator[dict]]] = field(default_factory=dict)


_LANGUAGES: dict[str, Language] = {
    "GOLANG": Language(("function_declaration", "method_declaration"), ("type_spec",), "block", ("package_clause", ("package_identifier",))),
    "JAVA": Language(("method_declaration",), ("class_declaration", "enum_declaration", "interface_declaration"), "block", ("package_declaration", ("scoped_identifier", "identifier"))),
    "KOTLIN": Language(("function_declaration",), ("class_declaration",), "function_body", ("package_header", ("identifier",))),
    "JAVASCRIPT": Language(("function_declaration", "method_definition"), ("class_declaration",), "statement_block"),
    "PYTHON": Language(("function_definition",), ("class_definition",), "block"),
}
_BUILT_IN = frozenset(_LANGUAGES)


def register_language(name: str, suffix: str, language: Language) -> None:
    """Add a language: files that end with ``suffix`` are parsed by its parser, and its facts are
    extracted like those of the built-in ones. A name that is there is an error. The parser is sent
    to the tasks, which must be able to import its module."""
    if name in _LANGUAGES:
        raise ValueError(f"{name} is registered already")
    if language.parser is None:
        raise ValueError(f"{name} has no parser")
    _LANGUAGES[name] = language
    SUFFIXES[suffix] = name


def register_extractor(name: str, what: str, rows: Callable[["Facts"], Iterator[dict]]) -> None:
    """Extract one kind of facts of a registered language by a function of one's own. A second one
    for the same facts is an error."""
    if what not in _WHAT:
        raise ValueError(f"no facts {what}")
    if name in _BUILT_IN or what in _LANGUAGES[name].extractors:
        raise ValueError(f"{what} of {name} is registered already")
    _LANGUAGES[name] = replace(_LANGUAGES[name], extractors={**_LANGUAGES[name].extractors, what: rows})


def unregister_language(name: str) -> None:
    """Take a registered language back; built-in ones stay."""
    if name in _BUILT_IN:
        raise ValueError(f"{name} is built in")
    del _LANGUAGES[name]
    for suffix in [s for s, n in SUFFIXES.items() if n == name]:
        del SUFFIXES[suffix]


def _span(src: Source, n: Node | None) -> dict | None:
    if n is None:
        return None
    (a, b), (c, d) = src.point(n.start), src.point(n.end)
    return {"start": {"row": a, "column": b}, "end": {"row": c, "column": d}}


class Facts:
    """All facts of one parsed file."""

    def __init__(self, text: str, lang: str, language: Language | None = None) -> None:
        self.lang = lang
        if (known := language or _LANGUAGES.get(lang)) is None:
            raise ParseError(f"no parser for {lang}")
        self.language = known
        self.src, self.root = parse(text, lang, known.parser)
        self.nodes: list[tuple[Node, list[Node]]] = []
        self._walk(self.root)
        self.package = ""
        if known.package and (p := self.root.child(known.package[0])) and (inner := p.child(*known.package[1])):
            self.package = self.src.of(inner)

    def _walk(self, root: Node) -> None:
        todo: list[tuple[Node, list[Node]]] = [(root, [])]
        while todo:
            n, above = node = todo.pop()
            self.nodes.append(node)
            if n.children:
                around = [*above, n]
                todo += [(c, around) for c in reversed(n.children)]

    def _values(self, owner: Node | None, *kinds: str) -> list[dict]:
        """(type, name) of the declarations below a list, nested lists included."""
        out = []
        for n in owner.walk() if owner else ():
            if n.kind in kinds:
                t, name = n.by_field("type"), n.by_field("name")
                out.append({"type": self.src.of(t) if t else "", "name": self.src.of(name) if name else ""})
        return out

    def _annotations(self, owner: Node) -> list[str] | None:
        mods = owner.child("modifiers")
        return [self.src.of(x) for x in mods.all("marker_annotation", "annotation")] or None if mods else None

    def _decorators(self, above: list[Node]) -> list[str] | None:
        return [self.src.of(x) for x in above[-1].all("decorator")] if above and above[-1].kind == "decorated_definition" else None

    def functions(self) -> Iterator[dict]:
        k = 0
        for n, above in self.nodes:
            if n.kind in self.language.functions and (f := self._function(n, above)):
                yield f | {"unit_ordinal": k}
                k += 1

    def _function(self, n: Node, above: list[Node]) -> dict | None:
        lang, of = self.lang, self.src.of
        if (name := n.child(*self.language.names)) is None:
            return None
        body = n.child(self.language.body)
        owner = next((x for x in reversed(above) if x.kind in self.language.classes), None)
        owner_name = of(x) if owner and (x := owner.child("identifier", "type_identifier")) else None
        parameters: list[dict] | None = None
        returns: list[dict] | None = None
        receiver, extras = "", None
        if lang == "GOLANG":
            lists = n.all("parameter_list")
            own = next((x for x in lists if x.field == "receiver"), None)
            if own:
                t = next((x.by_field("type") for x in own.children), None)
                receiver = of(t) if t else ""
            parameters = self._values(n.by_field("parameters"), "parameter_declaration") or None
            result = n.by_field("result")
            if result is not None and result.kind == "parameter_list":
                returns = self._values(result, "parameter_declaration") or None
            elif result is not None and result.kind == "type_identifier":
                returns = [{"type": of(result), "name": ""}]
            extras = {}
        elif lang == "JAVA":
            if owner_name is None:
                return None
            receiver = f"{self.package}.{owner_name}"
            parameters = self._values(n.by_field("parameters"), "formal_parameter") or None
            returns = [{"type": of(n.by_field("type")), "name": ""}]
            extras = {"annotations": self._annotations(n), "classInfo": {"packageName": self.package, "className": owner_name, "annotations": self._annotations(owner)}}
        elif lang == "KOTLIN":
            receiver = f"{self.package}.{owner_name}" if owner_name else ""
        elif lang == "PYTHON":
            owner = next((x for x in reversed(above) if x.kind == "class_definition"), None)
            receiver = of(owner.child("identifier")) if owner else ""
            extras = {"decorators": self._decorators(above)}
        elif lang == "JAVASCRIPT" and n.kind == "method_definition":
            receiver = owner_name or ""
            parameters = [{"type": "", "name": of(x)} for x in n.by_field("parameters").all("identifier")] or None
        elif lang not in _BUILT_IN:
            receiver = owner_name or ""
            parameters = self._values(n.by_field("parameters"), "parameter") or None
            returns = [{"type": of(t), "name": ""}] if (t := n.by_field("result")) else None
        namespace = "" if lang in ("PYTHON", "JAVASCRIPT") else self.package
        line = 0 if n.kind == "method_definition" else self.src.point(name.start)[0] + 1
        types = lambda v: ",".join(x["type"] for x in v or ())
        return {
            "name": of(name), "receiver": receiver, "namespace": namespace, "parameters": parameters, "returns": returns, "def_line": line, "span": _span(self.src, n), "body_span": _span(self.src, body),
            "extras": None if extras is None else json.dumps(extras, ensure_ascii=False), "lang": lang, "signature": "|".join((namespace, receiver, of(name), types(parameters), types(returns))),
        }

    def classes(self) -> Iterator[dict]:
        of = self.src.of
        for n, above in self.nodes:
            if n.kind not in self.language.classes or self.lang == "GOLANG" and not n.child("struct_type") or not (own := n.child("identifier", "type_identifier")):
                continue
            name = of(own)
            module = self.package
            extras: dict | None = None
            if self.lang == "GOLANG":
                fields = n.child("struct_type").child("field_declaration_list")
                extras = {"fields": [{"type": of(t) if (t := f.by_field("type")) else "", "name": of(x) if (x := f.by_field("name")) else ""} for f in fields.children] or None}
            elif self.lang == "JAVA":
                extras = self._java_class(n)
            elif self.lang == "PYTHON":
                extras = {"decorators": self._decorators(above)}
            yield {"name": name, "module": module, "span": _span(self.src, n), "extras": None if extras is None else json.dumps(extras, ensure_ascii=False), "lang": self.lang, "signature": f"{module}.{name}"}

    def _java_class(self, n: Node) -> dict:
        of = self.src.of
        fields = []
        for f in body.all("field_declaration") if (body := n.child("class_body")) else ():
            d = f.by_field("declarator")
            mods = f.child("modifiers")
            notes = [of(x) for x in mods.children] if mods else []
            rest = of(mods) if mods else ""
            for x in notes:
                rest = rest.replace(x, "", 1)
            if d:
                fields.append({"name": of(d.child("identifier")), "type": of(f.by_field("type")), "annotations": notes or None, "modifiers": rest.split() or None})
        above, faces = n.child("superclass"), n.child("super_interfaces")
        mods = n.child("modifiers")
        plain = of(mods) if mods else ""
        for x in mods.children if mods else ():
            plain = plain.replace(of(x), "", 1)
        return {
            "annotations": self._annotations(n), "fields": fields or None, "modifiers": plain.split() or None, "extends": of(above.children[0]) if above else "",
            "implements": [of(x) for x in faces.child("type_list").all("type_identifier")] or None if faces else None,
        }

    def symbols(self) -> Iterator[dict]:
        for n, _ in self.nodes:
            if n.kind.endswith("identifier"):
                yield {"symbol": self.src.of(n), "kind": n.kind, "field_name": n.field, "span": _span(self.src, n)}

    def calls(self) -> Iterator[dict]:
        if self.lang not in WITH_CALLS:
            raise NotImplementedError(f"calls of {self.lang} are not extracted")
        of, signatures = self.src.of, {}
        for n, above in self.nodes:
            if n.kind not in ("call_expression", "method_invocation"):
                continue
            k = next((i for i in range(len(above) - 1, -1, -1) if above[i].kind in self.language.functions), None)
            if k is None or not (own := signatures.get(id(above[k])) or self._function(above[k], above[:k])):
                continue
            signatures[id(above[k])] = own
            if self.lang == "JAVA":
                obj, name = n.by_field("object"), n.by_field("name")
                caller = f"{of(obj)}.{of(name)}" if obj else of(name)
            else:
                caller = of(n.by_field("function"))
            arguments = [of(x) for x in n.by_field("arguments").all("identifier")]
            if self.lang == "JAVA" and n.by_field("object"):
                arguments = []  # only those of plain calls are looked at
            yield {"src": own["signature"], "caller": caller, "arguments": arguments or None, "span": _span(self.src, n)}

    def units(self, content: bool = True, span: bool = True, kinds: Sequence[str] | None = None) -> Iterator[dict]:
        """Every node, or those of the kinds; its text and its span only if asked for, as each level
        of a tree repeats the text."""
        parents: list[int] = []
        path: list[int] = []  # numbers of the nodes around the next one
        for k, (_, above) in enumerate(self.nodes):
            del path[len(above) :]
            parents.append(path[-1] if path else -1)
            path.append(k)
        last = list(range(len(parents)))
        for k in range(len(parents) - 1, 0, -1):
            last[parents[k]] = max(last[parents[k]], last[k])
        for k, (n, above) in enumerate(self.nodes):
            if kinds is not None and n.kind not in kinds:
                continue
            unit = {"unit_id": k, "parent_id": parents[k] if above else None, "last_descendant_id": last[k], "depth": len(above), "kind": n.kind, "field_name": n.field}
            if content:
                unit["content"] = self.src.of(n)
            if span:
                unit["span"] = _span(self.src, n)
            yield unit


_WHAT = {"func": (FUNCTION, Facts.functions), "class": (CLAZZ, Facts.classes), "symbol": (SYMBOL, Facts.symbols), "call": (CALL, Facts.calls), "unit": (UNIT, Facts.units)}


def extract(files: DataFrame, what: str, keys: list[str], lang: str = "lang", text: str = "text", columns: Sequence[str] | None = None, kinds: Sequence[str] | None = None) -> DataFrame:
    """(keys..., facts..., error) of every file: ``what`` is func, class, symbol, call or unit.
    ``columns`` are the facts that are given out, ``kinds`` the kinds of units; None gives all.

    A file that can't be parsed, or only in part and without facts there, gives one row with
    ``error`` and no facts, as does one of a language without a parser; facts of a file parsed in
    part have its ``error`` beside them. Null texts give none. Equal texts of a language in one batch
    are parsed once. A task holds the facts of one text and ``BATCH_ROWS`` more, however many texts
    a batch has.
    """
    ddl, method = _WHAT[what]
    # shipped with the tasks, as a worker knows nothing of what was registered here
    languages = {n: x for n, x in _LANGUAGES.items() if n not in _BUILT_IN}
    if what == "call":
        files = files.filter(F.col(lang).isin(*WITH_CALLS, *(n for n, x in languages.items() if "call" in x.extractors)))
    fields = [f for f in T._parse_datatype_string(ddl).fields if columns is None or f.name in columns]
    schema = T.StructType([*(files.schema[k] for k in keys), *fields, T.StructField("error", T.StringType())])
    names = [f.name for f in fields]
    if what == "unit":
        method = partial(Facts.units, content="content" in names, span="span" in names, kinds=kinds)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same: dict[tuple[str, str], list[int]] = {}
            for k, known in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())):
                same.setdefault(known, []).append(k)

            def given(at: list[int], rows: list[dict], errors: list[str | None]) -> pa.RecordBatch:
                take = pa.array(at, pa.int64())
                cols = [pa.array([r.get(n) for r in rows], arrow.field(n).type) for n in names]
                return pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keys))), *cols, pa.array(errors, pa.string())], names=schema.names)

            at, rows, errors = [], [], []
            for (g, x), places in same.items():
                try:
                    facts = Facts(x, g, languages.get(g))
                    found, error = list(facts.language.extractors.get(what, method)(facts)), facts.src.error
                except ParseError as e:
                    found, error = [], str(e)
                found = found or [{}] * (error is not None)
                for k in places:
                    for i in range(0, len(found), BATCH_ROWS):
                        some = found[i : i + BATCH_ROWS]
                        if len(rows) + len(some) > BATCH_ROWS:
                            yield given(at, rows, errors)
                            at, rows, errors = [], [], []
                        at += [k] * len(some)
                        rows += some
                        errors += [error] * len(some)
            if rows:
                yield given(at, rows, errors)

    rows = files.select(*keys, lang, text).filter(F.col(text).isNotNull())
    return spread(rows).mapInArrow(run, schema)


def extract_text(spark, text: str, lang: str, what: str = "func", path: str = "") -> DataFrame:
    """Facts of a single text held in memory."""
    if what == "class":
        raise ValueError("classes are not extracted from a text in memory; use extract")
    return extract(spark.createDataFrame([(path, lang, text)], "path string, lang string, text string"), what, ["path"])
