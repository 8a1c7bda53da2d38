"""What the header of a source file says about where the file comes from.

A header is the whole leading run of comments, doc strings, blank lines and preamble statements,
however long, and the run of comments at the very end. One automaton holds all words that matter;
only sentences that it hits are parsed. A sentence counts by its grammar: it must speak of the file
itself ("this file was generated by ...", "generated from x.proto", "automatically generated") and
not of something the file makes or reads.
"""

from __future__ import annotations

import re

#: Public tools that write source files, as words in lower case.
TOOLS = """
antlr antlr4 bison yacc goyacc byacc racc flex lex jflex javacc javacup jison peg.js pegjs pigeon ragel re2c gperf lemon coco/r sablecc
protoc protobuf protocol protoc-gen-go grpc grpc_tools thrift avro flatbuffers flatc capnp capnproto asn1c swig cython coffeescript
typescript tsc babel webpack browserify rollup esbuild parcel uglifyjs closure livescript elm purescript haxe dart2js emscripten
django alembic rails activerecord prisma sqlc sqlboiler jooq mybatis hibernate querydsl ent gqlgen graphql graphql-codegen relay apollo openapi
swagger openapi-generator swagger-codegen oapi-codegen go-swagger smithy autorest kiota nswag wsdl2java wsimport jaxb xjc jaxb2 axis cxf svcutil xsd.exe
mockgen mockery gomock counterfeiter stringer enumer controller-gen deepcopy-gen client-gen lister-gen informer-gen conversion-gen defaulter-gen go-bindata
bindata esc statik packr wire easyjson ffjson msgp genny genqlient bindgen cbindgen prost tonic diesel uniffi
pyuic4 pyuic5 pyuic6 pyside2-uic pyrcc5 pyrcc uic moc rcc qmake cmake autoconf automake autoheader configure libtool gyp gn
autovalue dagger butterknife kapt ksp moshi lombok mapstruct immutables aapt aapt2 r8 proguard viewbinding databinding buildconfig
f2py f2c cffi sip pybind11 ctypesgen sphinx-apidoc setuptools_scm versioneer poetry pip-compile pipenv numpy.distutils setup.py
resgen t4 msbuild xcodegen swiftgen sourcery r.swift swiftproto nanopb jnaerator jextract javah kotlinpoet javapoet gwt
""".split()
#: Nouns of things that write files.
TOOLISH = "compiler generator tool script plugin codegen transpiler translator preprocessor processor toolchain assembler wizard framework makefile".split()
#: Stems by which the automaton finds the sentences to parse.
STEMS = """gener gnr gerad gegener produced made created compiled built written emitted translated transpiled converted erzeugt erstellt
自動 自动 자동 сгенер автомат wygener part\xa0of distribut copied vendored imported licen redistribut version release @license @preserve""".split()

_noun = r"(?:file|code|source|sources|header|class|classes|module|script|document|interface|parser|lexer|scanner|analyzer|recognizer|bindings?|stubs?|wrappers?|package|contents?|schema|migration|config|configuration|client|fichier|datei|quelltext|quellcode|archivo|fichero|cdigo|codigo|arquivo|bestand|codice)"
_lead = r"^\W*(?:(?:warning|note|notice|attention|important|caution|nb|achtung|atencin|info)\b[\W]*)*(?:please\s+(?:note|be aware)\s+(?:that\s+)?)?"
_aux = r"(?:(?:is|was|has|have|been|were|are|an?|t|est|wurde|wird|ist|fue|sido|ha|foi|stato|werd|being)\s+)+"
_adv = r"(?:automatically|automatic|auto|machine|programmatically|mechanically|automatisch|maschinell|automatiquement|automticamente|automaticamente|automatycznie)"
_verb = r"(?:re-?)?(?:generated|produced|created|compiled|built|made|emitted|written|translated|transpiled|converted|generiert|erzeugt|erstellt|gnre?s?|generado|generada|gerado|gerada|generato|gegenereerd|creado|criado)"
_auto = rf"(?:{_adv}[\s-]*@?{_verb}|{_verb}\s+{_adv})"
_by = r"(?:by|from|using|with|via|through|par|durch|mit|von|aus|por|con|da|dal|door|do)"
#: the sentence speaks of this file, or leaves the subject out
_self = rf"(?:(?:this|ce|cet|cette|diese|dieser|este|esta|questo|dit|deze)\s+(?:[\w.+#/-]+\s+){{0,2}}?{_noun}\s+|(?:the\s+(?:following|present)\s+|all\s+)?(?:source\s+)?{_noun}\s+|this\s+|it\s+)"
_german = re.compile(rf"^\W*(?:diese[rs]?)\s+(?:[\w.+#/-]+\s+){{0,2}}?{_noun}\s+(?:wurde|wird|ist)\s+.{{0,80}}\b(?:generiert|erzeugt|erstellt)\b")
_start = re.compile(rf"{_lead}(?P<self>{_self}(?:{_aux})?)?(?:(?P<auto>{_auto})|(?P<plain>{_verb}))\b(?P<rest>.*)", re.S)
_loose = re.compile(rf"{_lead}(?!(?:the|our|these|those|each|every|all|their)\b)(?:an?\s+|this\s+)?(?:[\w.+#/-]+\s+){{0,3}}?{_noun}\b[\s,(]*(?:{_aux})?(?:{_adv}\s+)?{_verb}\s+{_by}\s*:?\s+(?P<agent>.*)|{_lead}[\w/-]+\.\w+\s+{_verb}\s+{_by}\s+(?P<tool>.*)", re.S)
_noun_phrase = re.compile(rf"(?<!the )\b(?:{_adv}[\s-]*)?generated\s+(?:[\w+#]+\s+)?(?:file|code|source|header|class|module|parser|content|document|script)\b")
_goes_on = re.compile(rf"\s*(?:$|[-.:;,!()\[<>\"'*=~|/]|{_by}\b|at\b|on\b|and\s+(?:should|must|will|any)\b|for\s+you\b|do\s+not\b)")
_own_noun = re.compile(rf"[\s-]*{_noun}\b(?P<after>.*)", re.S)
_elsewhere = re.compile(r"\b(?:lives?|goes|go|lands?|ends? up|is kept|are kept|is in|are in|is stored|are stored|can be found|belongs?|gets? checked|is checked|is not checked)\b")
_not_tools = re.compile(rf"\s*{_by}\s+(?:hand|me|us|humans?|people|myself|the (?:user|users|caller|callers|client|customer|server|database|author)|this|these|our|callers?|users?|cron)\b")
_file_name = re.compile(r"[\w/*-]+\.[a-z][a-z0-9+]{0,9}\b")
_one_name = re.compile(r"[\w./@:+\"'`-]+\s*[.,;)!]*\s*$")
_this_is = re.compile(rf"\W*this\s+(?:is\s+)?(?:an?\s+)?(?:{_adv}[\s-]*|\w+[\s-]+)?generated\b(?:\s+[\w+#]+){{0,3}}?\s+{_noun}\b")
_version = re.compile(r"\bv?\d+(?:\.\d+)+")
_tool_like = re.compile(r"\b[\w.-]*(?:codegen|compil|proto|[a-z]gen\b|gen-|-gen|2[a-z]+\b)[\w.-]*")
_edit = re.compile(
    r"(?:do(?:es)? not|don'?t|never|no|cannot)\s+(?:ever\s+|manually\s+|hand[\s-]+)?(?:edit|modify|change|alter|touch|update|editar|edite|modificar|modifique|altere)|not\s+be\s+(?:manually\s+|hand[\s-]?)?(?:edited|modified|changed)"
    r"|(?:changes|edits|modifications)\b.{0,80}\b(?:lost|overwritten|discarded|incorrect|removed|erased)|\bbe\s+(?:lost|overwritten)|ne\s+(?:pas\s+)?(?:modifier|modifiez|diter|toucher)|nicht\s+(?:von\s+hand|ndern|bearbeiten|editieren|manuell|verndern)"
    r"|non\s+modificare|niet\s+(?:bewerken|aanpassen|wijzigen)|\bre-?(?:run|generate|build)\b|\brun\s+\S+\s+again|\bdo not edit"
)
_marker = re.compile(r"^\W*(?:@generated\b(?!\s+(?:tag|marker|annotation|comment|header|file|code)s?\b)|<auto-?generated)")
_foreign = re.compile(r"自動生成|自动生成|自動的に生成|自动产生|자동\s?생성|자동으로\s?생성|автоматически\s+(?:сгенерир|создан)|сгенерирован\w*\s+(?:автоматически|с\s+помощью|из|программой)|wygenerowan\w*\s+(?:automatycznie|przez)|automatycznie\s+wygenerowan")

_sign = re.compile(r"^\s*(?:///?!?|#+!?|/\*+!?|\*+(?!/)|--+|;+|%+|\"\"\"|'''|<!--|\(\*|\{-|rem\b)?[\s*=#/~_-]*", re.I)
_tail = re.compile(r"[\s*=#/~_-]*(?:\*/|-->|\"\"\"|'''|\*\)|-\})?\s*$")
_preamble = re.compile(r"\s*(?:package\b|import\b|from\s+\S+\s+import\b|using\b|namespace\s+[\w.]+;|#\s*(?:include|pragma|ifndef|define|if|endif)\b|['\"]use strict['\"]|<\?(?:php|xml)|@file:|module\s+[\w.]+;?$|option\s|syntax\s*=|library\b|\)\s*$|\"[\w./-]+\"\s*$)")
_line_comment = re.compile(r"\s*(?://|#|--|;|%|rem\b)", re.I)
_opens = {"/*": "*/", '"""': '"""', "'''": "'''", "<!--": "-->", "(*": "*)", "{-": "-}"}


def header(lines: list[str]) -> list[list[str]]:
    """The comments at the head of a file, as paragraphs of bare lines."""
    out: list[list[str]] = [[]]
    closing: str | None = None
    for k, raw in enumerate(lines):
        line = raw.removeprefix("﻿") if not k else raw
        s = line.strip()
        if closing:
            done = closing in s
            _add(out, s.split(closing)[0] if done else s)
            if done:
                closing = None
                _add(out, "")
            continue
        if not s or not k and s.startswith("#!"):
            _add(out, "")
            continue
        opens = next((o for o in _opens if s.startswith(o)), None)
        if opens:
            rest = s[len(opens) :]
            if _opens[opens] in rest:
                _add(out, rest.split(_opens[opens])[0])
                _add(out, "")
                if rest.split(_opens[opens], 1)[1].strip():
                    break
            else:
                closing = _opens[opens]
                _add(out, rest)
        elif _line_comment.match(s) and not re.match(r"#\s*(?:include|pragma|ifndef|define|if|endif)\b", s):
            _add(out, s)
        elif _preamble.match(s):
            _add(out, "")
        else:
            break
    return [p for p in out if p]


def footer(lines: list[str]) -> list[list[str]]:
    """The comments of single lines at the very end."""
    out: list[str] = []
    for raw in reversed(lines):
        s = raw.strip()
        if s and not (_line_comment.match(s) or s.startswith("/*") and s.endswith("*/")):
            break
        if s:
            out.append(s)
    paragraphs: list[list[str]] = [[]]
    for s in reversed(out):
        _add(paragraphs, s)
    return [p for p in paragraphs if p]


def _add(paragraphs: list[list[str]], line: str) -> None:
    bare = _tail.sub("", _sign.sub("", line.strip(), count=1))
    if bare:
        paragraphs[-1].append(bare)
    elif paragraphs[-1]:
        paragraphs.append([])


def sentences(paragraph: list[str]) -> list[str]:
    """Sentences in lower case; a line that ends none goes on in the next, unless that begins with a
    capital or a sign of its own."""
    text = "".join(("\n" if x[:1].isupper() or x[:1] in "@<" else " ") + x for x in paragraph).lower()
    return [s for s in re.split(r"(?<=[.!?])\s+(?=\S)|\n|\s*[;|]\s+|\s+(?:-{1,2}|–|—)\s+(?=do\b)", text) if s.strip()]


_KEPT: dict[str, object] = {}


def automaton():
    """The automaton over tools, tool-like nouns and stems, kept per worker."""
    if "words" not in _KEPT:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, words in (("stem", STEMS), ("toolish", TOOLISH), ("tool", TOOLS)):
            for w in words:
                a.add_word(w, (kind, len(w)))
        a.make_automaton()
        _KEPT["words"] = a
    return _KEPT["words"]


def _kinds(text: str) -> set[str]:
    """What the automaton finds in a text; tools and tool-like nouns only as whole words."""
    out = set()
    for end, (kind, n) in automaton().iter(text):
        if kind == "stem" or not (text[end - n : end - n + 1].isalnum() and end >= n or text[end + 1 : end + 2].isalnum()):
            out.add(kind)
    return out


def _plain(text: str) -> str:
    """Without what is no ASCII: accented letters, or what a wrong encoding made of them."""
    return text if text.isascii() else re.sub(r"[^\x00-\x7f]+", "", text)


def _generated(s: str, near: str) -> bool:
    """Whether a sentence says that this file was generated; ``near`` are its neighbours, too."""
    if _marker.match(s):
        return True
    if _foreign.search(s):
        return True
    s, near = _plain(s), _plain(near)
    warned = bool(_edit.search(near))
    if _german.match(s):
        return True
    if m := _start.match(s):
        rest = m["rest"]
        if (m["self"] or "").startswith("it") and not warned:
            return False
        if _not_tools.match(rest) and "tool" not in _kinds(rest):
            return False
        if m["auto"]:
            if _goes_on.match(rest):
                return not _elsewhere.search(rest) or warned
            return (n := _own_noun.match(rest)) is not None and (warned or not re.match(r"\s*(?:\w+\s+)?\w", n["after"]) or re.match(rf"\s*{_by}\b", n["after"]) is not None)
        by = re.match(rf"\s*{_by}(?:\s*:\s*|\s+)(?P<agent>.*)", rest, re.S)
        verb = m["plain"].removeprefix("re").lstrip("-")
        if not by:
            n = _own_noun.match(rest)
            after = n["after"] if n and verb == "generated" else rest
            ends = re.match(r"\s*(?:$|[-.:;,!(])", after) is not None or n is not None and re.match(rf"\s*{_by}\b", after) is not None
            return ends and (warned or bool(m["self"]) and verb == "generated")
        agent = by["agent"]
        if _elsewhere.search(agent) and not warned:
            return False
        known = _kinds(agent)
        by_tool = bool(known & {"tool", "toolish"})
        if verb in ("generated", "generiert", "erzeugt", "generado", "gerado", "generato", "gegenereerd") or verb.startswith("gnr"):
            return bool(m["self"]) or warned or by_tool or bool(_version.search(agent) or _file_name.match(agent) or _tool_like.match(agent) or _one_name.match(agent))
        return by_tool or warned and bool(m["self"] or _file_name.match(agent))
    if (m := _loose.match(s)) and not _elsewhere.search(a := m["agent"] or m["tool"] or ""):
        if "tool" in (kinds := _kinds(a[:60])) or warned and ("toolish" in kinds or _tool_like.match(a)):
            return True
    return _this_is.match(s) is not None or warned and _noun_phrase.search(s) is not None


_part = re.compile(r"\b(?:part of|distributed (?:with|as part of|along with)|copied from|taken from|vendored from|imported from|extracted from|comes with|shipped (?:with|as part of)|bundled with)\s+(?:the\s+)?(?!(?:chapter|section|rfc|table|figure|page|appendix|spec|lock)\b)(?P<name>[\w.@/+-]*\w)\b(?P<rest>[^\n]{0,80})")
_licence_version = re.compile(r"(?:licen[sc]e|gpl|lgpl|mpl|agpl|apache|public)\W+(?:as published by .{0,60})?(?:version|v)?\W*\d")
_numbered = re.compile(r"(?:\b(?:release|version|v|ver\.?)\s*|^\s*,?\s*(?:v)?)\d+(?:\.\d+)+")
_terms = re.compile(
    r"redistribut|permission is hereby granted|licen[sc]ed under|released under|under the (?:terms|mit|bsd|apache|\w+ licen[sc]e)|spdx-license-identifier|\bmit licen[sc]e|\bbsd licen[sc]e|apache licen[sc]e"
    r"|(?:notice|licen[sc]e|copying)(?:\.\w+)?(?: file)? (?:shipped|distributed|included|supplied|bundled|provided|that comes?|for)|for (?:licen[sc]e |the full |full )?terms|see (?:the )?(?:licen[sc]e|notice|copying)"
)
_banner = re.compile(r"^\W*(?:@?(?:license|preserve|licence)\b\W*)?[\w@./ -]{1,60}?\s+v?\d+\.\d+(?:\.\d+)*(?:[\w.+-]*)?\b.{0,200}?(?:\(c\)|copyright|licen[sc]e|https?://)")


def _third_party(text: str, banner: bool) -> bool:
    """Whether a header names a released package and the terms on which it may be passed on."""
    flat = _plain(text)
    if banner and _banner.match(flat) and not _licence_version.match(flat):
        return True
    if not _terms.search(flat):
        return False
    return any(_numbered.search(_licence_version.sub(" ", m["rest"])) for m in _part.finditer(flat))


def origin(lines: list[str]) -> str | None:
    """``generated`` or ``vendored`` if the file's own header or footer says so, else None."""
    head, foot = header(lines), footer(lines)
    vendored = False
    for paragraphs in (head, foot):
        flat = [sentences(p) for p in paragraphs]
        every = [s for p in flat for s in p]
        for k, s in enumerate(every):
            if (s.startswith(("@gen", "<auto")) or "stem" in _kinds(_plain(s)) or not s.isascii() and "stem" in _kinds(s)) and _generated(s, " ".join(every[max(0, k - 1) : k + 3])):
                return "generated"
    if head:
        whole = " ".join(" ".join(p) for p in head).lower()
        first = next((x for x in lines if x.strip()), "").lstrip("﻿ \t")
        vendored = bool(_kinds(_plain(whole)) & {"stem"}) and _third_party(whole, first.startswith("/*!") or "@license" in whole or "@preserve" in whole)
    return "vendored" if vendored else None
