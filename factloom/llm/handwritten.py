"""Source files that nobody wrote by hand: generated, minified, copied from third parties, or data.

Automata find the words of generation notices and of third-party headers, which count by the grammar
of their sentence (:mod:`factloom.llm.notices`), and the names that only generators use; path rules
name generated and vendored folders, lockfiles and minified suffixes; layout tells minified text and
tables of literals; five-word shingles tell copies of published packages, adapted ones included.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import notices
from factloom.runtime import materialize, plan_bytes, spread

KINDS = ("generated", "minified", "vendored", "data")

#: Names that only the output of public code generators uses (protocol buffers, gRPC,
#: parser and binding generators, bundlers), in lower case. A text needs IDIOM_HITS of them, and one
#: in IDIOM_LINES lines.
IDIOMS = (
    "bitfield0_", "_descriptor.field", "_descriptor.enum", "_serialized_start", "jspb.", "proto.internal.", "protoimpl.", "com.google.protobuf.generatedmessage", "xxx_unrecognized",
    "jj_", "yypact", "yytable", "yydefact", "yy_current_state", "_serializedatn", "_atn.", "$$[$0", "yytransition", "zend_parse_", "swigtype_p_", "__pyx_", "_cgo_",
    "__webpack_require__", "_interoprequire", "regeneratorruntime", "__esmodule", "qt_static_metacall", "qt_meta_", "dagger.internal.", "internal_static_",
)
IDIOM_HITS, IDIOM_LINES = 3, 25
#: Getters as the protocol buffer compiler writes them for Go.
_getters = re.compile(r"^func \((\w+) \*\w+\) Get\w+\(\) [^\n]*\{\s*if \1 != nil \{\s*return \1\.", re.M)
#: Annotations that mark generated classes, where a line begins with them.
_annotated = re.compile(r"^\s*(?:@(?:[\w.]+\.)?Generated\s*\(|\[(?:[\w.]+\.)?GeneratedCode(?:Attribute)?\s*\()", re.M)

#: Folders that hold generated files, and folders of third-party packages.
GENERATED_PATH = r"(^|/)(build/generated|target/generated-sources|generated-sources|generated-src|gen|autogen|__generated__)/"
GENERATED_NAME = r"(\.pb\.(go|cc|h)|_pb2\.pyi?|_pb2_grpc\.py|_pb\.(js|d\.ts)|\.g\.(js|kt|dart|cs)|\.generated\.\w+|_gen\.\w+|_deepcopy\.go|OuterClass\.java|Grpc\.java|(^|/)(mock_|zz_)[^/]*\.go)$"
VENDORED_PATH = r"(^|/)(vendor|_vendor|third_party|third-party|node_modules|bower_components|Godeps/_workspace|extern|deps|site-packages)/"
LOCK_NAME = r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Pipfile\.lock|Cargo\.lock|Gemfile\.lock|composer\.lock|go\.sum|gradle\.lockfile)$"
MINIFIED_NAME = r"\.(min|bundle|prod\.min)\.(js|css|mjs)$"
DATA_PATH = r"(^|/)[^/]+\.(csv|tsv|parquet|svg|geojson|ipynb)$"

#: Share of a text in lines longer than LONG_LINE, and their white space at most, that make it minified.
LONG_LINE, LONG_SHARE, LONG_SPACE = 200, 0.8, 0.15
#: Mean length of a line and share of white space of minified text that is wrapped.
WRAPPED_LINE, WRAPPED_SPACE = 80, 0.08
#: Share of a text in lines of nothing but literals that makes it data.
DATA_SHARE = 0.6
#: Share of lines that are rows of a numbered table which makes a text one, rows needed, and how many
#: forms the rows have at most.
TABLE_SHARE, TABLE_ROWS, TABLE_FORMS = 0.6, 8, 2
#: Words of a shingle, and the share of a text's shingles that one published file must hold. The
#: copies may be adapted, so what counts is how much of the text is taken over.
SHINGLE, COPIED = 5, 0.6
#: Bytes on disk up to which the published files' shingles are broadcast.
BROADCAST_BYTES = 16 << 20

_literal_line = re.compile(r"""(?:\s*(?:[rbuRBU]?"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_.]*(?:[eE][-+]?\d+)?[fFlLuU]*)|true|false|null|None|nil)?\s*[,;:\[\](){}+]*\s*)+""")
_word = re.compile(r"\w+")
_row = re.compile(r"\s*(?:case\s+(\d+)\s*:|[\w.$]+\[(\d+)\]\s*=|(\d+)\s*(?:->|=>|:)\s)(.*)")
_digits = re.compile(r"\d+")
_KEPT: dict[str, object] = {}


def automaton():
    """The automaton over all idioms, kept per worker."""
    if "automaton" not in _KEPT:
        import ahocorasick

        a = ahocorasick.Automaton()
        for p in IDIOMS:
            a.add_word(p, p)
        a.make_automaton()
        _KEPT["automaton"] = a
    return _KEPT["automaton"]


def has_idioms(text: str, n_lines: int) -> bool:
    """Whether a text is as full of one generator's names as only its output is."""
    need = max(IDIOM_HITS, n_lines / IDIOM_LINES)
    found: dict[str, int] = {}
    for _, p in automaton().iter(text.lower()):
        found[p] = found.get(p, 0) + 1
    return any(n >= need for n in found.values()) or "!= nil" in text and len(_getters.findall(text)) >= need


def literal_share(lines: list[str]) -> float:
    total = literal = 0
    for x in lines:
        s = x.strip()
        total += len(s)
        if s and (s[0] in "\"'-+0123456789[({rbuRBUtfnN])}" and _literal_line.fullmatch(s)):
            literal += len(s)
    return literal / total if total else 0.0


def table_share(lines: list[str]) -> float:
    """Share of lines that are rows of a numbered table, as parser and lexer generators write them:
    numbers that count up one by one, each with an entry of numbers and numbered names in one of a
    few forms. A list of named constants is none, nor is a switch with code of its own per case."""
    rows, filled = [], 0
    for x in lines:
        if x.strip():
            filled += 1
            if (m := _row.match(x)) and _digits.search(m[4]):
                rows.append((int(m[1] or m[2] or m[3]), _digits.sub("0", x)))
    if len(rows) < TABLE_ROWS:
        return 0.0
    up = sum(b[0] == a[0] + 1 for a, b in zip(rows, rows[1:])) + 1
    forms = sorted(Counter(f for _, f in rows).values(), reverse=True)
    return min(up, sum(forms[:TABLE_FORMS])) / filled


def is_minified(lines: list[str]) -> bool:
    total = sum(map(len, lines))
    long_ = [x for x in lines if len(x) > LONG_LINE]
    size = sum(map(len, long_))
    if size and size >= LONG_SHARE * total and sum(x.count(" ") + x.count("\t") for x in long_) <= LONG_SPACE * size:
        return True
    # wrapped at some width: hardly any white space, yet long lines
    space = sum(x.count(" ") + x.count("\t") for x in lines) + len(lines)
    return total >= WRAPPED_LINE * len(lines) and space <= WRAPPED_SPACE * total


def text_kind(text: str) -> str | None:
    """The kind that a text alone shows, None for hand-written text."""
    if not text or text.isspace():
        return None
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    said = notices.origin(lines)
    if said == "generated" or _annotated.search(text) or has_idioms(text, len(lines)):
        return "generated"
    if literal_share(lines) >= DATA_SHARE:
        return "data"
    if is_minified(lines):
        return "minified"
    return "generated" if table_share(lines) >= TABLE_SHARE else said


def path_kind(path: str | Column) -> Column:
    """The kind that a path alone shows, null for none."""
    p = F.col(path) if isinstance(path, str) else path
    rules = (("vendored", VENDORED_PATH), ("generated", GENERATED_PATH), ("generated", GENERATED_NAME), ("minified", MINIFIED_NAME), ("data", LOCK_NAME), ("data", DATA_PATH))
    out = F
    for kind, rule in rules:
        out = out.when(p.rlike(rule), kind)
    return out


def shingles(text: str) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of SHINGLE words; a shorter text has none."""
    words = _word.findall(text)
    if len(words) < SHINGLE:
        return np.zeros(0, np.int64)
    codes = _KEPT.setdefault("codes", {})
    if len(codes) > 200_000:
        codes.clear()
    ids = np.array([codes[w] if w in codes else codes.setdefault(w, zlib.crc32(w.encode("utf-8", "replace")) | len(w) << 32) for w in words], np.uint64)
    out = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        x = ids[k : len(ids) - SHINGLE + 1 + k]
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def published(libs: DataFrame) -> DataFrame:
    """(shingle, lib_id) of published files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(text or "")
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array([key] * len(s), pa.int64())], names=["shingle", "lib_id"])

    return libs.select(F.col("lib_id").cast("bigint").alias("lib_id"), "text").mapInArrow(run, "shingle bigint, lib_id bigint")


def _copied_by_broadcast(docs: DataFrame, index: DataFrame) -> DataFrame:
    pairs = index.toArrow()
    order = np.lexsort((pairs["lib_id"].to_numpy(), pairs["shingle"].to_numpy()))
    keys, owner = pairs["shingle"].to_numpy()[order], pairs["lib_id"].to_numpy()[order]
    sent = docs.sparkSession.sparkContext.broadcast((keys, owner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owner = sent.value
        for b in batches:
            found, share, kind = [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text or "")
                lo, hi = np.searchsorted(keys, s, "left"), np.searchsorted(keys, s, "right")
                n = hi - lo
                best = 0
                if len(s) and n.any():
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    best = np.unique(owner[at], return_counts=True)[1].max()
                share.append(best / len(s) if len(s) else 0.0)
                kind.append(text_kind(text or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(share, pa.float64()), pa.array(kind, pa.string())], names=["doc_id", "copied", "text_kind"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, copied double, text_kind string")


def _copied_by_join(docs: DataFrame, index: DataFrame) -> DataFrame:
    """The same for any number of published files: documents' shingles joined to theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shingles(t or "") for t in b.column(1).to_pylist()]
            kinds = [text_kind(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.list_(pa.int64())), pa.array(kinds, pa.string())], names=["doc_id", "shingles", "text_kind"])

    cut = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, shingles array<bigint>, text_kind string")
    cut = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "shingles")
    hits = cut.select("row", F.explode("shingles").alias("shingle")).join(index, "shingle").groupBy("row", "lib_id").count()
    best = hits.groupBy("row").agg(F.max("count").alias("hits"))
    return cut.join(best, "row", "left").select("doc_id", (F.coalesce("hits", F.lit(0)) / F.greatest(F.size("shingles"), F.lit(1))).alias("copied"), "text_kind")


def classify(files: DataFrame, libs: DataFrame) -> DataFrame:
    """(doc_id, kind) of every file of (doc_id, path, text); kind is null for hand-written ones.

    A null or empty text is judged by its path alone, a null path by its text alone; a file with
    neither is hand-written. Every input row gives one row, repeated and null ids included. An empty table gives no row, and without
    published files nothing is a copy of one. Other columns are ignored. Texts are read whole.
    """
    index = materialize(published(libs), "published")
    small = plan_bytes(index) <= BROADCAST_BYTES
    by_path = files.select("doc_id", path_kind("path").alias("path_kind"), "text")
    # what the path tells needs no look at the text
    rest = by_path.filter(F.col("path_kind").isNull())
    judged = (_copied_by_broadcast if small else _copied_by_join)(rest, index)
    kind = F.when(F.col("text_kind").isNotNull(), F.col("text_kind")).when(F.col("copied") >= COPIED, "vendored")
    return by_path.filter(F.col("path_kind").isNotNull()).select("doc_id", F.col("path_kind").alias("kind")).unionByName(judged.select("doc_id", kind.alias("kind")))


def source_files(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("source") == "src_file")


def functions_by_hand(func: DataFrame, docs: DataFrame, libs: DataFrame) -> DataFrame:
    """Functions of fact_func without those of files that nobody wrote by hand.

    A function's file is the document of the same repository and path; functions of files without
    a document are judged by their path.
    """
    files = source_files(docs)
    bad = classify(files, libs).filter(F.col("kind").isNotNull()).select("doc_id").distinct()
    paths = files.join(bad, "doc_id", "left_semi").select("repo_id", "path").distinct()
    return func.filter(path_kind("path").isNull()).join(paths, ["repo_id", "path"], "left_anti")
