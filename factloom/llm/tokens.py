"""Encoding of a whole corpus with a public byte-level tokenizer.

Global distinct-word shuffle: texts are split into pre-tokens, whose positions are kept as indexes
into the words of a block of documents; only the distinct words of each block are exploded and
shuffled, each distinct word of the corpus is encoded once, its ids are joined back to the blocks,
and the texts' ids are reassembled by position. Decoding joins the token-byte table.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.runtime import materialize, spread

#: Where the vocabulary files lie on every node; each function takes another path.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of text after which a block is closed; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000

#: The pattern that splits text before the merges. White space is spelt out, since
#: the classes of regex libraries differ in four control characters.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

_kept: dict[str, object] = {}


#: The same for ASCII text, where the standard library's engine, which is faster, knows all classes.
_ascii = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?(?:[A-Za-z]+|[0-9]+|[^\t-\r A-Za-z0-9]+)|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
#: Where a text may be cut: a line feed behind anything but white space. No word goes across it, as
#: only a blank joins what follows, and what is white space to the pattern is so to this engine.
_cut = re.compile(r"(?<=\S)(?=\n)").split


def splitter():
    """The pre-tokens of a text, as the pattern finds them; the compiled pattern is kept per worker."""
    if "split" not in _kept:
        import regex

        _kept["split"] = regex.compile(PATTERN).findall
    split = _kept["split"]

    def words(text: str) -> list[str]:
        if text.isascii():
            return _ascii(text)
        out: list[str] = []
        for plain, lines in groupby(_cut(text), str.isascii):
            out += (_ascii if plain else split)("".join(lines))
        return out

    return words


class _Numbers(dict):
    """Numbers of words in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(path: str):
    """``encode(word) -> ids`` of one pre-token, kept per worker."""
    if path not in _kept:
        import tiktoken

        _kept[path] = tiktoken.Encoding(path, pat_str=r"(?s).+", mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary
    return _kept[path]


def pack_index(at: np.ndarray, n_words: int) -> bytes:
    """Indexes into a block's words as bytes, two per index where that holds them, else four: to the
    JVM and the shuffle they are one value and not millions."""
    return b"2" + at.astype("<u2").tobytes() if n_words <= 1 << 16 else b"4" + at.astype("<u4").tobytes()


def unpack_index(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[:1] == b"2" else "<u4", offset=1).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) rows into blocks: ids, numbers of pre-tokens, word indexes, distinct words."""
    split, task, seq = splitter(), TaskContext.get().partitionId(), 0
    words = _Numbers()
    ids, sizes, index, chars = [], [], [], 0

    def close(id_type: pa.DataType) -> pa.RecordBatch:
        nonlocal seq, chars
        row = [
            pa.array([task << 32 | seq], pa.int64()),
            pa.array([ids], pa.list_(id_type)),
            pa.array([sizes], pa.list_(pa.int32())),
            pa.array([pack_index(np.concatenate(index) if index else np.zeros(0, np.int32), len(words))], pa.binary()),
            pa.array([list(words)], pa.list_(pa.string())),
        ]
        for x in (words, ids, sizes, index):
            x.clear()
        seq, chars = seq + 1, 0
        return pa.RecordBatch.from_arrays(row, names=["block", "ids", "sizes", "at", "words"])

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pieces = split(text) if text else []
            ids.append(key)
            sizes.append(len(pieces))
            index.append(np.fromiter(map(words.__getitem__, pieces), np.int32, len(pieces)))
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                yield close(kind)
    if ids:
        yield close(kind)


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of split texts, written once so that every later step sees the same blocks."""
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("at", T.BinaryType()),
            T.StructField("words", T.ArrayType(T.StringType())),
        ]
    )
    return materialize(spread(docs.select(id_col, text_col)).mapInArrow(_blocks, schema), "token-blocks")


def dictionary(split: DataFrame, path: str = RANKS) -> DataFrame:
    """(word, ids) of every distinct word of the corpus, each encoded once; ids are 32-bit numbers in
    bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([array("i", encode(w)).tobytes() for w in batch.column(0).to_pylist()], pa.binary())], names=["word", "ids"])

    return split.select(F.explode("words").alias("word")).distinct().mapInArrow(run, "word string, ids binary")


def _joined(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """Each block with the token ids of its words, as one flat list and the lists' sizes.

    A block's group is bounded by its distinct words; a word comes at most once per block, so no
    word is a hot key.
    """
    split = blocks(docs, id_col, text_col)
    words = split.select("block", F.posexplode("words").alias("k", "word"))
    coded = words.join(dictionary(split, path), "word").select("block", F.struct("k", "ids").alias("w"))
    tables = coded.groupBy("block").agg(F.sort_array(F.collect_list("w")).alias("w")).select("block", F.transform("w", lambda w: w["ids"]).alias("table"))
    return split.select("block", "ids", "sizes", "at").join(tables, "block", "left")


def _flat(table: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words' ids and all ids of a table of packed ids."""
    offsets = np.frombuffer(table.buffers()[1], np.int32)[table.offset : table.offset + len(table) + 1].astype(np.int64)
    ids = np.frombuffer(table.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return (offsets - offsets[0]) // 4, ids.view(np.int32)


def _reassembled(docs: DataFrame, id_col: str, text_col: str, path: str, count_only: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()) if count_only else T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, sizes, table = (batch.column(i).slice(r, 1).flatten() for i in (0, 1, 3))
                at, sizes = unpack_index(batch.column(2)[r].as_py()), sizes.to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                if len(at):
                    starts, flat = _flat(table)
                    length = np.diff(starts)[at]
                    total = np.concatenate([[0], np.cumsum(length)])
                else:
                    total = np.zeros(1, np.int64)
                bounds = np.concatenate([[0], total[ends]])
                if count_only:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds).astype(np.int64))], names=[id_col, "n_tokens"])
                    continue
                if len(at):
                    # position of each token in the word table: start of its word plus its rank there
                    out = flat[np.repeat(starts[:-1][at] - total[:-1], length) + np.arange(total[-1])]
                else:
                    out = np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out.astype(np.int32)))], names=[id_col, "ids"])

    joined = _joined(docs, id_col, text_col, path)
    return joined.select("ids", "sizes", "at", "table").mapInArrow(run, schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens.

    Strings that look like special tokens are ordinary text. A null or empty text has an empty
    list. Every input row gives one output row, repeated and null ids included; other columns are
    ignored; an empty table gives no row. Texts are encoded whole, however long.
    """
    return _reassembled(docs, id_col, text_col, path, count_only=False)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """(id, n_tokens) of every row: the sizes of what :func:`encode` gives, by the same way."""
    return _reassembled(docs, id_col, text_col, path, count_only=True)


def token_bytes(path: str = RANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: start and length of every token's bytes by its number, -1 where there is
    none, and the bytes. Bounded by the vocabulary's file."""
    ranks = read_ranks(path)
    start = np.zeros(max(ranks.values()) + 1, np.int64)
    length = np.full(len(start), -1, np.int64)
    at = 0
    for word, token in ranks.items():
        start[token], length[token] = at, len(word)
        at += len(word)
    return start, length, np.frombuffer(b"".join(ranks), np.uint8)


def decode(coded: DataFrame, id_col: str = "doc_id", path: str = RANKS) -> DataFrame:
    """(id, text) of every (id, ids) row: each position joined to the token-byte table, which every
    task holds, and the bytes put together in order. Nothing is shuffled. An empty or null list gives
    an empty text; an unknown or null token raises an error. Bytes that are no UTF-8 become U+FFFD."""
    schema = T.StructType([coded.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tables:
            _tables[path] = token_bytes(path)
        start, length, data = _tables[path]
        for batch in batches:
            texts = []
            for r in range(batch.num_rows):
                ids = batch.column(1).slice(r, 1).flatten()
                if ids.null_count:
                    raise ValueError("unknown token null")
                n = ids.to_numpy(zero_copy_only=False).astype(np.int64)
                known = (n >= 0) & (n < len(length))
                known[known] = length[n[known]] >= 0
                if not known.all():
                    raise ValueError(f"unknown token {n[~known][0]}")
                size = length[n]
                end = np.cumsum(size)
                # place of each byte in the table: start of its token plus its rank there
                at = np.repeat(start[n] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
                texts.append(data[at].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return coded.select(id_col, "ids").mapInArrow(run, schema)


_tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
