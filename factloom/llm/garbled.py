"""Text that was decoded with the wrong character encoding.

A multinomial classifier over hashed byte bigrams tells which chain of encodings a line went
through. It is trained by the tasks on a bounded sample of the corpus's own lines, garbled
synthetically by every chain. A line that is predicted to be garbled counts only if the chain can be inverted strictly,
piece by piece, and the result reads as sound text.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.keys import hash64
from factloom.runtime import materialize, spread

#: Documents with non-ASCII text that the classifier is trained on, at most.
SAMPLE_DOCS = 4000
#: Distinct lines of these that are used, at most.
SAMPLE_LINES = 20_000
#: Characters of a line that is trained on, at most.
LINE_CHARS = 2_000
#: Hash buckets of byte bigrams, and the weight of a bigram never seen.
BUCKETS, UNSEEN = 1 << 15, 0.05
#: What a chain must gain over sound text (log likelihood); for the lines to train on, it is more.
MARGIN, CLEAN_MARGIN = 3.0, 8.0
#: What a chain from UTF-8 must gain for a line that it explains but that can't be inverted.
CERTAIN = 25.0
#: Share of such a line's bytes that must be whole characters still.
PARTLY = 0.3
#: For chains between one-byte encodings: gain in mean log likelihood, and other than ASCII characters.
BETTER, WEIGHTY = 1.5, 3
LOST = "�"

#: Chains of (encoding of the bytes, encoding they were read in), outermost last.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf-8 as cp1252": (("utf-8", "cp1252"),),
    "utf-8 as latin-1": (("utf-8", "latin-1"),),
    "utf-8 as cp1250": (("utf-8", "cp1250"),),
    "utf-8 as cp1251": (("utf-8", "cp1251"),),
    "utf-8 as cp437": (("utf-8", "cp437"),),
    "utf-8 as cp850": (("utf-8", "cp850"),),
    "utf-8 as cp866": (("utf-8", "cp866"),),
    "utf-8 as mac-roman": (("utf-8", "mac-roman"),),
    "utf-8 as iso8859-2": (("utf-8", "iso8859-2"),),
    "utf-8 as iso8859-15": (("utf-8", "iso8859-15"),),
    "utf-8 as koi8-r": (("utf-8", "koi8-r"),),
    "utf-8 as cp1252 twice": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf-8 as latin-1 twice": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "cp1251 as cp1252": (("cp1251", "cp1252"),),
    "koi8-r as cp1252": (("koi8-r", "cp1252"),),
    "koi8-r as cp1251": (("koi8-r", "cp1251"),),
    "cp1251 as koi8-r": (("cp1251", "koi8-r"),),
    "cp866 as cp1251": (("cp866", "cp1251"),),
    "cp866 as cp1252": (("cp866", "cp1252"),),
    "iso8859-2 as cp1252": (("iso8859-2", "cp1252"),),
    "cp1250 as cp1252": (("cp1250", "cp1252"),),
    "shift-jis as cp1252": (("cp932", "cp1252"),),
    "euc-jp as cp1252": (("euc_jp", "cp1252"),),
    "cp850 as cp1252": (("cp850", "cp1252"),),
    "mac-roman as cp1252": (("mac-roman", "cp1252"),),
    "cp1252 as cp850": (("cp1252", "cp850"),),
    "cp1252 as mac-roman": (("cp1252", "mac-roman"),),
}
SOUND = "sound"
QUOTED = ""
_high = re.compile(r"[^\x00-\x7f]+")


def _table(encoding: str) -> str | None:
    """The 256 characters of a one-byte encoding; bytes without a character stand as the control
    characters of the same number, as lenient decoders leave them. None for other encodings."""
    if encoding in ("utf-8", "cp932", "euc_jp"):
        return None
    return "".join(bytes([i]).decode(encoding, "ignore") or chr(i) for i in range(256))


_DECODE = {e: _table(e) for steps in CHAINS.values() for step in steps for e in step}
_ENCODE = {e: {ord(c): i for i, c in reversed(list(enumerate(t)))} for e, t in _DECODE.items() if t}


def to_bytes(text: str, encoding: str) -> bytes:
    if encoding in _ENCODE:
        return codecs.charmap_encode(text, "strict", _ENCODE[encoding])[0]
    return text.encode(encoding)


def from_bytes(data: bytes, encoding: str) -> str:
    return codecs.charmap_decode(data, "strict", _DECODE[encoding])[0] if _DECODE[encoding] else data.decode(encoding)


def garble(text: str, chain: str) -> str | None:
    """The text as the chain leaves it, or None where it can't be written so or isn't changed."""
    out = text
    try:
        for wrote, read in CHAINS[chain]:
            out = from_bytes(out.encode(wrote), read)
    except UnicodeError:
        return None
    return None if out == text else out


def invert(text: str, chain: str) -> str | None:
    """The text before the chain if every step can be undone strictly, else None."""
    try:
        for wrote, read in reversed(CHAINS[chain]):
            text = to_bytes(text, read).decode(wrote)
    except UnicodeError:
        return None
    return text


def bigrams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte bigrams that hold a non-ASCII byte, and the line of each."""
    data = [x.encode("utf-8", "replace") + b"\n" for x in lines]
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(data)), [len(x) for x in data])
    a, b = flat[:-1], flat[1:]
    at = np.flatnonzero(((a | b) >= 128) & (owner[:-1] == owner[1:]))
    pair = (a[at] << 8 | b[at]) * np.uint32(2654435761)
    return (pair >> np.uint32(33 - BUCKETS.bit_length())).astype(np.int64), owner[at]


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray  # log probabilities, classes by buckets

    def scores(self, lines: list[str]) -> np.ndarray:
        """Log likelihoods, lines by classes."""
        bucket, owner = bigrams(lines)
        out = np.zeros((len(lines), len(self.names)), np.float64)
        for c in range(len(self.names)):
            out[:, c] = np.bincount(owner, self.weights[c][bucket], len(lines))
        return out

    def soundness(self, lines: list[str]) -> np.ndarray:
        """Mean log likelihood of a line's bigrams under sound text, that of ASCII lines being 0."""
        bucket, owner = bigrams(lines)
        n = np.bincount(owner, minlength=len(lines))
        return np.bincount(owner, self.weights[0][bucket], len(lines)) / np.maximum(n, 1)


def counts(lines: list[str]) -> np.ndarray:
    """Bigrams per class and bucket: of the lines as they are and as every chain leaves them."""
    out = np.zeros((1 + len(CHAINS), BUCKETS), np.int64)
    for c, name in enumerate([SOUND, *CHAINS]):
        own = lines if c == 0 else [g for x in lines if (g := garble(x, name))]
        if own:
            out[c] = np.bincount(bigrams(own)[0], minlength=BUCKETS)
    return out


def weigh(n: np.ndarray) -> Model:
    weights = np.log(n + UNSEEN) - np.log(n.sum(1, keepdims=True) + UNSEEN * BUCKETS)
    return Model([SOUND, *CHAINS], weights.astype(np.float32))


def fit(lines: list[str]) -> Model:
    """A classifier of sound lines and of the same lines garbled by every chain."""
    return weigh(counts(lines))


def fit_table(lines: DataFrame) -> Model:
    """The same for a table of lines: the tasks garble and count, only sums per bucket come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + len(CHAINS), BUCKETS), np.int64)
        for b in batches:
            total += counts(b.column(0).to_pylist())
        c, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[c, k])], names=["c", "k", "n"])

    # at most classes times buckets rows
    sums = spread(lines.select("line")).mapInArrow(run, "c int, k int, n bigint").groupBy("c", "k").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((1 + len(CHAINS), BUCKETS), np.int64)
    total[sums["c"].to_numpy(), sums["k"].to_numpy()] = sums["n"].to_numpy()
    return weigh(total)


#: Chains whose strict inversion alone tells a line from sound text.
_WEST = ("utf-8 as cp1252", "utf-8 as cp1250", "utf-8 as cp437", "utf-8 as cp850")


def _may_be_sound(line: str) -> bool:
    return LOST not in line and not re.search(r"[\x80-\x9f]", line) and not any(invert(m[0], c) for m in _high.finditer(line) for c in _WEST)


def clean(lines: DataFrame) -> DataFrame:
    """The lines that neither a strict inversion nor a first model holds for garbled."""

    def keep(test):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(test(b.column(0).to_pylist()), pa.bool_()))

        return run

    first = materialize(spread(lines.select("line")).mapInArrow(keep(lambda xs: [_may_be_sound(x) for x in xs]), "line string"), "lines")
    sent = lines.sparkSession.sparkContext.broadcast(fit_table(first))
    return first.mapInArrow(keep(lambda xs: [not v.chain for v in judge(xs, sent.value, CLEAN_MARGIN)] if xs else []), "line string")


def sample(docs: DataFrame, max_docs: int = SAMPLE_DOCS, max_lines: int = SAMPLE_LINES) -> DataFrame:
    """(line): distinct lines with non-ASCII text of a bounded sample, the same for the same documents.

    Documents are drawn by a hash of their id, about three times as many as are kept, so that no
    task sees more than that however large the corpus is. Lines longer than LINE_CHARS are not
    trained on (they are judged like any other).
    """
    n, span = docs.count(), 1 << 31
    h = F.pmod(hash64("doc_id"), F.lit(span))
    drawn = docs.filter(h < span * 3 * max_docs // n) if n > 3 * max_docs else docs
    picked = drawn.filter(F.col("text").rlike(r"[^\x00-\x7F]")).select(h.alias("h"), "text").orderBy("h", "text").limit(max_docs)
    lines = picked.select(F.explode(F.split("text", r"[\r\n]+")).alias("line")).filter(F.col("line").rlike(r"[^\x00-\x7F]") & (F.length("line") <= LINE_CHARS)).distinct()
    return lines.orderBy(F.xxhash64("line"), "line").limit(max_lines)


def train(docs: DataFrame, max_docs: int = SAMPLE_DOCS, max_lines: int = SAMPLE_LINES) -> Model:
    return fit_table(clean(materialize(sample(docs, max_docs, max_lines), "sampled-lines")))


def _quoted(line: str, start: int, end: int, restored: str) -> bool:
    """A lone character that stands apart where it would touch a letter: it is shown, not meant."""
    before, after = line[start - 1 : start] if start else "", line[end : end + 1]
    return not (before.isalnum() or after.isalnum()) and len(restored) == 1 and (restored.isalpha() and restored < "\u0250" or restored in "’‘´`")


@dataclass
class Verdict:
    chain: str | None = None
    text: str | None = None


def judge(lines: list[str], model: Model, margin: float = MARGIN) -> list[Verdict]:
    """The chain of each line and its restored text; a null chain for sound lines."""
    out = [Verdict("lost") if LOST in x else Verdict() for x in lines]
    scores = model.scores(lines)
    tried: list[tuple[int, str, str]] = []
    broken: dict[int, str] = {}
    for i, x in enumerate(lines):
        if not out[i].chain:
            for c in _ranked(x, scores[i], model, margin):
                if (got := _restore(x, model.names[c])) is not None:
                    if got != QUOTED:
                        tried.append((i, model.names[c], got))
                    if model.names[c].startswith("utf-8"):
                        break
                elif model.names[c].startswith("utf-8") and scores[i, c] >= scores[i, 0] + CERTAIN and _partly(x, model.names[c]):
                    broken.setdefault(i, model.names[c])
    if tried:
        was, now = model.soundness([lines[i] for i, _, _ in tried]), model.soundness([t for _, _, t in tried])
        for (i, chain, got), w, n in zip(tried, was, now):
            # one-byte encodings always invert, so the result must also read far better
            if not out[i].chain and (chain.startswith("utf-8") or n > w + BETTER and len(_high.sub("", lines[i])) + WEIGHTY <= len(lines[i])):
                out[i] = Verdict(chain, got)
    _by_piece(lines, out, model, margin)
    for i, chain in broken.items():  # bytes were lost on the way
        if not out[i].chain:
            out[i] = Verdict(chain, None)
    return out


def _ranked(line: str, scores: np.ndarray, model: Model, margin: float) -> list[int]:
    """The chains that gain enough over sound text, best first. One from UTF-8 that inverts a longer
    line in full goes before chains that invert anything."""
    able = [c for c in np.argsort(-scores) if scores[c] >= scores[0] + margin and c]
    if able and not model.names[able[0]].startswith("utf-8") and len(line) - len(_high.sub("", line)) >= 2 * WEIGHTY:
        for c in able:
            if model.names[c].startswith("utf-8") and all(got is not None for *_, got in _runs(line, model.names[c])):
                return [c, *able]
    return able


def _cut_short(tail: str, read: str) -> bool:
    """Whether the bytes behind ``tail``, the end of a run, stop inside a UTF-8 character."""
    try:
        data = to_bytes(tail[-3:], read)
    except UnicodeError:
        return False
    for back, b in enumerate(reversed(data), 1):
        if b >= 0xC0:
            return back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4)
        if b < 0x80:
            return False
    return False


def _runs(line: str, chain: str) -> Iterator[tuple[int, int, str | None]]:
    """Start, end and inverted text of each run of other than ASCII characters. A run that stops
    inside a character lacks a no-break space which became a blank: it goes on behind that, as often
    as it takes."""
    at, read = 0, CHAINS[chain][-1][1]
    while m := _high.search(line, at):
        start, end = m.span()
        parts = [m[0]]
        while line[end : end + 1] == " " and _cut_short(parts[-1], read):
            more = _high.match(line, end + 1)
            parts.append("\xa0" + (more[0] if more else ""))
            end = more.end() if more else end + 1
        got = invert("".join(parts), chain)
        if got is None and len(parts) > 1:  # what can be inverted without it
            got, end = invert(m[0], chain), m.end()
        yield start, end, got
        at = end


def _restore(line: str, chain: str) -> str | None:
    """The line with its other than ASCII runs inverted; None if none can be, QUOTED if all are quotes.

    A run that doesn't invert stays as it is, so a line that lost some bytes is restored in part.
    """
    if not chain.startswith("utf-8"):
        return invert(line, chain)
    real, parts, last = False, [], 0
    for start, end, got in _runs(line, chain):
        if got is not None:
            real |= not _quoted(line, start, end, got)
            parts += line[last:start], got
            last = end
    return "".join([*parts, line[last:]]) if real else QUOTED if parts else None


def _partly(line: str, chain: str) -> bool:
    """Whether a chain that can't be inverted still leaves some letters behind: bytes were dropped."""
    wrote, read = CHAINS[chain][-1]
    try:
        data = to_bytes("".join(_high.findall(line)), read)
    except UnicodeError:
        return False
    got = data.decode(wrote, "ignore")
    return sum(c.isalpha() and c > "\x7f" for c in got) >= 2 and len(got.encode(wrote)) >= PARTLY * len(data)


def _by_piece(lines: list[str], out: list[Verdict], model: Model, margin: float) -> None:
    """Lines that are garbled in places: single runs, with one character on either side, that a
    chain from UTF-8 explains better than sound text and that invert strictly."""
    found: dict[str, list[tuple[int, int, int]]] = {}
    for i, x in enumerate(lines):
        if not out[i].chain:
            for m in _high.finditer(x):
                if len(m[0]) > 1:
                    found.setdefault(x[max(0, m.start() - 1) : m.end() + 1], []).append((i, *m.span()))
    if not found:
        return
    pieces: dict[int, list[tuple[int, int, str, str]]] = {}
    for places, s in zip(found.values(), model.scores(list(found))):
        i, a, b = places[0]
        run = lines[i][a:b]
        for c in np.argsort(-s):
            if c == 0 or s[c] < s[0] + margin:
                break
            if model.names[c].startswith("utf-8") and (got := invert(run, model.names[c])):
                for i, a, b in places:
                    if not _quoted(lines[i], a, b, got):
                        pieces.setdefault(i, []).append((a, b, got, model.names[c]))
                break
    for i, hits in pieces.items():
        text = lines[i]
        for a, b, got, _ in sorted(hits, reverse=True):
            text = text[:a] + got + text[b:]
        out[i] = Verdict(hits[0][3], text)


def _by_document(texts: list[list[str]], verdicts: dict[str, Verdict], model: Model, margin: float) -> dict[tuple[int, str], Verdict]:
    """Verdicts on lines too short to show a chain between one-byte encodings by themselves, from the
    evidence of all such lines of their document together: by (document, line).

    The chain is one that longer lines of the document went through, or the best of those that the
    short lines as a whole show by the rules for a single line.
    """
    found: list[tuple[int, list[str], str, list[str]]] = []
    for r, lines in enumerate(texts):
        short = [x for x in dict.fromkeys(lines) if not x.isascii() and x not in verdicts and len(x) - len(_high.sub("", x)) < WEIGHTY]
        if short:
            known = list(dict.fromkeys(v.chain for x in lines if (v := verdicts.get(x)) and v.text is not None and not v.chain.startswith("utf-8")))
            found.append((r, short, " ".join(short), known))
    if not found:
        return {}
    scores = model.scores([f[2] for f in found])
    tried: list[tuple[int, str, str, float]] = []
    for k, (_, _, whole, known) in enumerate(found):
        better = [model.names[c] for c in np.argsort(-scores[k]) if scores[k, c] >= scores[k, 0] + margin and c and not model.names[c].startswith("utf-8")]
        enough = sum(c > "\x7f" and not c.isspace() for c in whole) >= WEIGHTY
        for chain, gain in ([(c, 0.0) for c in known if c in better] + [(c, BETTER) for c in better]) * enough:
            if (got := invert(whole, chain)) is not None and got != whole:
                tried.append((k, chain, got, gain))
    out: dict[tuple[int, str], Verdict] = {}
    if tried:
        was, now = model.soundness([found[k][2] for k, *_ in tried]), model.soundness([t[2] for t in tried])
        done = set()
        for (k, chain, _, gain), w, n in zip(tried, was, now):
            if k not in done and n > w + gain:
                done.add(k)
                for x in found[k][1]:
                    if (got := invert(x, chain)) is not None and got != x:
                        out[found[k][0], x] = Verdict(chain, got)
    return out


def restore(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """(doc_id, chains, n_lines, text) of the affected documents.

    chains: sorted distinct chains of its lines, ``lost`` for those with replacement characters.
    text: the restored text, null if nothing could be restored; lost characters stay as they are.
    Null, empty and ASCII texts are sound. Every affected input row gives one row, repeated ones
    included; an empty table gives no row. Other columns are ignored. Texts are read whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            split = {r: t.split("\n") for r, t in enumerate(texts) if t and not t.isascii()}
            lines = list(dict.fromkeys(x for ls in split.values() for x in ls if not x.isascii()))
            verdicts = {x: v for x, v in zip(lines, judge(lines, model, margin)) if v.chain} if lines else {}
            order = list(split)
            short = _by_document([split[r] for r in order], verdicts, model, margin) if split else {}
            rows: list[tuple] = []
            for k, r in enumerate(order):
                judged = [verdicts.get(x) or short.get((k, x)) for x in split[r]]
                hit = [v for v in judged if v]
                if hit:
                    fixed = any(v.text is not None for v in hit)
                    text = "\n".join(v.text if v and v.text is not None else x for x, v in zip(split[r], judged)) if fixed else None
                    rows.append((r, sorted({v.chain for v in hit}), len(hit), text))
            at, chains, n, fixed = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(chains, pa.list_(pa.string())), pa.array(n, pa.int32()), pa.array(fixed, pa.string())], names=["doc_id", "chains", "n_lines", "text"])

    return spread(docs.select("doc_id", "text").filter(F.col("text").rlike(r"[^\x00-\x7F]"))).mapInArrow(run, "doc_id bigint, chains array<string>, n_lines int, text string")
