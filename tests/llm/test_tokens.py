import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import tokens

public = pytest.importorskip("public_tokenizers")
REFERENCE = tiktoken.Encoding("ref", pat_str=public.PATTERN, mergeable_ranks=tokens.read_ranks(tokens.RANKS), special_tokens={})
SCHEMA = "doc_id bigint, text string, ids string, block int, words int"
TEXTS = [None, "", " ", "\n\n  x", "don't stop 'll it's", "<|endoftext|> plain", "naïve ﬁ 한국어 👩‍💻 𝒻 \x1c\x85 y", "a" * 30_000, " \t\r\n" * 5000, "١٢٣ 12345 x1y2", "﻿über" * 3, "\x00\x01"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("chars", [2_000_000, 100])
def test_ids_equal_the_tokenizer(spark, monkeypatch, chars):
    monkeypatch.setattr(tokens, "BLOCK_CHARS", chars)
    rnd = random.Random(5)
    texts = TEXTS + ["".join(rnd.choice("ab 'é\n1.,한\t<|") for _ in range(rnd.randint(0, 200))) for _ in range(200)]
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode(frame(spark, texts).repartition(3)).collect()}
    assert got == {i: REFERENCE.encode_ordinary(t or "") for i, t in enumerate(texts)}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words_are_the_tokenizers(text):
    encode = tokens.encoder(tokens.RANKS)
    words = tokens.splitter()(text)
    assert "".join(words) == text and [i for w in words for i in encode(w)] == REFERENCE.encode_ordinary(text)


@settings(max_examples=500, deadline=None)
@given(st.text("ab1 '\n\r\t\x0b\x1c\x1f\x85\xa0\u2028\u3000é한½٣s_-", max_size=40))
def test_cuts_at_lines_change_nothing(text):
    import regex

    assert tokens.splitter()(text) == regex.compile(tokens.PATTERN).findall(text)


def test_counts_and_round_trip(spark):
    df = frame(spark, TEXTS)
    coded = tokens.encode(df)
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()} == {r["doc_id"]: len(r["ids"]) for r in coded.collect()}
    assert {r["doc_id"]: r["text"] for r in tokens.decode(coded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in tokens.encode(df).collect()) == [(0, 1), (1, 2), (1, 2), (2, 0)]
    assert tokens.encode(df.limit(0)).count() == 0 == tokens.count_tokens(df.limit(0)).count()
    assert tokens.encode(df.filter("doc_id = 2")).first()["ids"] == []


def test_unknown_token(spark):
    with pytest.raises(Exception, match="unknown token"):
        tokens.decode(spark.createDataFrame([(1, [50_256])], "doc_id bigint, ids array<int>")).collect()


def test_decoding_keeps_repeated_rows_and_needs_no_shuffle(spark):
    ids = REFERENCE.encode_ordinary("größer 한국어")
    df = spark.createDataFrame([(1, ids), (1, ids), (None, []), (2, None), (3, ids[:1])], "doc_id bigint, ids array<int>")
    out = tokens.decode(df)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, ""), (1, "größer 한국어"), (1, "größer 한국어"), (2, ""), (3, REFERENCE.decode(ids[:1]))]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for bad in ([-1], [10**8], [None]):
        with pytest.raises(Exception, match="unknown token"):
            tokens.decode(spark.createDataFrame([(1, bad)], "doc_id bigint, ids array<int>")).collect()


def test_other_vocabulary(spark):
    path = public.path("byte_bpe_multi_50k.tiktoken")
    ref = tiktoken.Encoding("m", pat_str=public.PATTERN, mergeable_ranks=tokens.read_ranks(path), special_tokens={})
    assert list(tokens.encode(frame(spark, ["größere Straße 한국어"]), path=path).first()["ids"]) == ref.encode_ordinary("größere Straße 한국어")
