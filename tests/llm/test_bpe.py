import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe, tokens


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(tokens.VOCABULARY)
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_public_tokenizer_on_odd_texts(both):
    mine, public = both
    rng = random.Random(0)
    pool = "ab cd'sll  \n\t\r\x1c\x85 　é😀中文字กา½²١٢_-–—…<|endoftext|>ﬁſ​‍﻿́"
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert mine.encode(text) == public.encode_ordinary(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_public_tokenizer(text):
    mine = bpe.encoder(tokens.VOCABULARY)
    public = test_ids_equal_the_public_tokenizer.__dict__.setdefault("p", tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=mine.machine.ranks, special_tokens={}))
    assert mine.encode(text) == public.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=24))
def test_transducer_gives_the_encoding_by_definition(data):
    machine = bpe.encoder(tokens.VOCABULARY).machine
    assert [machine.bytes_of[i] for i in machine.encode(data)] == machine.merge(data)


def test_dropping_states_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 3)
    machine = bpe.Transducer(both[0].machine.ranks)
    for word in (b" indemnification", b"aaaaaaaaaaaaaaaaaaaaaaaa", b"\xff\xfe\x00", b"        "):
        assert [machine.bytes_of[i] for i in machine.encode(word)] == machine.merge(word)


def test_reachable_states_and_pairs_are_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 500)
    monkeypatch.setattr(bpe, "MAX_FITS", 700)
    machine, rng = bpe.Transducer(both[0].machine.ranks), random.Random(3)
    for _ in range(3000):
        word = bytes(rng.choice(b"abcdefghijklmnop \xc3\xa9") for _ in range(rng.randint(1, 12)))
        assert [machine.bytes_of[i] for i in machine.encode(word)] == machine.merge(word)
        assert len(machine.fits) <= 700
    seen, todo = set(), [machine.start]
    while todo:
        state = todo.pop()
        if id(state) not in seen:
            seen.add(id(state))
            todo += [target for target, _ in state.arrows.values()]
    assert len(seen) <= 501


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 5))
def test_decoder_is_the_standard_one_in_any_pieces(data, step):
    decoder = bpe.Decoder({i: bytes([i]) for i in range(256)})
    out = "".join(decoder.feed(data[i : i + step]) for i in range(0, len(data), step)) + decoder.close()
    assert out == data.decode("utf-8", "replace")


def test_round_trip(both):
    mine = both[0]
    decoder = bpe.Decoder(mine.machine.bytes_of)
    for text in ("", "naïve café 😀\r\n\r\n  x", "x" * 5000):
        assert decoder.feed(mine.encode(text)) + decoder.close() == text


def test_column_with_null_empty_repeated_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "a"), (4, "word " * 50_000), (5, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = tokens.encode_column(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["ids"] for r in got}
    assert by[1] == [] and by[2] == [] and by[3] == [15496, 995] and len(by[4]) == 50_001 and 50256 not in by[5] and by[None] == [64]
    back = {r["doc_id"]: r["text"] for r in tokens.decode_column(tokens.encode_column(df)).collect()}
    assert back == {i: t or "" for i, t in rows}
    counts = {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(df).collect()}
    assert counts[1] == 0 and counts[3] == 2
    assert tokens.encode_column(spark.createDataFrame([], "doc_id long, text string")).count() == 0
