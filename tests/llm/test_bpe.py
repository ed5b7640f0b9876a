"""Ids against the tiktoken library, and exact round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pagemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello world", "don't  stop now", "ÀÉ ñandú größer 日本語テキスト",
    "a" * 3000, "ab" * 700 + " " + "=" * 500, "1234567890" * 60, "👩‍👩‍👧‍👦 é", "<|endoftext|>",
    "\u0000\u0001 x\r\n", "Thstorti token = \"04dbebab91ab\"", " " * 900,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_columns(spark, library):
    rows = [(i, t, "old") for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    got = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")


def test_random_pieces(library):
    rng = random.Random(1)
    own = bpe.Bpe(bpe.read_ranks(PATH), PATTERN)
    alphabet = "abcdefghijklmnopqrstuvwxyzéèüñ tion the  .,;:0123ÄШ漢"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(200))) for _ in range(3000)]
    assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(texts)] == [
        library.encode_ordinary(t) for t in texts]


def test_heap_and_matrix_agree():
    own = bpe.Bpe(bpe.read_ranks(PATH), PATTERN)
    rng = random.Random(2)
    for size in (1, 2, 3, 17, 90, 256):
        pieces = [bytes(rng.choices(b"etaoin \xc3\xa9", k=size)) for _ in range(40)]
        for piece, ids in zip(pieces, own.merge_rows(pieces)):
            assert ids.tolist() == own.merge_long(piece).tolist()


def test_null_ids_and_empty(spark):
    ids = spark.createDataFrame([(None,), (b"",)], "ids binary")
    assert {r.decoded for r in bpe.decode(ids, PATH, PATTERN).collect()} == {None, b""}
    empty = spark.createDataFrame([], "text string")
    assert bpe.encode(empty, PATH, PATTERN).collect() == []


def test_round_trip(spark):
    rows = [(1, "a tion é"), (2, None), (3, ""), (4, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as ids", "'y' as more")
    got = bpe.round_trip(docs, PATH, PATTERN).collect()
    want = bpe.encode(docs, PATH, PATTERN).collect()
    assert [(r.doc_id, r.ids, r.more) for r in got] == [(r.doc_id, r.ids, r.more) for r in want]
    assert all(r.decodes for r in got)
