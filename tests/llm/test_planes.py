"""Frames as exact round trips, and written files against the library on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemark.llm import planes

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello WORLD", "don't  stop'll now's", "ÀÉ ñandú größer 日本語テキスト",
    "a" * 3000, "1234567890 " * 60, "👩‍👩‍👧‍👦 é ́x", "<|endoftext|> a<|startoftext|>b",
    "nb sp em\u0085nel \x1c fs", "ΑΣ ΑΣΑ İstanbul", "Thstorti token = \"04dbebab91ab\"",
]


@pytest.mark.parametrize("unit", [1, 8])
@pytest.mark.parametrize("count", [0, 1, 7, 8, 1000, 4097])
def test_round_trip(unit, count):
    draw = np.random.default_rng(count)
    for top in (2, 60_000, 2**32 - 1):
        ids = draw.integers(0, top, count, dtype=np.uint32)
        frame = planes.pack(ids, unit, block_ids=1000)
        assert planes.unpack(frame).tolist() == ids.tolist()


def test_other_bytes():
    with pytest.raises(ValueError):
        planes.unpack(b"\0" * 64)
    with pytest.raises(ValueError):
        planes.pack(np.zeros(3, np.uint32), unit=4)


def test_words_as_in_whole_texts():
    library = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    own = planes.WordTokenizer(PATH)
    alphabet = ["th", "the", "é", "ß", "İ", "ñ", "漢", "ı", "'s", "'", ".", ",", "!?", ";", ":", "1", "-", " ", " ", "\n",
                "e\u0301", "ﬁ", "Σ", "\u00a0", "ʼn", "A", "x",
                "<|endoftext|>", "<|startoftext|>", "<|endoftext|"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)]
    assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(texts)] == [
        e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_special_strings():
    own = planes.WordTokenizer(PATH)
    texts = ["<|endoftext|> a<|startoftext|>b", "a<|ENDOFTEXT|>", "<|endoftext |>", "x <|endoftext|>\n\n y.", None]
    got = [np.frombuffer(i, "<u4").tolist() for i in own.encode(texts)]
    assert got == [Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got[0] == [49407, 320, 49406, 321]


@pytest.mark.parametrize("unit", [1, 8])
def test_written_files(spark, tmp_path, unit):
    library = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 23 if i else None, t, "x") for i, t in enumerate(TEXTS)] + [(5, "again", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    path = str(tmp_path / "planes")
    planes.write_planes(docs, path, PATH, shards=4, unit=unit, segment_ids=50)
    got = planes.read_planes(spark, path).sort("start").collect()
    want, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == want
    assert planes.ids_crc32(want[3][3]) == zlib.crc32(want[3][3])
    index = spark.read.parquet(path).select("shard", "segment", "n_ids", "start_in_shard").collect()
    assert sum(r.n_ids for r in index) == start


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    planes.write_planes(docs, str(tmp_path / "none"), PATH)
    assert planes.read_planes(spark, str(tmp_path / "none")).collect() == []


def test_words_of_ascii_letters_stay_bytes(monkeypatch):
    own, library = planes.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    taken, learn = [], planes.WordTokenizer._runs
    monkeypatch.setattr(planes.WordTokenizer, "_runs", lambda self, words: (taken.extend(words), learn(self, words)))
    text = "plain Words, été naïve! x2 don't <b ʼn ... , end. plain été,"
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert {b"plain", b"Words", b"end", "été".encode()} <= set(taken)
    assert not {b"x2", b"don't", b"...", b""} & set(taken)
