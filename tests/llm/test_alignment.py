"""Groups, links and corpus counts against a plain loop over byte offsets; long texts, odd texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pagemark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(ids, bytes_of):
    at, out = 0, []
    for i in ids:
        out.append((i, at, at + len(bytes_of(i))))
        at = out[-1][2]
    return out


def plain_one(libraries, text):
    """Token spans of both, if they give the text again."""
    a, b = libraries
    shown = alignment.byte_characters()

    def a_bytes(i):
        return bytes(shown[c] for c in a.id_to_token(i))

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    if not text:
        return [], []
    raw = (" " + text).encode()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if b"".join(map(a_bytes, x)) != raw or b"".join(map(b_bytes, y)) != raw:
        return [], []
    return spans(x, a_bytes), spans(y, b_bytes)


def plain(libraries, rows):
    links, held, out = {}, Counter(), []
    for n, (_, text) in enumerate(rows):
        x, y = plain_one(libraries, text)
        links[n] = Counter()
        for i, begin, end in x:
            for j, low, high in y:
                if low >= end:
                    break
                if high > begin:
                    links[n][i, j] += 1
        held.update(set(links[n]))
        both = sorted({e for *_, e in x} & {e for *_, e in y})
        texts, begin = [], 0
        for end in both:
            texts.append("|".join(",".join(str(i) for i, s, _ in own if begin <= s < end) for own in (x, y)))
            begin = end
        out.append([rows[n][0], len(x), len(y), len(both), sum(links[n].values()), ";".join(texts)])
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [(*own[:5], sum(m for (i, j), m in links[n].items() if held[i, j] == most[i]),
             sum(m * held[p] for p, m in links[n].items()),
             hashlib.sha256(own[5].encode()).hexdigest() if own[5] else "")
            for n, own in enumerate(out)]


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces \n\n\t x"), (5, "a▁b"), (6, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (7, "日本語のテキスト 🙂🙃 é"), (8, "\x00 \x07\r\n"), (9, "don't I'LL 1234567 $$$ ###"), (10, "▁"), (11, " 　x"),
    (None, "same same"), (None, "same same"), (12, "x" * 3000), (13, "\n" * 700), (14, "ﬁ Å ①"),
]


def corpus(seed, n):
    rng = random.Random(seed)
    words = "the of cation Straße naïve ciónrr 12 , . token tokens un-aligned\n 日本 ¿qué? internationalization".split(" ")
    return [(100 + i, " ".join(rng.choice(words) + rng.choice(["", "s", " "]) for _ in range(rng.randrange(1, 40))))
            for i in range(n)]


def test_score(spark, libraries):
    rows = ODD + corpus(1, 60) + corpus(1, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(plain(libraries, rows), key=str)
    for parts, chunk in ((1, alignment.CHUNK_BYTES), (5, 200)):
        got = alignment.score(df.repartition(parts), A, B, chunk)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert got.columns == [c.split()[0] for c in alignment.SCORED.split(", ")]


def test_parts_change_nothing(spark, libraries):
    rows = [(1, "\n".join(t for _, t in corpus(2, 40))), (2, " ".join(t for _, t in ODD if t and "▁" not in t)),
            (3, "x y " * 50 + "▁" + " z" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = alignment.align(df, A, B).collect()
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links) for r in sorted(whole)] == [w[1:5] for w in plain(libraries, rows)]
    for chars in (1, 7, 30):
        assert sorted(alignment.align(df, A, B, chars).collect()) == sorted(whole)
    own = alignment.aligner(A, B)
    assert own.cuttable and len(own.parts(rows[0][1], 7)) > 100
    assert "".join(own.parts(rows[1][1], 3)) == " " + rows[1][1]


def test_groups_and_overlaps():
    rng = np.random.Generator(np.random.PCG64(3))
    for _ in range(30):
        a, b = (np.unique(np.concatenate((rng.integers(1, 40, 12), [40]))) for _ in range(2))
        starts = [np.concatenate(([0], x[:-1])) for x in (a, b)]
        left, right, n = alignment.overlaps(starts[0], a, starts[1], b)
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]]
        assert list(zip(left.tolist(), right.tolist())) == want and n.sum() == len(want)
        side = np.repeat([0, 1], [len(a), len(b)])
        group = alignment.coalesce(np.concatenate(starts), np.concatenate((a, b)), side)
        shared = sorted(set(a.tolist()) & set(b.tolist()))
        assert group.tolist() == [int(np.searchsorted(shared, e)) for e in np.concatenate((a, b))]
    assert alignment.coalesce(a[:0], a[:0], a[:0]).tolist() == []


def test_align(spark, libraries):
    rows = ODD + corpus(4, 20)
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    for row, (_, text) in zip(got, rows):
        x, y = plain_one(libraries, text)
        links = Counter((i, j) for i, b, e in x for j, low, high in y if low < e and high > b)
        assert {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(row.pairs, row.times)} == links
        assert sum(len(g.split("|")[0].split(",")) for g in row.groups.split(";") if g) == row.n_a


def test_planes():
    numbers = np.array([0, 1, 255, 70_000, 2 ** 32 - 1, 5])
    assert alignment.expand(alignment.squeeze(numbers)).tolist() == numbers.tolist()
    assert alignment.expand(alignment.squeeze(numbers[:0])).tolist() == []


def test_empty_long_and_other_columns(spark, libraries):
    rows = [(1, "some words here " * 30_000, 5, "x"), (2, "some words", 6, "y")]
    df = spark.createDataFrame(rows, "doc_id int, text string, chunk int, pairs string")
    got = {r.doc_id: r for r in alignment.score(df, A, B).collect()}
    assert got[2].n_a == 2 and got[1].n_a > 80_000 and got[1].n_groups == got[1].n_a
    assert alignment.score(df.limit(0), A, B).collect() == []
    assert alignment.score(df.select("doc_id", "text").filter("false"), A, B).count() == 0
