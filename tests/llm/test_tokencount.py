"""Trees after edits against counting whole texts again."""

import random

import public_tokenizers
import pytest

from pagemark.llm import tokencount

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def edited(text, at, cut, put):
    at = min(max(at, 0), len(text))
    return text[:at] + (put or "") + text[at + max(cut or 0, 0):]


@pytest.mark.parametrize("leaf_chars", [1, 3, 20, 512])
def test_random_edits(leaf_chars):
    rng = random.Random(leaf_chars)
    count = tokencount.Counter(PATH, PATTERN)
    library = count.library.encode_ordinary
    alphabet = "ab 'stre  \n12é漢.,"
    for _ in range(60):
        text = "".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 60, 900])))
        tree = tokencount.Tree(count, text, *count.leaves(text, leaf_chars), leaf_chars)
        assert tree.tokens[1] == len(library(text))
        for _ in range(25):
            at, cut = rng.randrange(-2, len(text) + 4), rng.choice([0, 1, 2, 9, 70])
            put = "".join(rng.choices(alphabet, k=rng.choice([0, 1, 2, 8, 50, 400])))
            tree.edit(at, cut, put)
            text = edited(text, at, cut, put)
            assert tree.text() == text
            assert tree.tokens[1] == len(library(text)), (at, cut, put)
            chars, tokens = tree.leaf_sums()
            assert sum(chars) == len(text) and sum(tokens) == tree.tokens[1]


@pytest.mark.parametrize("blank", ["\n\n", "\t", "  ", " \n \n", "\u00a0 "])
def test_leaves_that_grow_and_end_in_blanks(blank):
    rng = random.Random(len(blank))
    count = tokencount.Counter(PATH, PATTERN)
    library = count.library.encode_ordinary
    text = ("ab" + blank) * 400
    for at in [0, 1, 2, 3, 4, 5, 700, len(text) - 2, len(text)]:
        tree = tokencount.Tree(count, text, *count.leaves(text, 512))
        tree.edit(at, 0, text[:5000] + "x" * 100)
        assert tree.tokens[1] == len(library(tree.text())), at
    tree, now = tokencount.Tree(count, text, *count.leaves(text, 512)), text
    for _ in range(150):  # many small inserts at one place, then large ones anywhere
        tree.edit(900, 0, put := rng.choice([blank, "a" + blank, blank + "b", " "]) * 9)
        now = edited(now, 900, 0, put)
        assert tree.tokens[1] == len(library(now))
    for _ in range(12):
        at, cut = rng.randrange(len(now)), rng.choice([0, 6000])
        put = "".join(rng.choices(["word", blank, " ", "é", "12"], k=rng.choice([1, 3000])))
        tree.edit(at, cut, put)
        now = edited(now, at, cut, put)
        assert tree.text() == now and tree.tokens[1] == len(library(now))


def test_only_the_region_is_encoded():
    count = tokencount.Counter(PATH, PATTERN)
    text = "some words stand here and there, " * 9000
    tree = tokencount.Tree(count, text, *count.leaves(text, 512))
    tree.edit(len(text) // 2, 3, "new")
    assert 0 < tree.encoded_chars < 5 * 512


def test_documents(spark):
    rows = [(1, "one two three", 0), (2, None, 0), (3, "", 0), (4, "x " * 3000, 0), (5, "alone", 0),
            (6, "twice b", 0), (6, "twice a", 0), (None, "no id", 0), (None, "no id", 0)]
    edits = [(1, 2, 0, 3, "ONE"), (1, 1, 4, 0, "and a half "), (2, 1, 0, 9, "born"), (3, 1, 5, 5, None),
             (4, 1, 2999, 2, "yy"), (4, 2, 0, 100000, "z"), (6, 1, 0, 5, "once"), (9, 1, 0, 0, "nobody"),
             (None, 1, 0, 0, "no id"), (5, 1, None, 1, "no place"), (5, 2, 1, None, "-")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, seq int")
    trees = tokencount.build_trees(docs.repartition(3), PATH, PATTERN)
    got = tokencount.apply_edits(
        trees, spark.createDataFrame(edits, "doc_id long, seq long, at long, cut long, put string"),
        PATH, PATTERN).collect()
    library = tokencount.Counter(PATH, PATTERN).library.encode_ordinary
    want = {(1, "ONE and a half two three"), (2, "born"), (3, ""), (4, "z"), (5, "a-lone"),
            (6, "once a"), (6, "twice b"), (None, "no id")}
    assert {(r.doc_id, r.text) for r in got} == want and len(got) == len(rows)
    before = {(d, len(library(t or ""))) for d, t, _ in rows}
    for r in got:
        assert r.n_tokens == len(library(r.text)) == sum(r.leaf_tokens) and r.n_chars == len(r.text)
        assert (r.doc_id, r.n_tokens_before) in before
    assert {r.doc_id: r.n_edits for r in got if r.doc_id != 6} == {
        1: 2, 2: 1, 3: 1, 4: 2, 5: 1, None: 0}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    edits = spark.createDataFrame([], "doc_id long, seq long, at long, cut long, put string")
    trees = tokencount.build_trees(docs, PATH, PATTERN)
    assert tokencount.apply_edits(trees, edits, PATH, PATTERN).collect() == []
