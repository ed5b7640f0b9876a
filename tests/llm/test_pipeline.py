"""The whole pipeline against plain Python on a small corpus."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from pagemark.llm import bpe
from tests.llm.test_lines import plain_classes
from tests.llm.test_simhash import plain


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    words = {"en": "the of and that with this from have which their".split(),
             "de": "der die und nicht sich eine auch werden nach wird".split()}

    def line(lang, n):
        return " ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") for _ in range(n))

    rows = []
    for i in range(90):
        lang = rng.choice(["en", "de"])
        rows.append((i, "\n".join(line(lang, rng.randrange(5, 30)) for _ in range(rng.randrange(1, 6))), lang))
    items = [(0, line("en", 14)), (1, line("de", 6))]
    rows += [(200 + i, t, l) for i, (_, t, l) in enumerate(rows[:9])]  # exact copies
    rows += [(300 + i, t.replace("a", "b", 1), l) for i, (_, t, l) in enumerate(rows[:9])]
    rows += [(400, rows[20][1] + "\n" + items[0][1], "en"), (401, items[1][1].upper() + "!", None)]
    rows += [(500, None, "en"), (501, "", None), (502, "12 34 !", "de"), (503, "x", None), (504, " ", "en")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [(d, t, l, "src", len(t or "")) for d, t, l in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def plain_run(rows, items):
    rows = [(d, t) for d, t, _ in rows if t is not None and any(c.isalpha() for c in t)]
    first = plain_classes(rows, 2, 20)
    cut = []
    for d, t in rows:
        kept = "\n".join(x for at, x in enumerate(t.split("\n")) if first.get((d, at), (d, at)) == (d, at))
        if kept.strip():
            cut.append((d, kept))
    groups = plain(cut)
    cut = [(d, t) for d, t in cut if groups[d][1] == d]

    def words(text):
        return "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text).split()

    def found(text, item):
        own, want = words(text), words(item)
        size = min(10, len(want))
        grams = {tuple(want[i:i + size]) for i in range(len(want) - size + 1)}
        return any(tuple(own[i:i + size]) in grams for i in range(len(own) - size + 1))

    return {d: t for d, t in cut if not any(found(t, i) for _, i in items)}


def test_run(spark, corpus):
    folder, rows, items = corpus
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, folder).collect()
    want = plain_run(rows, items)
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert 60 < len(want) < 95
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text)
        assert r.decodes and r.n_tokens == len(r.ids) // 4


def test_clashing_columns_keep_values_and_types(spark, corpus):
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("n_chars")
    names = ["hits", "drops", "Drop_id", "drop_text", "kept_id", "kept_text", "lang_pred", "lang_score", "verdict",
             "ids", "n_tokens", "decodes", "_drops", "line_no", "class_id", "fingerprint", "root", "key"]
    docs = docs.selectExpr("*", *(f"array(doc_id, {i}) AS `{name}`" for i, name in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.schema.simpleString() == docs.schema.simpleString(), name
        for r in kept.collect():
            assert [r[n] for n in names] == [[r.doc_id, i] for i in range(len(names))], name
            assert r.source == "src"
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert len(set(map(str.lower, last.columns))) == len(last.columns)
    assert all(r.decodes and r.hits == [r.doc_id, 0] for r in last.filter("text is not null").collect())


def test_empty(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []
