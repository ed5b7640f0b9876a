"""N-grams and distances against plain Python, held-out accuracy, the defined results."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagemark.llm import langid

TEXTS = [None, "", "  1 2,\n", "a", "Ab c", "x1y", "Été ÉTÉ  été!", "日本 ﬁ İi", "the thin thing " * 50]


def plain_grams(text):
    small = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    out = Counter()
    for word in re.findall("[^ ]+", small):
        marked = f"_{word}_"
        out.update(word)
        out.update(marked[i:i + 2] for i in range(len(marked) - 1))
        out.update(marked[i:i + 3] for i in range(len(marked) - 2))
    return out


def spelled(number):
    length = (number >> 54) + 1
    points = [number >> 18 * k & (1 << 18) - 1 for k in reversed(range(length))]
    return "".join(chr(p) if p else "_" for p in points)


def test_grams():
    for texts in (TEXTS, TEXTS[:3], TEXTS[4:5], ["", "b"], ["b c", ""]):
        for text, grams in zip(texts, langid.grams_of(texts)):
            got = Counter(spelled(g) for g in grams.tolist())
            want = plain_grams(text)
            # words that stand side by side share the mark between them
            assert got == want, text


def test_learn_and_guess(spark):
    rng = random.Random(1)
    words = {"aa": "der die und nicht sich ein", "bb": "the and of that with is", "cc": "le la les des une est"}
    rows = [(lang, " ".join(rng.choices(own.split(), k=30))) for lang, own in words.items() for _ in range(9)]
    rows += [(None, "the the"), ("aa", None)]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    profiles = langid.learn(labelled.repartition(4), size=20)
    for lang in words:
        total = Counter()
        for own, text in rows:
            if own == lang:
                total += plain_grams(text)
        counts = [total[spelled(g)] for g in profiles[lang]]
        assert counts == sorted(total.values(), reverse=True)[:20]
    docs = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["und nicht der", "of that and", "les une est", None, "", "12 !", "z"] * 2)],
        "lang_pred long, text string")
    got = langid.identify(docs, profiles, size=20).collect()
    assert [r.lang_pred for r in got][:6] == ["aa", "bb", "cc", "und", "und", "und"]
    assert len(got) == 14 and all(0 <= r.lang_score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_distance():
    profiles = langid.Profiles({"x": [5, 6, 7], "y": [7, 6, 9]}, 3)
    import numpy as np

    # own order 7 7 7, 6 6, 5: away from x 2 + 0 + 2, from y 0 + 0 + 3
    assert profiles.guess(np.array([7, 7, 7, 6, 6, 5])) == ("y", 1 - 3 / 9)


def test_guess_as_a_whole():
    rng = random.Random(4)
    pool = "abcdeé "
    for size in (3, 20, 400):
        profiles = {}
        for name in ("zz", "aa", "mm", "bb"):
            grams = langid.grams_of(["".join(rng.choices(pool, k=400))])[0].tolist()
            profiles[name] = sorted(set(grams), key=lambda g: (-grams.count(g), g))[:size]
        own = langid.Profiles(profiles, size)
        for _ in range(40):
            text = "".join(rng.choices(pool + "xyz", k=rng.randrange(1, 200)))
            grams = Counter(langid.grams_of([text])[0].tolist())
            order = sorted(grams, key=lambda g: (-grams[g], g))[:size]
            if not order:
                continue
            away = {name: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(order))
                    for name, p in profiles.items()}
            best = min(sorted(away), key=away.get)
            got = own.guess(langid.grams_of([text])[0])
            assert got == (best, 1 - away[best] / (size * len(order)))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "der und", 7, [1])], "doc_id long, text string, lang_pred int, lang_score array<int>")
    found = langid.identify(docs, {"x": [5]}, pred="p", score="s").first()
    assert (found.lang_pred, found.lang_score, found.p) == (7, [1], "x")


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="test tables not there")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = langid.identify(docs.filter(held), langid.learn(docs.filter(~held)))
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_empty(spark):
    assert langid.learn(spark.createDataFrame([], "lang string, text string")) == {}
    assert langid.identify(spark.createDataFrame([], "text string"), {}).collect() == []
