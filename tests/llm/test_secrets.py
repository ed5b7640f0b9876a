"""Candidates and coverage against plain Python, held-out findings, the defined results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagemark.llm import secrets

TEXTS = [
    None, "", "short words only", "a" * 16, "x" * 15, 'key = "0123456789abcdef0123"; next',
    "one/path/with/a/long/name.txt two", "A\x01B " + "Q" * 20 + "==" + " end", "é" + "z9" * 9 + "é",
    "k" * 70_000,
]


def test_candidates(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string")
    got = sorted(map(tuple, secrets.candidates(docs).collect()))
    want = []
    for doc_id, text, _ in rows:
        text = (text or "").replace("\x01", " ")
        spans = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", text)]
        for at, (begin, end) in enumerate(spans):
            last = spans[at - 1][1] if at else 0
            after = spans[at + 1][0] if at + 1 < len(spans) else len(text)
            want.append((doc_id, at, text[begin:end], text[last:begin][-48:], text[end:after][:48]))
    assert got == sorted(want)


def test_coverage(spark):
    docs = spark.createDataFrame([("Token tokens of STONES",), (None,)], "text string")
    pieces = secrets.dictionary(docs)
    assert {r.piece for r in pieces.collect()} == {"toke", "oken", "kens", "ston", "tone", "ones"}
    values = spark.createDataFrame([("xTokens1",), ("zzzzzz",)], "value string")
    got = {r.value: r.coverage for r in secrets.coverage(values, pieces).collect()}
    assert got == {"xTokens1": 3 / 5, "zzzzzz": 0.0}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = ["stone", "water", "letter", "garden", "window", "morning", "paper"]
    rows = []
    for i in range(400):
        own = " ".join(rng.choices(words, k=12))
        if i % 2:
            own += ' api_key = "' + "".join(rng.choices("0123456789abcdefABCDEF", k=36)) + '" ' + rng.choice(words)
        else:
            own += " " + rng.choice(("/usr/" + "/".join(rng.choices(words, k=4)), "".join(rng.choices(words, k=4))))
        rows.append((i, own, i % 2))
    return spark.createDataFrame(rows, "doc_id long, text string, score int")


def test_held_out_findings(docs):
    labels = F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("doc_id") % 2)
    got = secrets.scan(docs, labels).collect()
    assert len(got) == 400
    held = [r for r in got if r.doc_id % 5 == 0]
    assert sum(r.kept == bool(r.doc_id % 2) for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_one_label_or_none(docs):
    few = docs.limit(6)
    assert {(r.score, r.kept) for r in secrets.scan(few, F.lit(1)).collect()} == {(1.0, True)}
    assert {(r.score, r.kept) for r in secrets.scan(few, F.lit(0)).collect()} == {(0.0, False)}
    assert {(r.score, r.kept) for r in secrets.scan(few, F.lit(None).cast("int")).collect()} == {(None, True)}


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.scan(empty, F.lit(1)).collect() == []
