"""Hits against plain Python, blocks of the benchmark, spans taken out, the defined results."""

import random
import re

import pytest

from pagemark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, window):
    grams = {}
    for item, text in items:
        own = words(text)
        if item is not None and own:
            for i in range(max(1, len(own) - window + 1)):
                grams.setdefault(tuple(own[i:i + window]), set()).add(str(item))
    out = []
    for doc_id, text in rows:
        own, hit, found = words(text), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(own) - size + 1):
                if tuple(own[i:i + size]) in grams:
                    hit.update(range(i, i + size))
                    found |= grams[tuple(own[i:i + size])]
        out.append((str(doc_id), len(own), len(hit), sorted(found)))
    return sorted(out)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(2)
    vocabulary = ["aa", "b2", "été", "Cc", "d", "日本"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 4, 9, 30]))) for i in range(25)]
    items += [(3, text(12)), (None, text(12)), (90, None), (91, ""), (92, "!?")]
    rows = [(i, text(rng.randrange(120))) for i in range(60)]
    rows += [(100 + i, text(5) + t.upper() + text(5)) for i, (_, t) in enumerate(items) if t]
    rows += [(200, None), (201, ""), (202, "..."), (5, rows[5][1]), (None, items[20][1])]
    return rows, items


@pytest.mark.parametrize("window", [1, 3, 10])
@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_hits(spark, data, window, block_bytes):
    rows, items = data
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, hits int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_hits(docs, bench, window, block_bytes).collect()
    assert sorted(
        (str(r.doc_id), r.hits.n_words, sum(s.end - s.begin for s in r.hits.spans), r.hits["items"]) for r in got
    ) == plain(rows, items, window)
    for r in got:
        assert all(a.end < b.begin for a, b in zip(r.hits.spans, r.hits.spans[1:]))


def test_removal(spark):
    bench = spark.createDataFrame([(1, "one two three four"), (2, "five six")], "item_id long, text string")
    rows = [(1, "say: ONE, two three; four! and five"), (2, "five-six, then five six end"), (3, "clean five"),
            (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in D.remove_documents(docs, bench).collect()} == {3, 4, 5}
    got = {r.doc_id: r.text for r in D.remove_spans(docs, bench).collect()}
    assert got == {1: "say: ! and five", 2: ", then  end", 3: "clean five", 4: None, 5: ""}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in D.remove_documents(docs, bench).collect()] == [(1, "one two")]
    assert D.find_hits(docs.limit(0), spark.createDataFrame([(1, "one")], "item_id long, text string")).collect() == []


def test_long_text(spark):
    text = "w " * 200_000 + "one two three"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = D.find_hits(docs, spark.createDataFrame([(1, "one two three")], "item_id long, text string")).first()
    assert [(s.begin, s.end) for s in got.hits.spans] == [(200_000, 200_003)]


def test_one_block_at_a_time(spark):
    docs = spark.createDataFrame([(i, f"a b c{i} d e {i}") for i in range(20)], "doc_id long, hits string")
    docs = docs.withColumnRenamed("hits", "text").selectExpr("*", "doc_id as hits", "'x' as HITS_")
    bench = spark.createDataFrame([(i, f"b c{2 * i}") for i in range(10)], "item_id long, text string")
    found = D.find_hits(docs, bench, block_bytes=10, column="found")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the earlier passes were written
    assert {r.doc_id for r in found.filter("size(found.spans) > 0").collect()} == set(range(0, 20, 2))
    for kept in (D.remove_documents(docs, bench), D.remove_spans(docs, bench)):
        assert kept.schema == docs.schema and all(r[2] == r.doc_id and r[3] == "x" for r in kept.collect())
