"""Fingerprints and groups against plain Python, and the defined results."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from pagemark.llm import simhash


def plain_print(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def plain_groups(prints, distance):
    parent = {p: p for p in prints}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= distance:
                parent[top(a)] = top(b)
    return {p: top(p) for p in prints}


def plain(rows, distance=4):
    prints = {d: plain_print(t) for d, t in rows}
    tops = plain_groups(set(prints.values()), distance)
    least = {}
    for d, p in prints.items():
        least[tops[p]] = min(d, least.get(tops[p], d))
    return {d: (p, least[tops[p]]) for d, p in prints.items()}


TEXTS = [
    None, "", "  \n", "One", "one", "a b c d", "a b c d", "A B c\td e", "é è ü ñ ó",
    "x " * 700, "x " * 701, "y z " * 300,
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(900)]
    texts = list(TEXTS)
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(900)] = "new" + str(rng.randrange(99))
        texts.append(" ".join(words))
    return list(enumerate(texts))


def test_near_duplicates(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    got = simhash.near_duplicates(docs.repartition(3)).collect()
    want = plain(rows)
    assert {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in got} == want
    assert len(got) == len(rows)
    assert len({w[1] for w in want.values()}) < len({w[0] for w in want.values()}) < len(rows)


@pytest.mark.parametrize("distance", [0, 1, 2, 4, 5, 7])
def test_links_of_random_bits(spark, distance):
    rng = random.Random(distance)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(12):
            prints.add(p)
            for bit in rng.sample(range(64), rng.randrange(1, 9)):
                p ^= 1 << bit
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = simhash.link_fingerprints(
        spark.createDataFrame([(p,) for p in signed], "fingerprint long"), distance
    ).collect()
    roots = {p: p for p in signed} | {r.fingerprint: r.root for r in got}
    want = plain_groups(set(signed), distance)
    assert len(set(zip(roots.values(), (want[p] for p in roots)))) == len(set(want.values())) \
        == len(set(roots.values()))


def test_keep_one(spark):
    rows = [(3, "a b c d e", "x"), (2, "a b c d e", "y"), (2, "a b c d e", "y"), (None, "a b c d e", "z"),
            (None, "other words stand here", None), (9, None, "n"), (8, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.component_id) for r in got.collect()) == [
        ("2", "y"), ("8", "e"), ("None", None)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == [] == simhash.keep_one(docs).collect()
