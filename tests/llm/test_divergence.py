"""Both reports against plain Python with exact integers and against SQL; skybands against counting."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pagemark.llm import divergence
from pagemark.llm.queries import ORACLE, QUERIES


def plain(rows, least=30, top=50):
    docs, own, lang_n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        low = "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in text)
        terms = [t for t in low.split(" ") if t]
        groups.add((lang, source))
        own[lang, source].update(terms)
        lang_n[lang].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        size = len(kept)

        def share(counts, t):
            return 1 + 10 ** 9 * (counts[t] + 5) // (sum(counts[x] for x in kept) + 5 * size)

        p, q = ({t: share(c, t) for t in kept} for c in (own[lang, source], lang_n[lang]))
        pairs = [(s, sum(abs(p[t] - share(own[lang, s], t)) for t in kept))
                 for g, s in groups if g == lang and s != source]
        above = [(t, p[t] - q[t]) for t in kept if own[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", above, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, *x, i + 1) for i, x in enumerate(items[:most])}
    return out


def corpus(rng, sources, n):
    terms = ["the", "Été", "ñ", "zz", "日本", "a", "b", "cc", "🙂x"]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "de", None, ""])
        source = rng.choice([f"s{i}" for i in range(sources)] + [None])
        rows.append((lang, source, " ".join(rng.choice(terms) + rng.choice("A1bÀ- ") for _ in range(rng.randrange(9)))))
    return rows + [("fr", "only", "a b c"), ("xx", "a", None), ("xx", "b", ""), ("en", "new", None)]


SCHEMA = "lang string, source string, text string"


def test_audit(spark):
    rows = corpus(random.Random(3), 4, 150)
    df = spark.createDataFrame(rows, SCHEMA)
    for least, top in ((30, 50), (3, 4), (1, 1), (1000, 5)):
        got = [tuple(r) for r in divergence.audit(df.repartition(5), least, top).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows, least, top), (least, top)


def test_blocks_chunks_and_thinning(spark, monkeypatch):
    rows = corpus(random.Random(4), 9, 200)
    for name, value in (("BLOCK", 3), ("CHUNK_ROWS", 20), ("TERMS_AT_ONCE", 2)):
        monkeypatch.setattr(divergence, name, value)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), 2, 3).collect()
    assert {tuple(r) for r in got} == plain(rows, 2, 3) and len(got) == len(set(got))


@pytest.mark.parametrize("k", [1, 3, 50])
def test_skyband(k):
    rng = np.random.Generator(np.random.PCG64(k))
    for size in (0, 1, 40, 700):
        n, lang_n, place = rng.integers(0, 9, size), rng.integers(0, 9, size), rng.permutation(size)
        over = (n[:, None] >= n) & (lang_n[:, None] <= lang_n) & (place[:, None] < place)
        want = np.flatnonzero(over.sum(axis=0) < k)
        assert divergence.dominated_by_fewer(n, lang_n, place, k).tolist() == want.tolist()


def test_skybands_keep_what_they_must(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("l", f"s{i % 3}", f"t{i:04}", rng.randrange(1, 9), rng.randrange(9, 14)) for i in range(3000)]
    df = spark.createDataFrame(rows, divergence._ROWS)
    for held in (divergence.HELD, 100):
        monkeypatch.setattr(divergence, "HELD", held)
        kept = {tuple(r) for r in divergence.skybands(df.repartition(3), 5).collect()}
        for source in ("s0", "s1", "s2"):
            best = sorted((r for r in rows if r[1] == source), key=lambda r: (r[4] - r[3], r[2]))[:5]
            assert kept.issuperset(best)
        assert held == 100 or len(kept) < 1000


def test_shares_of_any_size(spark):
    df = spark.createDataFrame([(10 ** 13, 10 ** 15, 7), (0, 0, 1), (5, 3, 0)], "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.share(df.n, df.total, df.v)).collect()]
    assert got == [1 + 10 ** 9 * (n + 5) // (t + 5 * v) for n, t, v in [(10 ** 13, 10 ** 15, 7), (0, 0, 1), (5, 3, 0)]]


def test_terms():
    text = "A-bÉ x1Y z\x7f_q [W]"
    want = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text))
    assert [t.decode() for t in divergence.terms_of(text.encode())] == want


def test_other_columns_empty_and_long(spark):
    rows = corpus(random.Random(5), 2, 40) + [("en", "s0", "word " * 60_000 + "a")]
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows],
                               SCHEMA + ", term long, value string, n double")
    assert {tuple(r) for r in divergence.audit(df, 2, 9).collect()} == plain(rows, 2, 9)
    empty = divergence.audit(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_pair_sums_of_a_chunk_without_terms():
    table = pa.table({"lang": ["l", "l"], "lo": [0, 0], "hi": [0, 0], "term": pa.array([None, None], pa.string()),
                      "at": pa.array([0, 1], pa.int32()), "p": pa.array([3, 9], pa.int64())})
    assert divergence._pair_sums(table, 128, 9).num_rows == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables not there")
def test_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cursor = db.execute(ORACLE["op11_source_divergence"])
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    got = QUERIES["op11_source_divergence"](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want and len(want) > 500
