"""Measures and rules against plain Python and SQL, tables of rules, the defined results."""

import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from pagemark.llm import quality
from pagemark.llm.quality import Rule
from pagemark.llm.queries import ORACLE, QUERIES

SPACE = " \t\n\x0b\f\r"


def plain(text):
    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {q for p in range(len(words) - 7) if windows[tuple(words[p:p + 8])] > 1 for q in range(p, p + 8)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    low = "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalpha() or not c.isascii() else " "
                  for c in text)
    stop = set(" ".join(quality.STOP_WORDS.values()).split())
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_letter_words": sum(any(not c.isascii() or c.isalpha() for c in w) for w in words),
        "n_lines": len(lines), "n_bullet_lines": sum(x.lstrip(SPACE)[0] in "-*•" for x in lines),
        "n_cut_lines": sum(x.rstrip(SPACE).endswith(("...", "…")) for x in lines),
        "n_letter_runs": len(low.split(" ")) - low.split(" ").count(""),
        "n_stop_words": sum(w in stop for w in low.split(" ")),
    }


def texts():
    rng = random.Random(5)
    few = "the of a cat # 12 ünd…".split()
    out = [None, "", " ", "\n\n", "a", "  x y", "\x00 \x01", "🙂 ### 🙂🙂", "…\n...\n- a\n• b\n-", "a b c d e f g h"]
    out += [" ".join(rng.choice(few) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    out += ["\n".join(rng.choice(["the cat sat", "- x", "cut...", "", "\t"]) for _ in range(9)) for _ in range(20)]
    part = " ".join(f"w{i}" for i in range(11))
    return out + [part + " " + part, part + " x " + part, part + " " + part[:-4], "a " * 30, "long " * 40_000]


def test_measures(spark):
    rows = list(enumerate(texts()))
    got = quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for row in got:
        want = plain(rows[row.doc_id][1])
        assert {name: row.quality[name] for name in quality.MEASURES} == want, rows[row.doc_id]
        base = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        failed = [r.rule for r in quality.RULES if breaks(r, want)]
        assert (row.quality.base_failed, row.quality.failed) == (base, failed)
        assert row.quality.kept == (not base and not failed)


def breaks(rule, measured):
    value, base = measured[rule.measure], 1
    if rule.per:
        value, base = 1000 * value, measured[rule.per]
    low = rule.least is not None and value < rule.least * base
    return base > 0 and (low or rule.most is not None and value > rule.most * base)


def test_thresholds(spark):
    docs = spark.createDataFrame([(1, "w " * 25 + "#"), (2, "w " * 25)], "doc_id long, text string")
    rules = [Rule("a", "n_words", None, 26, 26), Rule("b", "n_symbols", "n_words", most=38), Rule("c", "n_lines")]
    # 1 of 26 is 38.46 thousandths; 26 words are just enough
    assert {r.doc_id: r.quality.failed for r in quality.apply_rules(docs, rules).collect()} == {1: ["b"], 2: ["a"]}
    assert quality.apply_rules(docs, []).select("quality.failed").first().failed == []
    with pytest.raises(ValueError):
        quality.apply_rules(docs, [Rule("x", "text; drop")])


def test_rule_table(spark):
    rows = [(r.rule, r.measure, r.per, r.least, r.most) for r in reversed(quality.RULES)]
    table = spark.createDataFrame(rows, "rule string, measure string, per string, least int, most int")
    assert quality.read_rules(table) == sorted(quality.RULES, key=lambda r: r.rule)
    with pytest.raises(ValueError):
        quality.read_rules(table.crossJoin(spark.range(quality.MAX_RULES)))


def test_keep_leaves_columns_alone(spark):
    good = "The cat is in the garden and it was not to be seen by the dog, as all of them say. "
    rows = [(i, t, i, f"v{i}", [1.5]) for i, t in enumerate([good, good, None, "", "x", good + "### " * 20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, verdict string, Kept array<double>")
    kept = quality.keep(docs)
    assert kept.schema == docs.schema
    assert sorted(kept.collect()) == sorted(docs.filter("doc_id < 2").collect())
    assert quality.keep(docs.limit(0)).collect() == []
    wide = quality.apply_rules(docs, column="rules")
    assert wide.drop("rules").schema == docs.schema and wide.count() == 6
    assert quality.apply_rules(docs).columns == docs.columns  # replaced in place


def test_one_projection(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality.apply_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    # words once, and two counts that are planned as extractions
    assert plan.count("regexp_extract_all") == 3
    plan = quality.keep(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 3


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables not there")
def test_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cursor = db.execute(ORACLE["op13_quality_rules"])
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    got = QUERIES["op13_quality_rules"](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want
    assert got.filter(F.col("kept")).count() > 100
