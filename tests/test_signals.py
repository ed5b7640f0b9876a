import re

import pytest
from pyspark.sql import functions as F

from pagemark.functions import signals as S
from pagemark.functions.decide import compare_and_decide
from pagemark.operators.overlap import semantic_overlap_exploded


def grams(text):
    words = re.findall(r"\w+", text.lower())
    return {" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def jaccard(a, b):
    x, y = grams(a or ""), grams(b or "")
    return len(x & y) / len(x | y) if x and y else 0.0


OVERLAP_PAIRS = [
    ("Nine grey herons wait beside a frozen canal",) * 2,
    ("Rye bread needs a long and slow rise", "Harbour ferries stop at midnight in winter"),
    ("Old maps show the river north of the mill before the flood moved it",
     "Before the flood moved it the river ran north of the mill on old maps"),
    ("", "lone words"), (None, "lone words"), (None, None), ("one", "one"), ("a b", "b a"), ("été à la plage", "l'été à la plage"),
    ("...", "x"),
]


def test_overlap(apply):
    got = apply(S.semantic_overlap, OVERLAP_PAIRS)
    assert got == pytest.approx([jaccard(a, b) for a, b in OVERLAP_PAIRS])
    assert got[0] == 1.0 and got[1] < 0.5 and got[2] > 0.3 and got[3] == 0.0


def test_overlap_exploded_is_the_same(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(OVERLAP_PAIRS)]
    df = spark.createDataFrame(rows, "k int, text_a string, text_b string")
    for size in (1, 2, 3, 7, 4096):
        got = {r.k: r.overlap for r in semantic_overlap_exploded(df, "k", chunk_words=size).collect()}
        assert got == pytest.approx({k: jaccard(a, b) for k, a, b in rows})


def test_overlap_of_a_very_long_text(spark):
    df = spark.range(1).select(
        "id", F.expr("array_join(transform(sequence(1, 1000000), i -> string(i % 5000)), ' ')").alias("text_a"))
    got = semantic_overlap_exploded(df.withColumn("text_b", F.col("text_a")), "id").collect()
    assert got[0].overlap == 1.0


def test_overlap_exploded_of_repeated_keys(spark):
    rows = [(1, "a b c d", "c d e"), (1, "x y", "a b"), (2, "a b", "a b"), (2, "a b", "a b"), (None, "q", "q r"),
            (None, "r s t u v w", None), (3, "", None), (3, None, ""), (4, "a b c d e f g h", "h")]

    def grams(key, at):
        texts = [r[at].split() for r in rows if r[0] == key and r[at]]
        return {tuple(t[i:i + n]) for t in texts for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    want = {}
    for key in {r[0] for r in rows}:
        a, b = grams(key, 1), grams(key, 2)
        want[key] = len(a & b) / len(a | b) if a | b else 0.0
    df = spark.createDataFrame(rows, "k int, text_a string, text_b string")
    for size in (1, 2, 4096):
        got = [(r.k, r.overlap) for r in semantic_overlap_exploded(df, "k", chunk_words=size).collect()]
        assert len(got) == len(want) and dict(got) == pytest.approx(want)


def test_overlap_exploded_shuffles_no_row_for_each_gram(spark):
    def shuffled(plan):
        own = plan.metrics().get("shuffleRecordsWritten")
        below = plan.children()
        return sum(shuffled(below.apply(i)) for i in range(below.size())) + (own.get().value() if own.isDefined() else 0)

    text = F.expr("array_join(transform(sequence(1, 400), i -> string(i * (1 + id))), ' ')")
    long = F.expr("array_join(transform(sequence(1, 20000), i -> string(i + id)), ' ')")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for rows, words in ((50, text), (2, long)):
            df = spark.range(rows).select("id", words.alias("text_a"), words.alias("text_b"))
            out = semantic_overlap_exploded(df, "id")
            assert [r.overlap for r in out.collect()] == [1.0] * rows
            assert shuffled(out._jdf.queryExecution().executedPlan()) < 400
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_missing_texts_and_pages(apply):
    empty, missing, half = apply(S.signals, [("", ""), (None, None), (None, "<h1>a</h1>")])
    assert empty == missing and missing.len_text == 0 and missing.density == 0.0 and missing.structure == 0
    assert half.headings == 1 and half.word_count == 0
    assert apply(S.len_text, [None]) == apply(S.structure, [None]) == [0]
    assert apply(S.density, [(None, None)]) == apply(S.freshness, [None]) == [0.0]
    full = "enough words to stand for an article " * 300
    rows = [(None, None, full, f"<p>{full}</p>", 0.0), ("", "", full, f"<p>{full}</p>", 0.0)]
    for d in apply(compare_and_decide, rows, ["string"] * 4 + ["double"]):
        assert d.chosen == "refetch" and d.overlap == 0.0


def test_signals(apply):
    text = "Eight short words fill every line of this. " * 20
    html = "<h1>Canal</h1><p>heron</p><p>ice</p><ul><li>reed</li></ul>"
    rich = ("<h1>T</h1><h2>S</h2><h3>U</h3><ul><li>1</li><li>2</li><li>3</li></ul>"
            "<ol><li>1</li><li>2</li></ol>")
    basic, good, poor = apply(S.signals, [(text, html), ("two words", rich),
                                          ("two words", "<p class='x'>nothing but words</p>")])
    assert basic.len_text == len(text) and basic.word_count == 160
    assert basic.density == pytest.approx(160 / 4 / 100) and basic.structure == 3
    assert good.structure == 11 and good.headings == 3 and good.lists == 5
    assert poor.structure == 0 and poor.density == pytest.approx(0.02)


def test_caps_links_and_dates(apply):
    assert apply(S.len_text, ["x" * 60000, ""]) == [50000, 0]
    links = ['<a href="http://a">', '<a href="http://a"><a href="/b"><a href=\'http://c\'>', "none"]
    assert apply(S.link_quality, links) == [1.0, 0.5, 0.0]
    dates = ["on 2024-01-02", "1/2/2024 x", "Mar 3, 2020", "Mar  3 2020", "x" * 500 + "2024-01-02",
             "March 3 2020"]
    assert apply(S.freshness, dates) == [1.0, 1.0, 1.0, 1.0, 0.0, 0.0]


def test_score(apply):
    args = (0.8, 0.6, 25.0, 1.0, 0.7)
    types = ["double"] * 6
    plain, fined, low = apply(
        S.score_candidate, [(*args, 0.0), (*args, 0.3), (0.0, 0.0, 0.0, 0.0, 0.0, 0.3)], types)
    assert plain == pytest.approx(0.35 * 0.8 + 0.2 * 0.6 + 0.1 * 0.5 + 0.1 + 0.05 * 0.7)
    assert fined == pytest.approx(plain - 0.3) and low == 0.0


def test_decision(apply):
    text, html = "herons on ice " * 50, "<article>" + "<p>x</p>" * 20 + "</article>"
    long_text = "every heron of the canal was counted again at dusk " * 100
    long_html = "<article>" + "<p>one count and its hour</p>" * 50 + "</article>"
    rows = [(text, html, text, html, 0.0), (text, html, text, html, 0.3),
            ("few words", "<p>few</p>", long_text, long_html, 0.0)]
    tie, blocked, better = apply(compare_and_decide, rows, ["string"] * 4 + ["double"])
    assert tie.chosen == "capture" and tie.score_diff < 0.05 and tie.overlap == 1.0
    assert blocked.chosen == "capture" and blocked.blocker_penalty == 0.3
    assert better.chosen == "refetch" and better.score_b > better.score_a


def test_blocker_penalty(spark):
    schema = ("login_required boolean, paywall boolean, captcha boolean, cross_origin_iframe boolean,"
              " content_too_thin boolean, csp_blocked boolean, error string")
    no = [False] * 6
    rows = [(*no, None), (*no, ""), (*no, "Page load timeout"), (*no[:5], True, None)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, f struct<{schema.replace(' boolean', ':boolean').replace(' string', ':string')}>")
    got = df.select("i", S.blocker_penalty(F.col("f")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [0.0, 0.0, 0.3, 0.3]


def test_overlap_of_a_very_long_pair(spark):
    from pagemark.functions.signals import semantic_overlap

    # the same million words, in the second text moved by 1,000 places
    numbers = F.sequence(F.lit(0), F.lit(999_999))
    a, b = (F.array_join(F.transform(numbers, lambda i: F.concat(F.lit("w"), (i + k).cast("string"))), " ")
            for k in (0, 1000))
    row = spark.range(1).select(a.alias("a"), b.alias("b")).select(semantic_overlap(F.col("a"), F.col("b")).alias("o"))
    shared = sum(999_000 - n + 1 for n in (1, 2, 3))
    total = 2 * sum(1_000_000 - n + 1 for n in (1, 2, 3))
    assert row.first().o == shared / (total - shared)
