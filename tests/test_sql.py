"""Every SQL name gives what its Column gives."""

import pytest
from pyspark.sql import functions as F

from pagemark.functions import signals
from pagemark.functions import sql as S
from pagemark.functions.decide import compare_and_decide

TEXTS = [
    "<article><h1>Herons</h1><p>Six of them &amp; ice</p><li>reed</li></article>",
    "https://user@www.Mill.test:443/a/?utm_source=x&token=t#f", "lang-py", "import os\n\nprint(1)",
    "`1 a\n2 b` and\n\n\n\ntext", "[a](/b?ref=1) on 2024-01-02", "", None,
]


@pytest.fixture(scope="module")
def table(spark):
    S.register_sql(spark)
    rows = [(i, a, TEXTS[(i + 1) % len(TEXTS)]) for i, a in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "i int, a string, b string")


@pytest.mark.parametrize("name", [*S.ONE_TEXT, *S.TWO_TEXTS])
def test_text_functions(table, name):
    if name in S.ONE_TEXT:
        column, call = S.ONE_TEXT[name][0](F.col("a")), f"pm_{name}(a)"
    else:
        column, call = S.TWO_TEXTS[name][0](F.col("a"), F.col("b")), f"pm_{name}(a, b)"
    rows = table.select(column.alias("want"), F.expr(call).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_scores_and_decision(spark, table):
    flags = F.struct(
        *(F.lit(False).alias(n) for n in signals.PENALIZED[:-1]), (F.length("a") > 20).alias("csp_blocked"),
        F.lit(None).cast("string").alias("error"))
    rows = table.withColumn("flags", flags).select(
        signals.blocker_penalty(F.col("flags")).alias("p"), F.expr("pm_blocker_penalty(flags)").alias("q"),
        compare_and_decide(F.col("a"), F.col("a"), F.col("b"), F.col("b"), F.lit(0.3)).alias("d"),
        F.expr("pm_compare_and_decide(a, a, b, b, 0.3D)").alias("e"),
        F.expr("pm_score_candidate(0.5D, 0.5D, 10D, 1D, 0.2D, 0.1D)").alias("s"),
        signals.score_candidate(*map(F.lit, (0.5, 0.5, 10.0, 1.0, 0.2, 0.1))).alias("t"),
    ).collect()
    assert all(r.p == r.q and r.d == r.e and r.s == r.t for r in rows)
    assert {r.p for r in rows} == {0.0, 0.3}
