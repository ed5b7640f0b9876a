"""Comparing the captured and the re-fetched version of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemark.dialect import TIE_THRESHOLD
from pagemark.functions.arrays import let, reused
from pagemark.functions.signals import score_of, semantic_overlap, signals

CAPTURE, REFETCH = "capture", "refetch"


@reused
def compare_and_decide(
    text_a: Column, html_a: Column, text_b: Column, html_b: Column, penalty: Column,
    threshold: float = TIE_THRESHOLD, overlap_weight: float = 0.0,
) -> Column:
    """Decision struct for capture (a) against re-fetch (b).

    The choice is made on unrounded scores; a gap below ``threshold`` is a tie and
    goes to the capture, which is what the user saw. The overlap is reported; it
    enters the scores only if ``overlap_weight`` is set.
    """
    def rounded(c: Column) -> Column:
        # three digits for a report; a tie may end on either side of it
        return F.rint(c * 1000) / 1000

    def side(s: Column, overlap: Column) -> Column:
        return F.struct(
            s["len_text"].alias("len"), rounded(s["density"]).alias("density"),
            rounded(overlap).alias("overlap"),
        )

    def scored(s: Column) -> Column:
        bonus = F.lit(overlap_weight) * s["overlap"] if overlap_weight else F.lit(0.0)
        return let(
            F.struct(
                (score_of(s["a"]) + bonus).alias("a"),
                (score_of(s["b"], penalty) + bonus).alias("b"),
            ),
            lambda score: F.struct(
                F.when(F.abs(score["a"] - score["b"]) < threshold, CAPTURE)
                .when(score["a"] > score["b"], CAPTURE)
                .otherwise(REFETCH).alias("chosen"),
                rounded(score["a"]).alias("score_a"),
                rounded(score["b"]).alias("score_b"),
                rounded(F.abs(score["a"] - score["b"])).alias("score_diff"),
                rounded(s["overlap"]).alias("overlap"),
                side(s["a"], s["overlap"]).alias("signals_a"),
                side(s["b"], s["overlap"]).alias("signals_b"),
                penalty.alias("blocker_penalty"),
            ),
        )

    return let(
        F.struct(
            signals(text_a, html_a).alias("a"), signals(text_b, html_b).alias("b"),
            semantic_overlap(text_a, text_b).alias("overlap"),
        ),
        scored,
    )


def fallback_decision(text_a: Column) -> Column:
    """Decision when only the capture can be used; its length is not capped here."""
    zero = F.lit(0.0)
    return F.struct(
        F.lit(CAPTURE).alias("chosen"), F.lit(1.0).alias("score_a"), zero.alias("score_b"),
        F.lit(1.0).alias("score_diff"), zero.alias("overlap"),
        F.struct(F.length(text_a).alias("len"), zero.alias("density"),
                 zero.alias("overlap")).alias("signals_a"),
        F.struct(F.lit(0).alias("len"), zero.alias("density"),
                 zero.alias("overlap")).alias("signals_b"),
        zero.alias("blocker_penalty"),
    )


