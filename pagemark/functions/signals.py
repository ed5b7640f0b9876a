"""Content signals, n-gram overlap and the candidate score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemark.dialect import (
    BLOCKER_PENALTY, DATE_PATTERNS, MAX_TEXT_LEN, WEIGHT_DENSITY, WEIGHT_FRESHNESS,
    WEIGHT_LEN, WEIGHT_LINKS, WEIGHT_STRUCTURE, WORDS_RE,
)
from pagemark.functions.arrays import let, reused
from pagemark.functions.html import count_words

HEADING_OPEN, PARAGRAPH_OPEN, ITEM_OPEN = "(?i)<h[1-6]", "(?i)<p>", "(?i)<li>"
HREF_VALUE = 'href="([^"]+)"'


def _known(value: Column) -> Column:
    """A missing text or page counts as an empty one in every signal."""
    return F.coalesce(value, F.lit(""))


def len_text(text: Column, cap: int = MAX_TEXT_LEN) -> Column:
    return F.least(F.length(_known(text)), F.lit(cap))


def len_norm(text: Column, cap: int = MAX_TEXT_LEN) -> Column:
    return len_text(text, cap) / F.lit(cap)


def word_count(text: Column) -> Column:
    return count_words(_known(text))


def heading_count(html: Column) -> Column:
    return F.regexp_count(_known(html), F.lit(HEADING_OPEN))


def paragraph_count(html: Column) -> Column:
    """Counts bare ``<p>`` only, as the score was calibrated on it."""
    return F.regexp_count(_known(html), F.lit(PARAGRAPH_OPEN))


def item_count(html: Column) -> Column:
    """Counts bare ``<li>`` only."""
    return F.regexp_count(_known(html), F.lit(ITEM_OPEN))


def density(text: Column, html: Column) -> Column:
    """Words per block, scaled to 0..1."""
    blocks = heading_count(html) + paragraph_count(html) + item_count(html)
    per_block = word_count(text) / F.greatest(blocks, F.lit(1))
    return F.least(per_block / F.lit(100), F.lit(1.0))


def structure(html: Column) -> Column:
    return F.least(heading_count(html) * 2 + item_count(html), F.lit(50))


@reused
def link_quality(html: Column) -> Column:
    """Share of double-quoted ``href`` values that are absolute."""
    return let(
        F.regexp_extract_all(_known(html), F.lit(HREF_VALUE), F.lit(1)),
        lambda links: F.when(F.size(links) == 0, 0.0).otherwise(
            F.size(F.filter(links, lambda u: u.startswith("http"))) / F.size(links)
        ),
    )


def freshness(text: Column) -> Column:
    head = F.substring(_known(text), 1, 500)
    dated = head.rlike(DATE_PATTERNS[0])
    for pattern in DATE_PATTERNS[1:]:
        dated = dated | head.rlike(pattern)
    return F.when(dated, 1.0).otherwise(0.0)


@reused
def signals(text: Column, html: Column) -> Column:
    """All signals of a candidate as one struct; each count is taken once."""
    def build(c: Column) -> Column:
        blocks = c["headings"] + c["paragraphs"] + c["lists"]
        per_block = c["words"] / F.greatest(blocks, F.lit(1))
        return F.struct(
            c["len_text"].alias("len_text"),
            (c["len_text"] / F.lit(MAX_TEXT_LEN)).alias("len_norm"),
            c["words"].alias("word_count"),
            F.least(per_block / F.lit(100), F.lit(1.0)).alias("density"),
            F.least(c["headings"] * 2 + c["lists"], F.lit(50)).alias("structure"),
            c["link_quality"].alias("link_quality"),
            c["freshness"].alias("freshness"),
            c["headings"].alias("headings"),
            c["lists"].alias("lists"),
        )

    def measure(s: Column) -> Column:
        return F.struct(
            len_text(s["text"]).alias("len_text"), count_words(s["text"]).alias("words"),
            heading_count(s["html"]).alias("headings"),
            paragraph_count(s["html"]).alias("paragraphs"),
            item_count(s["html"]).alias("lists"),
            link_quality(s["html"]).alias("link_quality"),
            freshness(s["text"]).alias("freshness"),
        )

    inputs = F.struct(_known(text).alias("text"), _known(html).alias("html"))
    return let(let(inputs, measure), build)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS_RE), F.lit(0))


NGRAM_SIZES = (1, 2, 3)


def ngrams_of(words_: Column, sizes: tuple[int, ...] = NGRAM_SIZES) -> Column:
    """Set of all n-grams of an array of words, joined by a space."""
    def grams(ws: Column, n: int) -> Column:
        if n == 1:
            return ws
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n))
        made = F.transform(
            starts, lambda i: F.concat_ws(" ", *(F.get(ws, i + k) for k in range(n)))
        )
        return F.coalesce(made, F.array().cast("array<string>"))

    return let(words_, lambda ws: F.array_distinct(F.concat(*(grams(ws, n) for n in sizes))))


@reused
def word_ngrams(text: Column, sizes: tuple[int, ...] = NGRAM_SIZES) -> Column:
    """Set of all word n-grams of the given sizes, joined by a space."""
    return ngrams_of(words(text), sizes)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order; a missing text has none."""
    return F.transform(words(_known(text)), lambda w: F.xxhash64(w))


def hashed_grams(ws: Column, n: int) -> Column:
    """Set of the n-grams of an array of word hashes, as hashes chained from them."""
    if n == 1:
        return F.array_distinct(ws)
    starts = F.sequence(F.lit(0), F.size(ws) - n)
    made = F.transform(starts, lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(n))))
    return F.when(F.size(ws) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<bigint>"))


def gram_counts(a: Column, b: Column) -> Column:
    """Distinct n-grams of two arrays of word hashes: those of each, and those of both."""
    def counts(ws: Column, n: int) -> Column:
        # grams of other sizes are other grams, so one size after the other is enough
        return let(
            F.struct(hashed_grams(ws["a"], n).alias("a"), hashed_grams(ws["b"], n).alias("b")),
            lambda g: F.struct(F.size(g["a"]).alias("a"), F.size(g["b"]).alias("b"),
                               F.size(F.array_intersect(g["a"], g["b"])).alias("shared")),
        )

    def summed(all_: Column) -> Column:
        return F.struct(*(sum((all_[f"n{size}"][c] for size in NGRAM_SIZES), F.lit(0)).alias(c)
                          for c in ("a", "b", "shared")))

    both = F.struct(a.alias("a"), b.alias("b"))
    return let(let(both, lambda ws: F.struct(*(counts(ws, n).alias(f"n{n}") for n in NGRAM_SIZES))), summed)


@reused
def semantic_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the two n-gram sets; 0 if either is empty or missing.

    Sets hold 64-bit hashes, chained from those of the words, and only those of one size at
    a time: a long page costs some tens of bytes a word, and no string for each gram. Two
    grams of a pair of a million words share a hash with a chance of about one in a million.
    """
    def jaccard(n: Column) -> Column:
        return F.when((n["a"] == 0) | (n["b"] == 0), 0.0).otherwise(n["shared"] / (n["a"] + n["b"] - n["shared"]))

    return let(gram_counts(word_hashes(a), word_hashes(b)), jaccard)


def score_candidate(
    len_norm_: Column, density_: Column, structure_: Column, freshness_: Column,
    link_quality_: Column, penalty: Column | float = 0.0,
) -> Column:
    """Weighted sum minus the penalty, kept within 0..1."""
    richness = F.least(structure_ / F.lit(50), F.lit(1.0))
    total = (
        F.lit(WEIGHT_LEN) * len_norm_
        + F.lit(WEIGHT_DENSITY) * density_
        + F.lit(WEIGHT_STRUCTURE) * richness
        + F.lit(WEIGHT_FRESHNESS) * freshness_
        + F.lit(WEIGHT_LINKS) * link_quality_
    )
    penalty = F.lit(penalty) if isinstance(penalty, float) else penalty
    return F.least(F.greatest(total - penalty, F.lit(0.0)), F.lit(1.0))


def score_of(s: Column, penalty: Column | float = 0.0) -> Column:
    """``score_candidate`` on a ``signals`` struct."""
    return score_candidate(
        s["len_norm"], s["density"], s["structure"], s["freshness"], s["link_quality"], penalty
    )


PENALIZED = ("login_required", "paywall", "captcha", "cross_origin_iframe", "content_too_thin",
             "csp_blocked")


def blocker_penalty(flags: Column) -> Column:
    """Penalty if any flag is set; a failed probe counts as one."""
    hit = F.coalesce(flags["error"], F.lit("")) != ""
    for name in PENALIZED:
        hit = hit | F.coalesce(flags[name], F.lit(False))
    return F.when(hit, BLOCKER_PENALTY).otherwise(0.0)
