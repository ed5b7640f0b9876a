"""SQL names for the column functions.

Each function is written once, as a Column expression. Here its expression is rendered
as SQL text and becomes the body of a temporary SQL function, which the optimizer
inlines: nothing runs in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagemark.functions import html, languages, markdown, signals, urls
from pagemark.functions.decide import compare_and_decide

ONE_TEXT = {
    "visible_text": (html.visible_text, "STRING"),
    "page_text": (html.page_text, "STRING"),
    "drop_regions": (html.drop_regions, "STRING"),
    "density_html": (html.density_html, "STRING"),
    "decode_entities": (html.decode_entities, "STRING"),
    "html_to_markdown": (markdown.html_to_markdown, "STRING"),
    "fix_fragmented_code": (markdown.fix_fragmented_code, "STRING"),
    "clean_markdown": (markdown.clean_markdown, "STRING"),
    "len_text": (signals.len_text, "INT"),
    "len_norm": (signals.len_norm, "DOUBLE"),
    "word_count": (signals.word_count, "INT"),
    "heading_count": (signals.heading_count, "INT"),
    "paragraph_count": (signals.paragraph_count, "INT"),
    "item_count": (signals.item_count, "INT"),
    "structure": (signals.structure, "INT"),
    "link_quality": (signals.link_quality, "DOUBLE"),
    "freshness": (signals.freshness, "DOUBLE"),
    "word_ngrams": (signals.word_ngrams, "ARRAY<STRING>"),
    "strip_tracking": (urls.strip_tracking, "STRING"),
    "redirect_key": (urls.redirect_key, "STRUCT<host: STRING, path: STRING>"),
    "sanitize_filename": (urls.sanitize_filename, "STRING"),
    "redact_tokens": (urls.redact_tokens, "STRING"),
    "lang_from_class": (languages.lang_from_class, "STRING"),
    "normalize_language": (languages.normalize_language, "STRING"),
    "detect_code_language": (languages.detect_code_language, "STRING"),
}
TWO_TEXTS = {
    "density": (signals.density, "DOUBLE"),
    "semantic_overlap": (signals.semantic_overlap, "DOUBLE"),
    "resolve_url": (urls.resolve_url, "STRING"),
    "same_origin": (urls.same_origin, "BOOLEAN"),
    "was_redirected": (urls.was_redirected, "BOOLEAN"),
    "normalize_links": (urls.normalize_links, "STRING"),
}
SCORE_ARGS = ("len_norm", "density", "structure", "freshness", "link_quality", "penalty")

_LITERAL = r"'(?:[^'\\]|\\.)*'"
_OPERATOR = r"(?<![\w`])(>=|<=|<=>|!=|>|<|=|\+|-|\*|/|%|!|and|or|in)\("


def sql_text(column: Column) -> str:
    """SQL for a Column; operators, shown in call form, need quoted names."""
    shown = re.fullmatch(r"(?s)Column<'(.*)'>", str(column)).group(1)
    return re.sub(
        f"({_LITERAL})|{_OPERATOR}",
        lambda m: m.group(1) or f"`{m.group(2)}`(",
        shown,
        flags=re.S,
    )


def register_sql(spark: SparkSession, prefix: str = "pm_") -> list[str]:
    """Create a temporary SQL function per column function; gives their names."""
    def create(name: str, args: str, returns: str, body: Column) -> str:
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) "
            f"RETURNS {returns} RETURN {sql_text(body)}"
        )
        return prefix + name

    a, b = F.col("a"), F.col("b")
    names = [
        create(name, "a STRING", returns, function(a))
        for name, (function, returns) in ONE_TEXT.items()
    ]
    names += [
        create(name, "a STRING, b STRING", returns, function(a, b))
        for name, (function, returns) in TWO_TEXTS.items()
    ]
    score = signals.score_candidate(*(F.col(name) for name in SCORE_ARGS))
    args = ", ".join(f"{name} DOUBLE" for name in SCORE_ARGS)
    flags = "STRUCT<" + ", ".join(
        f"{name}: BOOLEAN" for name in signals.PENALIZED) + ", error: STRING>"
    decision = compare_and_decide(*(F.col(n) for n in ("text_a", "html_a", "text_b", "html_b", "penalty")))
    texts = ", ".join(f"{n} STRING" for n in ("text_a", "html_a", "text_b", "html_b"))
    returns = spark.range(1).select(
        *(F.lit("").alias(n) for n in ("text_a", "html_a", "text_b", "html_b")),
        F.lit(0.0).alias("penalty"),
    ).select(decision.alias("d")).schema["d"].dataType.simpleString()
    return [
        *names, create("score_candidate", args, "DOUBLE", score),
        create("blocker_penalty", f"flags {flags}", "DOUBLE", signals.blocker_penalty(F.col("flags"))),
        create("compare_and_decide", f"{texts}, penalty DOUBLE", returns, decision),
    ]
