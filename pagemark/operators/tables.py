"""Pages and Markdown as tables: tokens, extractions, code, links, fragments.

All of these are generators over one row, so none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemark.functions import extract, html, languages, markdown, urls


def tokenize_html(pages: DataFrame, source: str = "html") -> DataFrame:
    """One row per tag, text, comment or raw block; concatenated they give the page."""
    others = [c for c in pages.columns if c != source]
    exploded = pages.select(*others, F.posexplode(html.token_array(F.col(source))).alias("pos", "tok"))
    tok = F.col("tok")
    return exploded.select(
        "*", html.token_kind(tok).alias("kind"), html.token_tag(tok).alias("tag"),
        html.token_attrs(tok).alias("attrs"),
    )


def extractions(pages: DataFrame, source: str = "html") -> DataFrame:
    """One row per page and extraction method that succeeded."""
    others = [c for c in pages.columns if c != source]
    return pages.select(
        *others, F.explode(extract.all_extractions(F.col(source))).alias("e")
    ).select(*others, "e.*")


def pick_extraction(pages: DataFrame, source: str = "html") -> DataFrame:
    """The most trusted extraction of each page; pages without one drop out."""
    others = [c for c in pages.columns if c != source]
    best = F.array_compact(F.array(extract.best_extraction(F.col(source))))
    return pages.select(*others, F.explode(best).alias("e")).select(*others, "e.*")


def iframe_inventory(pages: DataFrame) -> DataFrame:
    others = [c for c in pages.columns if c != "html"]
    return pages.select(
        *others, F.posexplode(extract.iframes(F.col("html"), F.col("url"))).alias("pos", "i")
    ).select(*others, "pos", "i.src", "i.sameOrigin")


def code_blocks(pages: DataFrame, source: str = "html") -> DataFrame:
    """Each ``pre`` with a ``code`` in it: language from its classes, and the code."""
    others = [c for c in pages.columns if c != source]
    pre = F.filter(
        markdown.pre_elements(html.protect(F.col(source))),
        lambda p: p.rlike(r"(?i)<code[\s/>]"),
    )
    return pages.select(*others, F.posexplode(pre).alias("pos", "pre")).select(
        *others, "pos", markdown.lang_of(F.col("pre")).alias("lang"),
        markdown.code_of(F.col("pre")).alias("code"),
    )


def code_fragments(table: DataFrame, source: str = "markdown") -> DataFrame:
    """Numbered inline code with the numbers removed and its detected language."""
    others = [c for c in table.columns if c != source]
    cut = table.select(
        *others, F.posexplode(markdown.fragments(F.col(source))).alias("pos", "fragment")
    ).select(*others, "pos", markdown.fragment_code(F.col("fragment")).alias("code"))
    return cut.withColumn("lang", languages.detect_code_language(F.col("code")))


def link_table(table: DataFrame, source: str = "markdown", base: str = "url") -> DataFrame:
    """Links of Markdown text with their cleaned URLs."""
    others = [c for c in table.columns if c != source]
    links = F.filter(urls.link_pieces(F.col(source)), urls.is_link)
    out = table.select(*others, F.posexplode(links).alias("pos", "link")).select(
        *others, "pos", urls.link_text(F.col("link")).alias("text"),
        urls.link_url(F.col("link")).alias("link_url"),
    )
    return out.withColumn("clean_url", urls.clean_link_url(F.col(base), F.col("link_url")))


def normalize_languages(table: DataFrame, column: str = "lang") -> DataFrame:
    """Canonical language names by a join with the alias table (a fixed, tiny side)."""
    alias = languages.lang_alias(table.sparkSession).select(
        F.col("alias").alias(column), F.col("lang").alias("_canonical")
    )
    joined = table.join(F.broadcast(alias), column, "left")
    return joined.withColumn(column, F.coalesce("_canonical", column)).drop("_canonical")
