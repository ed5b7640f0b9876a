"""Blocks that repeat over the pages of a host, which are template and not content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemark.dialect import SPACE_RE, TAG_RE
from pagemark.functions import html
from pagemark.functions.urls import url_host


def _block_text(block: Column) -> Column:
    bare = F.regexp_replace(block["html"], TAG_RE, "")
    return html.trim_space(F.regexp_replace(html.decode_entities(bare), SPACE_RE, " "))


def page_blocks(pages: DataFrame) -> DataFrame:
    """Non-empty text blocks of each page."""
    others = [c for c in pages.columns if c != "html"]
    blocks = html.text_blocks(html.protect(F.col("html")))
    text = _block_text(F.col("b"))
    return pages.select(*others, F.posexplode(blocks).alias("block", "b")).select(
        *others, "block", "b.tag", "b.words", "b.link_words", "b.inside", text.alias("text")
    )


def template_blocks(pages: DataFrame, min_pages: int, page: str = "page_id") -> DataFrame:
    """(host, text) of blocks found on at least ``min_pages`` pages of their host.

    Grouping is by the block text, so a host with many pages spreads over partitions.
    """
    blocks = page_blocks(pages).select(url_host(F.col("url")).alias("host"), "text", page)
    return (
        blocks.groupBy("host", "text")
        .agg(F.countDistinct(page).alias("n_pages"))
        .filter(F.col("n_pages") >= min_pages)
    )


def block_counts(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """(host, text_hash, n_pages) of all blocks of a crawl, to be stored and added to."""
    blocks = page_blocks(pages.select(page, "url", "html")).select(
        url_host(F.col("url")).alias("host"), F.xxhash64("text").alias("text_hash"), page)
    return blocks.groupBy("host", "text_hash").agg(F.countDistinct(page).alias("n_pages"))


def added_counts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored counts with those of a new crawl; the pages of the earlier ones are not read again.

    A page that was crawled twice counts twice.
    """
    return stored.unionByName(new).groupBy("host", "text_hash").agg(F.sum("n_pages").alias("n_pages"))


def drop_templates(pages: DataFrame, counts: DataFrame, min_pages: int, page: str = "page_id",
                   column: str = "content") -> DataFrame:
    """All columns and the main content without blocks that ``counts`` has on ``min_pages`` pages or more.

    Pages need different values of ``page``; a null one is left with its template. Only hosts and
    hashes of blocks meet the counts; pages then get back the places of the blocks to drop.
    Counts come from a table, and with them a shuffle of their own, so adaptive execution
    can split a block that stands on all pages of a large host.
    """
    kept = html.content_blocks(html.text_blocks(html.protect(F.col("html"))))
    hashes = F.transform(kept, lambda b: F.xxhash64(_block_text(b)))
    blocks = pages.select(page, url_host(F.col("url")).alias("host"), F.posexplode(hashes).alias("_at", "text_hash"))
    known = counts.filter(F.col("n_pages") >= min_pages).select("host", "text_hash")
    drops = blocks.join(known, ["host", "text_hash"], "left_semi").groupBy(page).agg(
        F.collect_set("_at").alias("_drops"))
    left = F.filter(kept, lambda b, i: ~F.coalesce(F.array_contains("_drops", i), F.lit(False)))
    return pages.join(drops, page, "left").withColumn(column, html.blocks_html(left)).drop("_drops")


def without_templates(pages: DataFrame, min_pages: int, page: str = "page_id") -> DataFrame:
    """(page, url, html): the main content of each page without the blocks of its template.

    The blocks that the density rules keep meet the template blocks of their host; a page
    with nothing left has empty HTML. The hash of the text is a second join key, so that
    adaptive execution can split a block that stands on all pages of a large host.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_text_hash", F.xxhash64("text"))

    kept = html.content_blocks(html.text_blocks(html.protect(F.col("html"))))
    blocks = pages.select(page, url_host(F.col("url")).alias("host"), F.posexplode(kept).alias("at", "b"))
    blocks = blocks.withColumn("text", _block_text(F.col("b")))
    templates = template_blocks(pages, min_pages, page).select("host", "text")
    own = keyed(blocks).join(keyed(templates), ["host", "text", "_text_hash"], "left_anti")
    ordered = own.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("at", "b"))).alias("blocks"))
    rendered = ordered.select(page, html.blocks_html(F.col("blocks.b")).alias("html"))
    return pages.select(page, "url").join(rendered, page, "left").select(
        page, "url", F.coalesce("html", F.lit("")).alias("html")
    )
