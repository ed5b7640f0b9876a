"""Main-content extraction of one page, in several ways.

Every extractor gives one struct (see ``EXTRACTION``) or NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemark.dialect import ARTICLE_TYPES, CONFIDENCE, MIN_ARTICLE_CHARS
from pagemark.functions.arrays import let, reused, strict_json
from pagemark.functions.html import (
    attr, count_words, density_html, document_title, first_subtree, fragment_text,
    keep_regions, protect,
)
from pagemark.functions.urls import origin, resolve_url

EXTRACTION = (
    "struct<method:string,confidence:double,title:string,html:string,text:string,"
    "byline:string,excerpt:string>"
)
JSONLD = (
    r"""(?is)<script(?=[^>]*\stype\s*=\s*["']?application/ld\+json["'\s>])[^>]*>(.*?)</script\s*>"""
)


def open_tag(name: str) -> str:
    return rf"(?i)<{name}(?:[\s/][^>]*)?>"


def open_with(attribute: str, value: str) -> str:
    return (
        rf"""(?i)<[a-zA-Z][a-zA-Z0-9:-]*\s(?:[^>]*[\s"'])?{attribute}\s*=\s*"""
        rf"""(?:"{value}"|'{value}'|{value}(?=[\s>]))[^>]*>"""
    )


def _extraction(method: str, title: Column, html: Column, text: Column,
                byline: Column | None = None, excerpt: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(method).alias("method"), F.lit(CONFIDENCE[method]).alias("confidence"),
        title.alias("title"), html.alias("html"), text.alias("text"),
        (none if byline is None else byline).alias("byline"),
        (none if excerpt is None else excerpt).alias("excerpt"),
    ).cast(EXTRACTION)


@reused
def jsonld_extraction(html: Column) -> Column:
    """First schema.org article of a page's JSON-LD blocks with a long enough body."""
    def items(script: Column) -> Column:
        return let(
            strict_json(script),
            lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)),
        )

    def field(item: Column, path: str) -> Column:
        return F.try_variant_get(item, path, "string")

    def fields(item: Column) -> Column:
        return F.struct(
            field(item, '$["@type"]').alias("type"), field(item, "$.headline").alias("headline"),
            field(item, "$.name").alias("name"), field(item, "$.articleBody").alias("body"),
            field(item, "$.author.name").alias("author"),
            field(item, "$.description").alias("description"),
        )

    def build(a: Column) -> Column:
        title = F.coalesce(F.nullif(a["headline"], F.lit("")), a["name"])
        # a missing title is written out the way a template string does it
        content = F.concat(
            F.lit("<article><h1>"), F.coalesce(title, F.lit("undefined")), F.lit("</h1><p>"),
            a["body"], F.lit("</p></article>"),
        )
        return F.when(
            a.isNotNull(),
            _extraction("schema", title, content, a["body"], F.nullif(a["author"], F.lit("")),
                        F.nullif(a["description"], F.lit(""))),
        )

    scripts = F.regexp_extract_all(html, F.lit(JSONLD), F.lit(1))
    found = F.filter(
        F.flatten(F.transform(scripts, lambda s: F.transform(items(s), fields))),
        lambda a: a["type"].isin(*ARTICLE_TYPES) & (F.length(a["body"]) > MIN_ARTICLE_CHARS),
    )
    return F.when(F.contains(F.lower(html), F.lit("ld+json")), let(F.get(found, F.lit(0)), build))


def _long_enough(inner: Column, build) -> Column:
    """``build(text)`` if the text of ``inner`` is long enough, else NULL."""
    return let(
        F.when(inner.isNotNull(), fragment_text(inner)),
        lambda text: F.when(F.length(text) > MIN_ARTICLE_CHARS, build(text)),
    )


@reused
def microdata_extraction(html: Column) -> Column:
    """Element marked ``itemprop="articleBody"``."""
    def first(h: Column, prop: str) -> Column:
        return fragment_text(first_subtree(h, open_with("itemprop", prop)))

    def build(h: Column) -> Column:
        title = F.coalesce(first(h, "headline"), document_title(h))
        byline = F.nullif(first(h, "author"), F.lit(""))
        return let(
            first_subtree(h, open_with("itemprop", "articleBody")),
            lambda inner: _long_enough(
                inner, lambda text: _extraction("schema", title, inner, text, byline)
            ),
        )

    return F.when(F.contains(F.lower(html), F.lit("itemprop")), let(protect(html), build))


# (landmark the search is limited to, element taken, what such a page contains), in
# order of precedence
LANDMARKS = (
    (open_tag("main"), open_tag("article"), "<main"),
    (None, open_tag("main"), "<main"),
    (open_with("role", "main"), open_tag("article"), "role"),
    (None, open_with("role", "main"), "role"),
    (None, open_tag("article"), "<article"),
    (None, open_with("role", "article"), "role"),
)
HEADING = r"(?is)<h1(?:\s[^>]*)?>(.*?)(?:</h1\s*>|\z)"


@reused
def landmark_extraction(html: Column) -> Column:
    """First semantic landmark, in order of precedence, whose text is long enough."""
    none = F.lit(None).cast("string")
    selectors = F.array(*(
        F.struct((none if within is None else F.lit(within)).alias("within"),
                 F.lit(element).alias("element"), F.lit(needle).alias("needle"))
        for within, element, needle in LANDMARKS
    ))

    def build(h: Column) -> Column:
        def take(inner: Column) -> Column:
            title = F.when(
                inner.rlike(HEADING), fragment_text(F.regexp_extract(inner, HEADING, 1))
            ).otherwise(document_title(h))
            return _long_enough(inner, lambda text: _extraction("semantic", title, inner, text))

        def attempt(selector: Column) -> Column:
            scope = F.when(selector["within"].isNull(), h).when(
                F.rlike(h, selector["within"]), keep_regions(h, selector["within"])
            )
            return let(first_subtree(scope, selector["element"]), take)

        # one selector after the other, until one succeeds
        possible = let(
            F.lower(h), lambda low: F.filter(selectors, lambda s: F.contains(low, s["needle"]))
        )
        return F.aggregate(
            possible,
            F.lit(None).cast(EXTRACTION),
            lambda found, s: F.when(found.isNotNull(), found).otherwise(attempt(s)),
        )

    return let(protect(html), build)


@reused
def density_extraction(html: Column, min_chars: int = 1) -> Column:
    """Main content by text density; works on any page that has content."""
    def build(inner: Column) -> Column:
        return let(
            fragment_text(inner),
            lambda text: F.when(
                F.length(text) >= min_chars,
                _extraction("readability", document_title(html), inner, text),
            ),
        )

    return let(density_html(html), build)


@reused
def schema_extraction(html: Column) -> Column:
    return F.coalesce(jsonld_extraction(html), microdata_extraction(html))


@reused
def best_extraction(html: Column) -> Column:
    """First extractor that succeeds; later ones are not evaluated then."""
    return F.coalesce(
        schema_extraction(html), landmark_extraction(html), density_extraction(html)
    )


@reused
def all_extractions(html: Column) -> Column:
    """Array of the extractions that succeeded, most trusted first."""
    return F.array_compact(
        F.array(schema_extraction(html), landmark_extraction(html), density_extraction(html))
    )


def successful_methods(html: Column) -> Column:
    """Names of the methods that succeed on a page, most trusted first."""
    return F.transform(all_extractions(html), lambda e: e["method"])


NO_CONTENT = "no content"


@reused
def refetch_extraction(html: Column, min_chars: int = 1) -> Column:
    """Extraction of a re-fetched page with its summary; never NULL."""
    return content_summary(density_html(F.coalesce(html, F.lit(""))), min_chars)


def content_summary(content: Column, min_chars: int = 1) -> Column:
    """Summary of main content that was found already."""
    def summary(s: Column) -> Column:
        ok = F.length(s["text"]) >= min_chars
        return F.struct(
            F.when(ok, s["text"]).otherwise("").alias("text"),
            F.when(ok, s["html"]).otherwise("").alias("html"),
            F.when(ok, F.length(s["text"])).otherwise(0).alias("char_count"),
            F.when(ok, count_words(s["text"])).otherwise(0).alias("word_count"),
            ok.alias("success"),
            F.when(~ok, NO_CONTENT).alias("error"),
        )

    return let(
        content,
        lambda inner: let(
            F.struct(fragment_text(inner).alias("text"), inner.alias("html")), summary
        ),
    )


def capture_stats(text: Column, html: Column) -> Column:
    return F.struct(
        F.length(text).alias("char_count"),
        F.regexp_count(html, F.lit(r"(?i)<h[1-6][\s/>]")).alias("headings"),
        F.regexp_count(html, F.lit(r"(?i)<[uo]l[\s/>]")).alias("lists"),
    )


@reused
def iframes(html: Column, page_url: Column) -> Column:
    """Inventory of a page's iframes with resolved sources."""
    def info(tag: Column) -> Column:
        src = F.coalesce(attr(tag, "src"), F.lit(""))
        resolved = let(src, lambda s: F.struct(
            s.alias("given"), resolve_url(page_url, s).alias("full")))
        return let(
            resolved,
            lambda r: F.struct(
                F.when(r["given"] == "", "").otherwise(r["full"]).alias("src"),
                F.coalesce(origin(r["full"]) == origin(page_url), F.lit(False)).alias("sameOrigin"),
            ),
        )

    tags = F.regexp_extract_all(
        F.regexp_replace(protect(html), r"(?s)<!--.*?(?:-->|\z)", ""),
        F.lit(r"(?i)<iframe(?:\s[^>]*)?>"), F.lit(0),
    )
    return F.when(F.contains(F.lower(html), F.lit("<iframe")), F.transform(tags, info)).otherwise(
        F.array().cast("array<struct<src:string,sameOrigin:boolean>>")
    )
