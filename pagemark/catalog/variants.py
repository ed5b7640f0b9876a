"""Tables derived from ``pages`` by fixed rules on ``page_id``.

The crawl table has no captures, fetch log, structured data, code or blockers. These
rules add them row by row, so the derived tables grow with the crawl and the checking
SQL can state the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemark.functions import extract, html
from pagemark.functions.urls import split_url

NOTICE = (
    "This short notice stands where the full article would be and readers will find "
    "the text again once it returns."
)
SHORT_NOTICE = "Only a few words are left here."
LOGIN_MARKUP = (
    '<form action="/login"><p>Please sign in</p><input type="password" name="pw"></form>'
)
PAYWALL_MARKUP = '<div class="paywall-overlay">Subscribe now</div>'
CAPTCHA_MARKUP = '<div class="g-recaptcha"></div>'
IFRAME_MARKUP = '<iframe src="https://embed.example.org/player"></iframe>'
EMPTY_PAGE = "<html><body></body></html>"
ARTICLE_RE = r"(?s)<article>(.*?)</article>"
#: Empty paragraphs that make every fifth capture look sparse, its text being whole.
SPARSE = "<p></p>" * 300


def kind(modulus: int) -> Column:
    return F.col("page_id") % modulus


def article_inner() -> Column:
    return F.regexp_extract("html", ARTICLE_RE, 1)


def page_title() -> Column:
    return html.document_title(F.col("html"))


def _thin(extra: str, notice: str = NOTICE) -> Column:
    return F.lit(f"<html><body><article><p>{notice}</p>{extra}</article></body></html>")


def fetches(pages: DataFrame) -> DataFrame:
    """Fetch log of the crawl: failures, redirects, blockers and normal pages."""
    k = kind(12)
    p = split_url(F.col("url"))
    login = F.concat(p["scheme"], F.lit("://"), p["authority"], F.lit("/login"))
    host = F.when(
        p["authority"].startswith("www."), F.regexp_replace(p["authority"], r"^www\.", "")
    ).otherwise(F.concat(F.lit("www."), p["authority"]))
    path = F.when(p["path"].endswith("/"), F.regexp_replace(p["path"], "/$", "")).otherwise(
        F.concat(p["path"], F.lit("/"))
    )
    body = (
        F.when(k == 0, "")
        .when(k == 3, _thin(LOGIN_MARKUP))
        .when(k == 4, _thin(""))
        .when(k == 5, _thin(PAYWALL_MARKUP))
        .when(k == 6, _thin(CAPTCHA_MARKUP))
        .when(k == 7, _thin(IFRAME_MARKUP))
        .when(k == 8, EMPTY_PAGE)
        .when(k == 9, _thin("", SHORT_NOTICE))
        .otherwise(F.col("html"))
    )
    return pages.select(
        "page_id", "url",
        F.when(k == 1, login)
        .when(k == 2, F.concat(F.lit("https://"), host, path))
        .otherwise(F.col("url")).alias("final_url"),
        F.when(k == 0, 0).when(k == 4, 403).otherwise(200).alias("status_code"),
        F.when(k == 0, "").otherwise("text/html").alias("content_type"),
        body.alias("html"),
        (k != 0).alias("success"),
        F.when(k == 0, "Request timeout").alias("error"),
        fetched_at().alias("fetched_at"),
    )


def fetches_thrice(pages: DataFrame) -> DataFrame:
    """The fetch log with an earlier failure and an earlier page for each of its rows."""
    newest = fetches(pages)
    before = lambda seconds: F.col("fetched_at") - F.make_dt_interval(secs=F.lit(seconds))
    failed = newest.withColumn("success", F.lit(False)).withColumn("error", F.lit("Request timeout")).withColumn(
        "fetched_at", before(9))
    older = newest.withColumn("success", F.lit(True)).withColumn("html", F.lit(
        "<article><h1>Old</h1><p>This is what the page said before.</p></article>")).withColumn("fetched_at", before(4))
    return failed.unionByName(newest).unionByName(older)


def second_fetches(pages: DataFrame) -> DataFrame:
    """Another fetch of each page, before or after the first one, and never at its time."""
    first, own = F.col("page_id") % 20, F.col("page_id") * 7 % 23
    at = F.unix_seconds(captured_at()) + F.when(own == first, 22).otherwise(own)
    return pages.select(
        "page_id", "url", F.col("url").alias("final_url"), F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type"), "html", F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error"), F.timestamp_seconds(at).alias("fetched_at"),
    )


def captured_at() -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))


def fetched_at() -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") + F.col("page_id") % 20)


def fetch_log(pages: DataFrame) -> DataFrame:
    """Three fetches of every URL; the newest is neither always the last row nor a success."""
    attempt = F.col("attempt")
    number = F.col("page_id") + attempt
    ok = number % 4 != 0
    return pages.select("page_id", "url", F.explode(F.array(*map(F.lit, range(3)))).alias("attempt")).select(
        "url", F.col("url").alias("final_url"),
        F.when(ok, F.lit(200) + attempt).otherwise(0).cast("int").alias("status_code"),
        ok.alias("success"), F.when(~ok, "Request timeout").alias("error"),
        F.timestamp_seconds(
            F.lit(1704067200) + F.col("page_id") + (F.col("page_id") * 7 + attempt * 5) % 11
        ).alias("fetched_at"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """What a browser would have captured of each page."""
    picked = pages.withColumnRenamed("html", "page_html").select(
        "page_id", "url", "page_html",
        F.explode(F.array_compact(F.array(extract.best_extraction(F.col("page_html"))))).alias("e"),
    )
    markup = F.when(kind(5) == 3, F.concat("e.html", F.lit(SPARSE))).otherwise(F.col("e.html"))
    meta = F.struct(
        captured_at().alias("captured_at"),
        extract.capture_stats(F.col("e.text"), F.col("e.html")).alias("stats"),
        extract.iframes(F.col("page_html"), F.col("url")).alias("iframe_info"),
        F.array(F.col("e.method")).alias("extraction_methods"),
    )
    return picked.select(
        "page_id", "url", F.col("e.title").alias("title"), markup.alias("html"),
        F.col("e.text").alias("text"), meta.alias("meta"),
    )


def broken_captures(pages: DataFrame) -> DataFrame:
    """Captures of which some lack a required part."""
    k = kind(9)
    stats = F.struct(
        F.when(k != 5, F.length("html")).alias("char_count"), F.lit(1).alias("headings"),
        F.lit(0).alias("lists"),
    )
    meta = F.struct(
        F.when(k != 4, captured_at()).alias("captured_at"), stats.alias("stats"),
        F.array(F.struct(F.when(k != 6, F.col("url")).alias("src"),
                         F.lit(True).alias("sameOrigin"))).alias("iframe_info"),
        F.array(F.lit("semantic")).alias("extraction_methods"),
    )
    return pages.select(
        "page_id",
        F.when(k == 0, F.lit(None).cast("string"))
        .when(k == 7, F.regexp_replace("url", "^https?", "ftp"))
        .otherwise(F.col("url")).alias("url"),
        F.when(k != 1, page_title()).alias("title"),
        F.when(k != 2, F.col("html")).alias("html"),
        F.lit("text").alias("text"),
        F.when(k != 3, meta).alias("meta"),
    )


def capture_json(pages: DataFrame) -> DataFrame:
    """Capture records as JSON text; every tenth is cut off."""
    record = F.to_json(
        F.struct(
            "url", page_title().alias("title"), article_inner().alias("html_extension"),
            F.lit("text").alias("text_extension"),
            F.struct(
                F.date_format(captured_at(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"),
                F.struct(
                    F.length("html").alias("char_count"), F.lit(1).alias("headings"),
                    F.lit(0).alias("lists"),
                ).alias("stats"),
            ).alias("meta"),
        )
    )
    whole = kind(10) != 9
    return pages.select(
        "page_id",
        F.when(whole, record).otherwise(F.substring(record, 1, 40)).alias("value"),
    )


def article_text() -> Column:
    return html.fragment_text(article_inner())


def jsonld_pages(pages: DataFrame) -> DataFrame:
    """Pages whose article is given as JSON-LD, in good and bad shapes."""
    k = kind(5)
    escaped = F.replace(
        F.replace(
            F.replace(F.replace(article_text(), F.lit("\\"), F.lit("\\\\")), F.lit('"'),
                      F.lit('\\"')),
            F.lit("\n"), F.lit(" "),
        ),
        F.lit("</"), F.lit("<\\/"),
    )
    tail = F.concat(
        F.lit('"articleBody":"'), escaped,
        F.lit('","author":{"name":"Author '), F.col("page_id").cast("string"),
        F.lit('"},"description":"About page"}'),
    )
    data = (
        F.when(k == 0, F.concat(F.lit('{"@type":"Article","headline":"Head",'), tail))
        .when(k == 1, F.concat(
            F.lit('[{"@type":"WebPage"},{"@type":"NewsArticle","headline":"News",'), tail,
            F.lit("]")))
        .when(k == 2, F.concat(F.lit('{"@type":"Article","headline":"Bad" '), tail))
        .when(k == 3, F.concat(F.lit('{"@type":"Product","headline":"Thing",'), tail))
        .otherwise(F.concat(F.lit('{"@type":"BlogPosting","headline":"","name":"Post",'), tail))
    )
    page = F.concat(
        F.lit('<html><head><title>Outer</title><script type="application/ld+json">'), data,
        F.lit("</script></head><body><p>Body</p></body></html>"),
    )
    return pages.select("page_id", "url", page.alias("html"))


def microdata_pages(pages: DataFrame) -> DataFrame:
    """Pages whose article is marked with itemprop attributes."""
    page = F.concat(
        F.lit("<html><head><title>Outer title</title></head><body>"),
        F.when(kind(2) == 0, '<h2 itemprop="headline">The headline</h2>').otherwise(""),
        F.lit('<span itemprop="author">Author '), F.col("page_id").cast("string"),
        F.lit('</span><div class="x" itemprop="articleBody"><div>'), article_inner(),
        F.lit("</div></div><div>after</div></body></html>"),
    )
    return pages.select("page_id", "url", page.alias("html"))


LANDMARKS = (
    ("<main><article>", "</article></main>"), ("<main>", "</main>"),
    ('<div role="main"><div>x</div><article>', "</article></div>"),
    ('<div role="main">', "</div>"), ("<article>", "</article>"),
    ('<div role="article">', "</div>"),
)


def landmark_pages(pages: DataFrame) -> DataFrame:
    """Pages whose article sits in each of the landmark shapes in turn."""
    before, after = F.lit(""), F.lit("")
    for i, (opening, closing) in enumerate(LANDMARKS):
        before = F.when(kind(6) == i, opening).otherwise(before)
        after = F.when(kind(6) == i, closing).otherwise(after)
    page = F.concat(
        F.lit("<html><head><title>Outer title</title></head><body><nav>menu</nav>"), before,
        article_inner(), after, F.lit("<footer>foot</footer></body></html>"),
    )
    return pages.select("page_id", "url", page.alias("html"))


IFRAME_SOURCES = (
    ' src="/embed/1"', ' src="https://embed.example.org/x?a=1&amp;b=2"', "",
    ' width=3 src="about:blank"',
)


def iframe_pages(pages: DataFrame) -> DataFrame:
    """Pages with one to four iframes."""
    page = F.col("html")
    for i, source in enumerate(IFRAME_SOURCES):
        page = F.when(
            kind(4) >= i, F.concat(page, F.lit(f"<iframe{source}></iframe>"))
        ).otherwise(page)
    return pages.select("page_id", "url", page.alias("html"))


CODE_CLASSES = (
    "lang-py", "language-javascript", "s-lang-ts", "hljs sql", "prism-bash", "lang-c++",
    "code-block", "syntax-yml", "plain",
)


def code_pages(pages: DataFrame) -> DataFrame:
    """Pages with two code blocks: class on ``code`` and class on ``pre``."""
    cls = F.lit("")
    for i, name in enumerate(CODE_CLASSES):
        cls = F.when(kind(len(CODE_CLASSES)) == i, name).otherwise(cls)
    page = F.concat(
        F.lit("<div><p>Before</p><pre><code class=\""), cls, F.lit("\">x = "),
        F.col("page_id").cast("string"), F.lit("\n  y &lt; 2</code></pre><p>Between</p><pre class=\""),
        cls, F.lit("\"><code># "), F.col("url"), F.lit("</code></pre><pre>no code</pre></div>"),
    )
    return pages.select("page_id", "url", cls.alias("class"), page.alias("html"))


LINK_SHAPES = (
    "/root/{}", "leaf?x=1&utm_source=a", "../up/{}", "#part", "mailto:a@example.org",
    "?q={}&ref=z", "//cdn.example.com/lib.js", "https://other.example.com/a?gclid=1&k=v",
    "./here/", "http://plain.example.com",
)


def link_markdown(pages: DataFrame) -> DataFrame:
    """Markdown with one link of every shape per page."""
    pieces = []
    for i, shape in enumerate(LINK_SHAPES):
        bang = "!" if i % 4 == 2 else ""
        before, _, after = shape.partition("{}")
        number = F.col("page_id").cast("string") if "{}" in shape else F.lit("")
        pieces += [F.lit(f"word {bang}[text {i}]({before}"), number, F.lit(f"{after}) ")]
    return pages.select("page_id", "url", F.concat(*pieces, F.lit("[open")).alias("markdown"))


def messy_urls(pages: DataFrame) -> DataFrame:
    """Page URLs with more parameters: tracking, blank, repeated and encoded ones."""
    bare = F.split_part("url", F.lit("#"), F.lit(1))
    sep = F.when(bare.contains("?"), "&").otherwise("?")
    url = F.concat(
        bare, sep, F.lit("b=1&empty=&a=x%20y&a=z&gclid="), F.col("page_id").cast("string"),
        F.lit("&UTM_SOURCE=keep&api_key=k"), F.col("page_id").cast("string"), F.lit("#frag"),
    )
    return pages.select("page_id", url.alias("url"))


# one snippet per detection rule, and three whose label is not what one expects
SNIPPETS = (
    "<div class=x>", "<?xml version=1?>", "fn main() { let mut x = 1; }", "const x = 1;",
    "x: string", "import os", "#!/bin/bash", '{"a": 1}', "p { color: red }", "select 1",
    "a\n  - item", "package main", "use std::io;", "System.out.println(1)",
    "#include <stdio.h>", "std::cout", "namespace X", "puts 1", "$x = 1", "func f -> Int",
    "fun f", "# T\n[a](b)", "RUN make", "public class A", "FROM ubuntu", "key:",
)


def snippets(documents: DataFrame) -> DataFrame:
    """Document texts, each opened by one of the snippets."""
    code = F.lit("")
    for i, snippet in enumerate(SNIPPETS):
        code = F.when(F.col("doc_id") % len(SNIPPETS) == i, snippet).otherwise(code)
    return documents.select("doc_id", F.concat(code, F.lit("\n"), F.col("text")).alias("code"))


def numbered_markdown(documents: DataFrame) -> DataFrame:
    """Document texts as numbered inline code inside a sentence."""
    body = F.replace(F.replace(F.col("text"), F.lit("`"), F.lit("")), F.lit("\n"), F.lit("\n27"))
    md = F.concat(
        F.lit("See `inline` and `1"), body, F.lit("` then `404` and `3const x = "),
        F.col("doc_id").cast("string"), F.lit(";` end"),
    )
    return documents.select("doc_id", md.alias("markdown"))


def gappy_markdown(documents: DataFrame) -> DataFrame:
    """Document texts with runs of blank lines."""
    md = F.concat(
        F.lit("\n\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n\n\t\n")), F.lit("\n\n\n")
    )
    return documents.select("doc_id", md.alias("markdown"))
