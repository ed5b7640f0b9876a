"""Every registered query: ``(spark, directory) -> DataFrame``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemark.catalog import variants
from pagemark.functions import (
    blockers, decide, extract, html, languages, markdown, signals, urls,
)
from pagemark.functions.sql import register_sql
from pagemark.operators import overlap, tables, templates
from pagemark.plans import ingest as job
from pagemark.sources import sinks, validate
from pagemark.sources.tables import parse_captures, shape_fetches
from pagemark.sources.tables import read_pages as read_pages_table
from pagemark.streaming import ingest as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _partitions(spark: SparkSession) -> int | None:
    """Set by whoever runs the queries on tables of one small file, as the bench does."""
    return int(spark.conf.get("pagemark.partitions", "0")) or None


def read_pages(spark: SparkSession, directory: str) -> DataFrame:
    return read_pages_table(spark, directory, _partitions(spark))


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    documents = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text")
    partitions = _partitions(spark)
    return documents.repartition(partitions, "doc_id") if partitions else documents


# --------------------------------------------------------------- sources, sinks

@query
def pages_read(spark, directory):
    return read_pages(spark, directory).select(
        "page_id", "url", F.length("html").alias("n_chars")
    )


@query
def captures_parsed(spark, directory):
    parsed = parse_captures(variants.capture_json(read_pages(spark, directory)))
    return parsed.select(
        "page_id", "url", "title", F.length("html").alias("html_chars"), "text",
        F.unix_seconds("meta.captured_at").alias("captured_at"),
        F.col("meta.stats.char_count").alias("char_count"),
        F.col("_corrupt").isNotNull().alias("corrupt"),
    )


@query
def fetches_shaped(spark, directory):
    shaped = shape_fetches(variants.fetches(read_pages(spark, directory)))
    return shaped.select(
        "page_id", "url", "final_url", "status_code", "content_type", "success", "error",
        F.length("html").alias("html_chars"),
    )


@query
def captures_validated(spark, directory):
    flagged = validate.flag_captures(variants.broken_captures(read_pages(spark, directory)))
    return flagged.select("page_id", "url", "reason")


@query
def result_files(spark, directory):
    captures = variants.captures(read_pages(spark, directory))
    return sinks.with_filenames(captures).select("page_id", "url", "host", "filename")


@query
def html_backups(spark, directory):
    pages = read_pages(spark, directory)
    titled = pages.withColumn("title", variants.page_title())
    valid, _ = validate.validate_captures(variants.broken_captures(pages))
    return sinks.html_backup(titled, valid).select(
        "page_id", "url", "filename", F.length("html").alias("html_chars")
    )


# ------------------------------------------------------------ HTML and extraction

@query
def html_tokens(spark, directory):
    return tables.tokenize_html(read_pages(spark, directory)).select(
        "page_id", "pos", "tok", "kind", "tag", "attrs"
    )


@query
def regions_dropped(spark, directory):
    return read_pages(spark, directory).select(
        "page_id", html.drop_regions(F.col("html")).alias("html")
    )


@query
def visible_text(spark, directory):
    return read_pages(spark, directory).select(
        "page_id", html.page_text(F.col("html")).alias("text")
    )


def _extraction_rows(pages: DataFrame, extraction) -> DataFrame:
    found = pages.select("page_id", F.explode(F.array_compact(F.array(extraction))).alias("e"))
    return found.select("page_id", "e.*")


@query
def jsonld_articles(spark, directory):
    pages = variants.jsonld_pages(read_pages(spark, directory))
    return _extraction_rows(pages, extract.jsonld_extraction(F.col("html")))


@query
def microdata_articles(spark, directory):
    pages = variants.microdata_pages(read_pages(spark, directory))
    return _extraction_rows(pages, extract.microdata_extraction(F.col("html")))


@query
def landmark_articles(spark, directory):
    pages = read_pages(spark, directory)
    return _extraction_rows(pages, extract.landmark_extraction(F.col("html")))


@query
def landmark_selectors(spark, directory):
    pages = variants.landmark_pages(read_pages(spark, directory))
    return _extraction_rows(pages, extract.landmark_extraction(F.col("html")))


@query
def density_articles(spark, directory):
    pages = read_pages(spark, directory)
    return _extraction_rows(pages, extract.density_extraction(F.col("html")))


@query
def density_blocks(spark, directory):
    return templates.page_blocks(read_pages(spark, directory)).select(
        "page_id", "block", "tag", "words", "link_words", "inside", "text"
    )


@query
def template_blocks(spark, directory):
    return templates.template_blocks(read_pages(spark, directory), min_pages=2)


@query
def template_free_pages(spark, directory):
    return templates.without_templates(read_pages(spark, directory), min_pages=2)


@query
def refetch_summaries(spark, directory):
    fetches = variants.fetches(read_pages(spark, directory))
    return fetches.select(
        "page_id", extract.refetch_extraction(F.col("html")).alias("b")
    ).select("page_id", "b.*")


@query
def extraction_picked(spark, directory):
    return tables.pick_extraction(read_pages(spark, directory)).select(
        "page_id", "method", "confidence", "title", "text"
    )


@query
def extraction_methods(spark, directory):
    pages = read_pages(spark, directory)
    found = pages.select("page_id", extract.successful_methods(F.col("html")).alias("methods"))
    return found.filter(F.size("methods") > 0).select(
        "page_id", F.array_join("methods", ",").alias("methods"))


@query
def capture_stats(spark, directory):
    captures = tables.pick_extraction(read_pages(spark, directory))
    return captures.select(
        "page_id", extract.capture_stats(F.col("text"), F.col("html")).alias("s")
    ).select("page_id", "s.*")


@query
def iframe_inventory(spark, directory):
    inventory = tables.iframe_inventory(variants.iframe_pages(read_pages(spark, directory)))
    return inventory.select("page_id", "pos", "src", F.col("sameOrigin").alias("same_origin"))


# ------------------------------------------------------------- signals and scores

@query
def article_scores(spark, directory):
    """Score the main article of every page."""
    pages = read_pages(spark, directory)
    articles = _extraction_rows(pages, extract.landmark_extraction(F.col("html")))
    scored = articles.withColumn("s", signals.signals(F.col("text"), F.col("html")))
    return scored.select(
        "page_id", "s.len_text", "s.word_count", "s.density", "s.structure", "s.link_quality",
        "s.freshness", signals.score_of(F.col("s")).alias("score"),
    )


@query
def document_signals(spark, directory):
    documents = _documents(spark, directory)
    text = F.col("text")
    return documents.select(
        "doc_id", signals.len_text(text).alias("len_text"),
        signals.len_norm(text).alias("len_norm"), signals.word_count(text).alias("word_count"),
        signals.freshness(text).alias("freshness"),
    )


@query
def page_signals(spark, directory):
    h = F.col("html")
    return read_pages(spark, directory).select(
        "page_id", signals.heading_count(h).alias("headings"),
        signals.paragraph_count(h).alias("paragraphs"), signals.item_count(h).alias("lists"),
        signals.structure(h).alias("structure"), signals.link_quality(h).alias("link_quality"),
        signals.density(h, h).alias("density"),
    )


@query
def word_ngrams(spark, directory):
    grams = _documents(spark, directory).select(
        "doc_id", F.size(signals.words(F.col("text"))).alias("n_words"),
        signals.word_ngrams(F.col("text")).alias("g"),
    )
    return grams.select(
        "doc_id", "n_words", F.size("g").alias("n_grams"), F.array_min("g").alias("first_gram"),
        F.array_max("g").alias("last_gram"),
    )


def _neighbours(spark: SparkSession, directory: str) -> DataFrame:
    documents = _documents(spark, directory)
    following = documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text_b"))
    return documents.withColumnRenamed("text", "text_a").join(following, "doc_id")


@query
def semantic_overlap(spark, directory):
    pairs = _neighbours(spark, directory)
    return pairs.select(
        "doc_id", signals.semantic_overlap(F.col("text_a"), F.col("text_b")).alias("overlap")
    )


@query
def semantic_overlap_exploded(spark, directory):
    return overlap.semantic_overlap_exploded(_neighbours(spark, directory), "doc_id")


@query
def compare_and_decide(spark, directory):
    pairs = _neighbours(spark, directory)
    wrapped = pairs.select(
        "doc_id", "text_a", "text_b",
        F.concat(F.lit("<h1>A</h1><p>"), "text_a", F.lit("</p>")).alias("html_a"),
        F.concat(F.lit("<p>"), F.replace("text_b", F.lit("\n"), F.lit("</p><p>"))).alias("html_b"),
        F.when(F.col("doc_id") % 4 == 0, 0.3).otherwise(0.0).alias("penalty"),
    )
    decided = wrapped.select(
        "doc_id",
        decide.compare_and_decide(
            F.col("text_a"), F.col("html_a"), F.col("text_b"), F.col("html_b"), F.col("penalty")
        ).alias("d"),
    )
    return decided.select(
        "doc_id", "d.chosen", "d.score_a", "d.score_b", "d.score_diff", "d.overlap",
        F.col("d.signals_a.len").alias("len_a"), F.col("d.signals_b.density").alias("density_b"),
        "d.blocker_penalty",
    )


# ----------------------------------------------------------------- URLs and links

@query
def tracking_stripped(spark, directory):
    pages = read_pages(spark, directory)
    both = pages.select("page_id", "url").unionByName(variants.messy_urls(pages))
    return both.select("page_id", "url", urls.strip_tracking(F.col("url")).alias("clean_url"))


@query
def urls_resolved(spark, directory):
    links = tables.link_table(variants.link_markdown(read_pages(spark, directory)))
    return links.select(
        "page_id", "pos", urls.resolve_url(F.col("url"), F.col("link_url")).alias("absolute")
    )


@query
def redirects_detected(spark, directory):
    fetches = variants.fetches(read_pages(spark, directory))
    key = urls.redirect_key(F.col("url"))
    return fetches.select(
        "page_id", key["host"].alias("host"), key["path"].alias("path"),
        urls.was_redirected(F.col("url"), F.col("final_url")).alias("was_redirected"),
    )


@query
def same_origins(spark, directory):
    links = tables.link_table(variants.link_markdown(read_pages(spark, directory)))
    return links.select(
        "page_id", "pos", urls.same_origin(F.col("link_url"), F.col("url")).alias("same_origin")
    )


@query
def filenames(spark, directory):
    return read_pages(spark, directory).select(
        "page_id", urls.sanitize_filename(html.document_title(F.col("html"))).alias("filename")
    )


@query
def tokens_redacted(spark, directory):
    messy = variants.messy_urls(read_pages(spark, directory))
    return messy.select("page_id", urls.redact_tokens(F.col("url")).alias("safe_url"))


@query
def links_normalized(spark, directory):
    md = variants.link_markdown(read_pages(spark, directory))
    return md.select(
        "page_id", urls.normalize_links(F.col("markdown"), F.col("url")).alias("markdown")
    )


@query
def link_table(spark, directory):
    links = tables.link_table(variants.link_markdown(read_pages(spark, directory)))
    return links.select("page_id", "pos", "text", "link_url", "clean_url")


# ----------------------------------------------------------------------- Markdown

@query
def html_to_markdown(spark, directory):
    """Whole pages, menus included, so that lists and links take part."""
    md = markdown.html_to_markdown(F.col("html"), dropped=("script", "style", "footer"))
    return read_pages(spark, directory).select("page_id", md.alias("markdown"))


@query
def article_markdown(spark, directory):
    articles = tables.pick_extraction(read_pages(spark, directory))
    md = markdown.with_metadata_header(
        markdown.html_to_markdown(F.col("html")), F.col("title"), F.col("url"),
        variants.captured_at(),
    )
    return articles.select("page_id", md.alias("markdown"))


@query
def conversion_fallbacks(spark, directory):
    emptied = read_pages(spark, directory).select(
        "page_id", "url", variants.page_title().alias("title"),
        F.when(variants.kind(3) == 0, F.lit(None).cast("string"))
        .when(variants.kind(3) == 1, "").otherwise(F.col("html")).alias("html"),
    )
    failed = markdown.conversion_fallback(
        F.col("title"), F.col("url"), F.lit(markdown.NO_HTML), F.col("html")
    )
    return emptied.select("page_id", failed.alias("markdown"))


@query
def code_blocks(spark, directory):
    return tables.code_blocks(
        variants.code_pages(read_pages(spark, directory)).drop("class")
    ).select("page_id", "pos", "lang", "code")


@query
def class_languages(spark, directory):
    pages = variants.code_pages(read_pages(spark, directory))
    return pages.select(
        "page_id", "class", languages.lang_from_class(F.col("class")).alias("lang")
    )


@query
def languages_normalized(spark, directory):
    named = variants.code_pages(read_pages(spark, directory)).select(
        "page_id", F.regexp_extract("class", r"(\w+)$", 1).alias("lang")
    )
    return tables.normalize_languages(named)


@query
def fences_tagged(spark, directory):
    pages = variants.code_pages(read_pages(spark, directory))
    return pages.select("page_id", markdown.html_to_markdown(F.col("html")).alias("markdown"))


@query
def code_languages(spark, directory):
    code = variants.snippets(_documents(spark, directory))
    return code.select("doc_id", languages.detect_code_language(F.col("code")).alias("lang"))


@query
def fragments_fixed(spark, directory):
    md = variants.numbered_markdown(_documents(spark, directory))
    return md.select("doc_id", markdown.fix_fragmented_code(F.col("markdown")).alias("markdown"))


@query
def code_fragments(spark, directory):
    md = variants.numbered_markdown(_documents(spark, directory))
    return tables.code_fragments(md).select("doc_id", "pos", "code", "lang")


@query
def markdown_cleaned(spark, directory):
    md = variants.gappy_markdown(_documents(spark, directory))
    return md.select("doc_id", markdown.clean_markdown(F.col("markdown")).alias("markdown"))


# ----------------------------------------------------------------------- blockers

@query
def blocker_flags(spark, directory):
    fetches = variants.fetches(read_pages(spark, directory)).withColumn(
        "text", html.page_text(F.col("html"))
    )
    flagged = fetches.withColumn(
        "f",
        blockers.blocker_flags(
            F.col("status_code"), F.col("html"), F.col("text"), F.col("error")
        ),
    )
    return flagged.select(
        "page_id", "f.login_required", "f.paywall", "f.captcha", "f.cross_origin_iframe",
        "f.content_too_thin", "f.csp_blocked", F.col("f.error").alias("error"),
        signals.blocker_penalty(F.col("f")).alias("penalty"),
        blockers.blocker_type(F.col("f")).alias("blocker_type"),
    )


@query
def pages_to_probe(spark, directory):
    prepared = _prepared(spark, directory)
    return prepared.filter(F.col("b.success")).select(
        "url", F.col("b.char_count").alias("char_count"),
        blockers.should_probe(F.col("b.char_count")).alias("should_probe"),
    )


# ---------------------------------------------------------------------- whole job

def _prepared(spark: SparkSession, directory: str) -> DataFrame:
    return job.prepare_fetches(variants.fetches(read_pages(spark, directory)))


def _joined(spark: SparkSession, directory: str) -> DataFrame:
    captures = variants.captures(read_pages(spark, directory)).drop("page_id")
    return job.join_candidates(captures, job.latest_fetches(_prepared(spark, directory)))


def _flat(results: DataFrame) -> DataFrame:
    d = F.col("diagnostics")
    return results.select(
        "url", "title", "chosen", "route", "blocker",
        d["score_a"].alias("score_a"), d["score_b"].alias("score_b"),
        d["signals"]["capture"]["len"].alias("len_a"),
        d["signals"]["refetch"]["len"].alias("len_b"),
        d["signals"]["refetch"]["density"].alias("density_b"),
        "overlap", "blocker_penalty", d["redirect_detected"].alias("redirect_detected"),
        d["final_url"].alias("final_url"), "markdown",
    )


@query
def candidates_joined(spark, directory):
    return _joined(spark, directory).select(
        "url", "final_url", "fetch_ok", "redirected", F.length("text").alias("text_chars"),
        F.col("b.char_count").alias("b_chars"),
    )


@query
def routes(spark, directory):
    return _joined(spark, directory).select("url", job.route().alias("route"))


@query
def fallback_results(spark, directory):
    return _flat(job.fallback_branch(_joined(spark, directory)))


@query
def compared_results(spark, directory):
    return _flat(job.compare_branch(_joined(spark, directory)))


@query
def ingest(spark, directory):
    pages = read_pages(spark, directory)
    captures = variants.captures(pages).drop("page_id")
    return _flat(job.ingest(captures, variants.fetches(pages)))


@query
def ingest_refetched(spark, directory):
    """The whole job on a fetch log that has every URL three times; the newest counts."""
    folder = scratch(spark, "fetch-log")
    pages = read_pages(spark, directory)
    variants.fetches_thrice(pages).drop("page_id").write.parquet(folder)
    return _flat(job.ingest(variants.captures(pages).drop("page_id"), spark.read.parquet(folder)))


@query
def ingest_without_templates(spark, directory):
    """The whole job with blocks that two pages of a host share taken out of the re-fetched side.

    The counts come from two crawls, the second added to the stored counts of the first.
    """
    folder = scratch(spark, "block-counts")
    pages = read_pages(spark, directory)
    fetches = variants.fetches(pages)
    first, second = (fetches.filter(F.col("page_id") % 2 == half) for half in (0, 1))
    templates.block_counts(first).write.parquet(f"{folder}/first")
    stored = spark.read.parquet(f"{folder}/first")
    templates.added_counts(stored, templates.block_counts(second)).write.parquet(f"{folder}/both")
    return _flat(job.ingest(
        variants.captures(pages).drop("page_id"), fetches.drop("page_id"),
        spark.read.parquet(f"{folder}/both"), 2,
    ))


@query
def latest_fetches(spark, directory):
    """The newest of several fetches of each URL, be it a success or not."""
    latest = job.latest_fetches(variants.fetch_log(read_pages(spark, directory)))
    return latest.select(
        "url", "status_code", "success", F.unix_seconds("fetched_at").alias("fetched_at")
    )


@query
def run_report(spark, directory):
    report = job.run_report(job.answer(_joined(spark, directory)))
    return report.select(
        "route", "chosen", "n", F.round("avg_score_a", 6).alias("avg_score_a"),
        F.round("avg_score_b", 6).alias("avg_score_b"),
    )


@query
def quarantined(spark, directory):
    """Records that were turned away, and result rows without Markdown, from one run of the job."""
    pages = read_pages(spark, directory)
    outcomes = job.ingest_to(
        variants.broken_captures(pages).drop("page_id"), variants.fetches(pages), scratch(spark, "outcomes"))
    return job.rejected(outcomes)


# ---------------------------------------------------------- streams, SQL functions

def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory of the cluster."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pagemark-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def ingest_stream(spark, directory):
    """Captures as a stream against a written table of prepared fetches."""
    folder = scratch(spark, "ingest-stream")
    job.latest_fetches(_prepared(spark, directory)).write.parquet(f"{folder}/prepared")
    # the table itself is the stream's folder, be it one file or many
    pages = streams.read_stream(
        spark, f"{directory}/pages.parquet*", "page_id bigint, url string, html string"
    )
    results = streams.ingest_stream(
        variants.captures(pages).drop("page_id"), spark.read.parquet(f"{folder}/prepared")
    )
    run = streams.start(results, f"{folder}/out", f"{folder}/checkpoint", available_now=True)
    run.awaitTermination()
    return _flat(spark.read.parquet(f"{folder}/out"))


@query
def fetches_in_time(spark, directory):
    """The timeout join of two streams, run to its end on the crawl table."""
    folder = scratch(spark, "fetch-stream")
    pages = read_pages(spark, directory)
    captures = variants.captures(pages).select("url", "title", "html", "text", "meta")
    fetches = variants.fetches(pages).drop("page_id")
    end = pages.agg(F.max("page_id").alias("page_id")).select(
        (F.col("page_id") + 3600).alias("page_id"), F.lit("sentinel").alias("url"),
        F.lit("<article><p>end</p></article>").alias("html"),
    )
    # a later file with one late record on both sides moves the watermark past the rest
    for wave, (c, f) in enumerate((
        (captures, fetches),
        (variants.captures(end).select(*captures.columns),
         variants.fetches(end).drop("page_id")),
    )):
        c.write.mode("append").parquet(f"{folder}/captures")
        f.write.mode("append").parquet(f"{folder}/fetches")
        joined = streams.join_fetch_stream(
            streams.read_stream(spark, f"{folder}/captures", captures.schema),
            streams.read_stream(spark, f"{folder}/fetches", fetches.schema),
        )
        run = streams.start(
            joined.select("url", "fetched_at", "fetch_ok", "redirected", "b.char_count"),
            f"{folder}/out", f"{folder}/checkpoint", available_now=True,
        )
        run.awaitTermination()
    out = spark.read.parquet(f"{folder}/out").filter(F.col("url") != "sentinel")
    return out.select(
        "url", F.unix_seconds("fetched_at").alias("fetched_at"), "fetch_ok", "redirected",
        "char_count",
    )


@query
def fetches_in_any_order(spark, directory):
    """Two fetches of each page in both orders of arrival, late, repeated and lost captures."""
    folder = scratch(spark, "fetch-orders")
    pages = read_pages(spark, directory)
    captures = variants.captures(pages)
    columns = [c for c in captures.columns if c != "page_id"]
    one, two = variants.fetches(pages), variants.second_fetches(pages)
    last = pages.agg(F.max("page_id")).first()[0] or 0
    lateness = f"{last + 60} seconds"  # of the pages' own clock, so that nothing before the end is late

    def end(hours):
        return spark.range(1).select(
            F.lit(last + 2 * last + 3600 * hours).alias("page_id"), F.lit("sentinel").alias("url"),
            F.lit("<article><p>end</p></article>").alias("html"))

    even, late = F.col("page_id") % 2 == 0, F.col("page_id") % 5 == 4
    lost = captures.filter("page_id % 11 = 0").withColumn("url", F.concat("url", F.lit("#lost")))
    for c, f in (
        (captures.filter(~late), one.filter(even).unionByName(two.filter(~even))),
        (captures.filter(late), two.filter(even).unionByName(one.filter(~even))),
        (captures.filter("page_id % 7 = 0"), one.limit(0)),
        (variants.captures(end(1)), variants.fetches(end(1))),
        (lost, one.limit(0)),
        (variants.captures(end(2)), variants.fetches(end(2))),
    ):
        c.select(columns).write.mode("append").parquet(f"{folder}/captures", compression="zstd")
        f.drop("page_id").write.mode("append").parquet(f"{folder}/fetches", compression="zstd")
        joined = streams.join_fetch_stream(
            streams.read_stream(spark, f"{folder}/captures", captures.select(columns).schema),
            streams.read_stream(spark, f"{folder}/fetches", one.drop("page_id").schema),
            watermark=lateness, salts=2,
        )
        streams.start(joined.select("url", "captured_at", "fetched_at", "fetch_ok"), f"{folder}/out",
                      f"{folder}/checkpoint", available_now=True).awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    rest = streams.unanswered(spark.read.parquet(f"{folder}/captures"), out).select(
        "url", F.lit(None).cast("long").alias("fetched_at"), F.lit(None).cast("boolean").alias("fetch_ok"),
        F.lit(False).alias("in_stream"))
    answered = out.select("url", F.unix_seconds("fetched_at").alias("fetched_at"), "fetch_ok",
                          F.lit(True).alias("in_stream"))
    return answered.unionByName(rest).filter(F.col("url") != "sentinel")


def _bucket_run(spark: SparkSession, directory: str) -> str:
    """Captures of three files, a micro-batch each, answered from stored buckets of fetches."""
    folder = scratch(spark, "bucket-stream")
    pages = read_pages(spark, directory)
    pages.repartitionByRange(3, "page_id").write.parquet(f"{folder}/pages")
    streams.write_prepared(job.latest_fetches(_prepared(spark, directory)), f"{folder}/prepared", 16)
    stream = streams.read_stream(spark, f"{folder}/pages", pages.schema, maxFilesPerTrigger=1)
    streams.ingest_buckets(
        variants.captures(stream).drop("page_id"), f"{folder}/prepared", folder, f"{folder}/checkpoint",
        16, available_now=True,
    ).awaitTermination()
    return folder


@query
def ingest_buckets(spark, directory):
    """The whole job on a stream that reads only the fetches of its own URLs."""
    return _flat(spark.read.parquet(f"{_bucket_run(spark, directory)}/results"))


@query
def stream_counters(spark, directory):
    """The run report of a stream, added up from the counters of its micro-batches."""
    report = streams.counted(spark, _bucket_run(spark, directory))
    return report.select(
        "route", "chosen", "n", F.round("avg_score_a", 6).alias("avg_score_a"),
        F.round("avg_score_b", 6).alias("avg_score_b"),
    )


@query
def sql_functions(spark, directory):
    register_sql(spark)
    read_pages(spark, directory).createOrReplaceTempView("pagemark_pages")
    return spark.sql(
        """
        SELECT page_id, pm_strip_tracking(url) AS clean_url,
               pm_redact_tokens(concat(url, '?token=', page_id)) AS safe_url,
               pm_sanitize_filename(url) AS filename, pm_word_count(html) AS word_count,
               pm_structure(html) AS structure, pm_visible_text(html) AS text,
               pm_lang_from_class(concat('lang-python', page_id % 2 + 2)) AS lang
        FROM pagemark_pages
        """
    )
