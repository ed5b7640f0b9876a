"""Captures and fetches to Markdown.

Everything but the one join on URL is a map over rows. The re-fetched side is reduced
to its extraction, signals and flags before the join, so raw re-fetched HTML is never
shuffled, and pages that cannot be compared skip the costly steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pagemark.functions import blockers
from pagemark.functions.decide import REFETCH, compare_and_decide, fallback_decision
from pagemark.functions.extract import content_summary, refetch_extraction
from pagemark.functions.html import page_text
from pagemark.functions.markdown import clean_markdown, convert, fix_fragmented_code
from pagemark.functions.signals import blocker_penalty
from pagemark.functions.urls import normalize_links, redact_tokens, was_redirected
from pagemark.operators.templates import drop_templates
from pagemark.sources.validate import flag_captures

FALLBACK_ROUTES = ("fetch_failed", "redirect", "extraction_failed", "blocker")


def prepare_fetches(fetches: DataFrame, min_chars: int = 1, template_counts: DataFrame | None = None,
                    template_min_pages: int = 0) -> DataFrame:
    """Everything the comparison needs to know about a fetch, without its raw HTML.

    With ``template_counts`` (see ``operators.templates.block_counts``), blocks that are on
    ``template_min_pages`` pages of their host or more are no content. This takes fetches
    with one row per URL, as ``newest_fetches`` gives them.

    A column ``probe_error`` tells why a probe of the page failed, which costs the
    re-fetch a penalty. Write the result to a table when several jobs or a stream use
    the same fetches.
    """
    ok = F.coalesce(F.col("success"), F.lit(False))
    usable = F.col("fetch_ok") & ~F.col("redirected")
    extra = [c for c in ("fetched_at", "probe_error") if c in fetches.columns]
    probe_error = F.col("probe_error") if "probe_error" in extra else F.lit(None).cast("string")
    routed = fetches.select(
        "url", "final_url", "status_code", "html", *extra, ok.alias("fetch_ok"),
        (ok & F.coalesce(was_redirected(F.col("url"), F.col("final_url")), F.lit(False))).alias(
            "redirected"),
        F.when(~ok, F.col("error")).alias("fetch_error"),
    )
    extraction = refetch_extraction(F.col("html"), min_chars)
    if template_counts is not None and template_min_pages:
        routed = drop_templates(
            routed.withColumn("html", F.coalesce("html", F.lit(""))), template_counts, template_min_pages, "url",
            "_content")
        extraction = content_summary(F.col("_content"), min_chars)
    extracted = routed.withColumn("b", F.when(usable, extraction)).drop("_content")
    probed = F.col("b.success") & blockers.should_probe(F.col("b.char_count"))
    flags = blockers.blocker_flags(
        F.col("status_code"), F.col("html"), page_text(F.col("html")),
        probe_error,
    )
    return extracted.withColumn("flags", F.when(probed, flags)).drop("html", "status_code", "probe_error")


def latest_fetches(prepared: DataFrame) -> DataFrame:
    """One fetch per URL: the latest; of several at one time a successful one.

    Without a time any order would do, and the one of a hash is as good. The optimizer
    keeps the first of each URL in every task before the shuffle, so a hot URL stays small.
    """
    order = [F.col(c).desc_nulls_last() for c in ("fetched_at", "fetch_ok", "success")
             if c in prepared.columns]
    rest = [c for c in ("final_url", "fetch_error", "error", "redirected") if c in prepared.columns]
    first = Window.partitionBy("url").orderBy(*order, F.xxhash64(*rest) if rest else F.lit(0))
    return prepared.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def newest_fetches(fetches: DataFrame) -> DataFrame:
    """The rows of a raw fetch log that ``latest_fetches`` would choose, with their pages.

    Only URLs, times and what decides ties are grouped; pages join again by the place of
    their row. That is file and row number if the log is read from Parquet files; else it is
    a hash of the whole row, and a row that is there twice is taken once. What is extracted
    afterwards is one page for each URL, however often it was fetched.
    """
    keys = [c for c in ("url", "fetched_at", "success", "final_url", "error") if c in fetches.columns]
    try:
        placed = fetches.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_place"))
        unique = True
    except AnalysisException:
        placed, unique = fetches.withColumn("_place", F.xxhash64(*fetches.columns)), False
    newest = latest_fetches(placed.select(*keys, "_place")).select("url", "_place")
    same = F.col("f.url").eqNullSafe(F.col("n.url")) & (F.col("f._place") == F.col("n._place"))
    kept = placed.alias("f").join(newest.alias("n"), same, "left_semi")
    return (kept if unique else kept.dropDuplicates(["url", "_place"])).drop("_place")


def without_meta(captures: DataFrame) -> DataFrame:
    """Of a capture's metadata only the time goes on, so the rest is not shuffled."""
    if "meta" not in captures.columns:
        return captures
    return captures.withColumn("captured_at", F.col("meta.captured_at")).drop("meta")


def join_candidates(captures: DataFrame, prepared: DataFrame) -> DataFrame:
    """Pair every capture with the re-fetch of the same URL, if there is one.

    Adaptive execution splits a hot URL of the captures only if both join sides come
    straight out of a shuffle. Fetches grouped by URL would join without one, so the
    join has a second key, the hash of the first, which the grouping does not cover.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_url_hash", F.xxhash64("url"))

    return keyed(without_meta(captures)).join(keyed(prepared), ["url", "_url_hash"], "left").drop("_url_hash")


def route() -> Column:
    """What becomes of a joined row; the first match decides."""
    return (
        F.when(~F.coalesce(F.col("fetch_ok"), F.lit(False)), "fetch_failed")
        .when(F.col("redirected"), "redirect")
        .when(~F.col("b.success"), "extraction_failed")
        .when(blockers.blocker_type(F.col("flags")).isNotNull(), "blocker")
        .otherwise("compare")
    )


def blocker_column() -> Column:
    """Error code that explains a fallback or a penalty, or NULL."""
    return (
        F.when(F.col("route") == "fetch_failed", "fetch-failed")
        .when(F.col("route") == "redirect", "content-mismatch")
        .when(F.col("route") == "extraction_failed", "extraction-failed")
        .otherwise(blockers.blocker_code(F.col("flags")))
    )


def decide(routed: DataFrame, threshold: float = 0.05, overlap_weight: float = 0.0) -> DataFrame:
    """Add the decision; only comparable rows pay for signals and overlap."""
    compared = compare_and_decide(
        F.col("text"), F.col("html"), F.col("b.text"), F.col("b.html"),
        blocker_penalty(F.col("flags")), threshold, overlap_weight,
    )
    fallback = fallback_decision(F.col("text"))
    return routed.withColumn("blocker", blocker_column()).withColumn(
        "decision", F.when(F.col("route") == "compare", compared).otherwise(fallback)
    )


def render(decided: DataFrame, **options) -> DataFrame:
    """Markdown of the chosen side; links and blank lines are tidied after a comparison only."""
    compared = F.col("route") == "compare"
    chosen_html = F.when(F.col("decision.chosen") == REFETCH, F.col("b.html")).otherwise(
        F.col("html")
    )
    staged = decided.withColumn("chosen_html", chosen_html)
    converted = fix_fragmented_code(
        convert(F.col("chosen_html"), F.col("title"), F.col("url"), F.col("captured_at"),
                **options)
    )
    raw = staged.withColumn("raw_markdown", converted)
    tidy = clean_markdown(normalize_links(F.col("raw_markdown"), F.col("url")))
    return raw.withColumn("markdown", F.when(compared, tidy).otherwise(F.col("raw_markdown")))


def shape_results(rendered: DataFrame) -> DataFrame:
    d, redirected = F.col("decision"), F.col("route") == "redirect"
    diagnostics = F.struct(
        d["score_a"].alias("score_a"), d["score_b"].alias("score_b"),
        F.create_map(
            F.lit("capture"), d["signals_a"], F.lit("refetch"), d["signals_b"]
        ).alias("signals"),
        redirected.alias("redirect_detected"),
        F.when(redirected, F.col("url")).alias("original_url"),
        F.when(redirected, F.col("final_url")).alias("final_url"),
    )
    return rendered.select(
        "url", "title", d["chosen"].alias("chosen"), "route", "blocker", "markdown",
        d["score_diff"].alias("score_diff"), d["overlap"].alias("overlap"),
        d["blocker_penalty"].alias("blocker_penalty"), diagnostics.alias("diagnostics"),
        "captured_at", *(["reason"] if "reason" in rendered.columns else []),
    )


def answer(joined: DataFrame, threshold: float = 0.05, overlap_weight: float = 0.0,
           **options) -> DataFrame:
    """Joined rows to result rows; map only, so it runs on streams too."""
    routed = joined.withColumn("route", route())
    return shape_results(render(decide(routed, threshold, overlap_weight), **options))


def fallback_branch(joined: DataFrame, **options) -> DataFrame:
    """Results of the rows that fall back to the capture."""
    routed = joined.withColumn("route", route()).filter(F.col("route").isin(*FALLBACK_ROUTES))
    return shape_results(render(decide(routed), **options))


def compare_branch(joined: DataFrame, **options) -> DataFrame:
    """Results of the rows where both versions are compared."""
    routed = joined.withColumn("route", route()).filter(F.col("route") == "compare")
    return shape_results(render(decide(routed), **options))


def ingest(captures: DataFrame, fetches: DataFrame, template_counts: DataFrame | None = None,
           template_min_pages: int = 0, **options) -> DataFrame:
    """One result row per capture; of a URL that was fetched more than once only the newest is extracted."""
    prepared = prepare_fetches(
        newest_fetches(fetches), template_counts=template_counts, template_min_pages=template_min_pages)
    return answer(join_candidates(captures, prepared), **options)


def ingest_to(captures: DataFrame, fetches: DataFrame, path: str, **options) -> DataFrame:
    """Write one row per capture, valid or not, by its outcome, and return the table written.

    ``outcome`` is ``answered``, ``failed`` (no Markdown came out) or ``rejected`` (with the
    ``reason``). Captures are read and checked once; a rejected one goes through without its
    page. The folders of the outcomes are read on their own by ``answered`` and ``rejected``.
    """
    flagged = flag_captures(captures).drop("_corrupt")
    for name in ("html", "text"):
        flagged = flagged.withColumn(name, F.when(F.col("reason").isNull(), F.col(name)))
    results = answer(join_candidates(flagged, prepare_fetches(newest_fetches(fetches))), **options)
    outcome = F.when(F.col("reason").isNotNull(), "rejected").when(
        F.col("markdown").isNull(), "failed").otherwise("answered")
    written = results.withColumn("outcome", outcome)
    written.write.partitionBy("outcome").parquet(path)
    return captures.sparkSession.read.schema(written.schema).parquet(path)


def answered(outcomes: DataFrame) -> DataFrame:
    """The results of ``ingest_to``."""
    return outcomes.filter("outcome = 'answered'").drop("outcome", "reason")


def rejected(outcomes: DataFrame) -> DataFrame:
    """(url, reason) of the records that ``ingest_to`` gave no result for."""
    failed = outcomes.filter("outcome = 'failed'")
    return outcomes.filter("outcome = 'rejected'").select("url", "reason").unionByName(quarantine_errors(failed))


def run_report(results: DataFrame) -> DataFrame:
    """Counts and mean scores per route and choice."""
    return results.groupBy("route", "chosen").agg(
        F.count("*").alias("n"),
        F.avg("diagnostics.score_a").alias("avg_score_a"),
        F.avg("diagnostics.score_b").alias("avg_score_b"),
    )


def observed(results: DataFrame, observation: Observation) -> DataFrame:
    """Collect run metrics while ``results`` is written, without a second pass."""
    return results.observe(
        observation,
        F.count("*").alias("n"),
        F.count_if(F.col("chosen") == "capture").alias("n_capture"),
        F.count_if(F.col("chosen") == "refetch").alias("n_refetch"),
        F.avg("diagnostics.score_a").alias("avg_score_a"),
        F.avg("diagnostics.score_b").alias("avg_score_b"),
    )


def quarantine_errors(results: DataFrame) -> DataFrame:
    """Result rows without Markdown: a record that failed rejects only itself.

    URLs are reported with their tokens hidden.
    """
    return results.filter(F.col("markdown").isNull()).select(
        redact_tokens(F.col("url")).alias("url"), F.lit("no markdown").alias("reason")
    )
