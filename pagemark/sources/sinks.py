"""Sinks: the Markdown corpus, its text export and the raw-HTML backup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemark.functions.urls import sanitize_filename, url_host


def with_filenames(results: DataFrame) -> DataFrame:
    return results.withColumn("host", url_host(F.col("url"))).withColumn(
        "filename", F.concat(sanitize_filename(F.col("title")), F.lit(".md"))
    )


def write_results(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet corpus with a host and a title-derived file name per row; no shuffle."""
    with_filenames(results).write.mode(mode).parquet(path)


def write_clustered(written: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rewrite a corpus so that a filter on host skips files by their statistics.

    A directory per host would make millions of small files, and one host may hold much
    of the data, or one URL; ranges of (host, url, a hash) let both span several files. Give this a
    corpus read back from its table: range partitioning samples its input in a pass of
    its own, which would run a whole ingest twice.
    """
    spread = F.xxhash64("markdown", "captured_at") if "captured_at" in written.columns else F.xxhash64("markdown")
    ranged = written.withColumn("_spread", spread).repartitionByRange("host", "url", "_spread")
    ranged.sortWithinPartitions("host", "url").drop("_spread").write.mode(mode).parquet(path)


def write_markdown_text(
    results: DataFrame, path: str, separator: str = "\n\n", mode: str = "errorifexists"
) -> None:
    """The Markdown alone, as text files."""
    results.select("markdown").write.mode(mode).option("lineSep", separator).text(path)


def html_backup(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages without a result, with the file name their raw HTML is kept under."""
    # URLs first, without the pages; few of them then go to the pages by a broadcast
    urls = pages.select("url").distinct().join(results.select("url"), "url", "left_anti")
    missing = pages.join(
        urls.withColumnRenamed("url", "_url"), F.col("url").eqNullSafe(F.col("_url")), "left_semi"
    )
    return missing.withColumn(
        "filename", F.concat(sanitize_filename(F.col("title")), F.lit("_backup.html"))
    )


def write_html_backup(backup: DataFrame, path: str, mode: str = "errorifexists") -> None:
    backup.write.mode(mode).parquet(path)
