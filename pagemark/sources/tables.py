"""Sources: captures, crawled pages, fetch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META_SCHEMA = (
    "struct<captured_at:string,stats:struct<char_count:int,headings:int,lists:int>,"
    "iframe_info:array<struct<src:string,sameOrigin:boolean>>,"
    "extraction_methods:array<string>>"
)
CAPTURE_SCHEMA = (
    f"url string, title string, html_extension string, text_extension string, "
    f"meta {META_SCHEMA}, _corrupt string"
)
FETCH_SCHEMA = (
    "url string, final_url string, status_code int, content_type string, html string, "
    "success boolean, error string, fetched_at timestamp"
)


def read_pages(spark: SparkSession, directory: str, partitions: int | None = None) -> DataFrame:
    """A crawl table: page_id, url, html.

    The splits of the files decide on the partitions. ``partitions`` deals the pages out
    anew, at the price of shuffling them; it is meant for a table in a single small file.
    """
    pages = spark.read.parquet(f"{directory}/pages.parquet").select("page_id", "url", "html")
    return pages.repartition(partitions, "page_id") if partitions else pages


def read_captures(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    """Capture records as the browser posts them, one JSON object per line.

    Unparsable records stay in, with the raw text in ``_corrupt``; unknown fields are
    dropped.
    """
    if file_format == "parquet":
        return spark.read.parquet(path)
    raw = (
        spark.read.schema(CAPTURE_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    return shape_captures(raw)


def parse_captures(messages: DataFrame, column: str = "value") -> DataFrame:
    """Capture records that arrive as JSON text in a column."""
    parsed = F.from_json(
        F.col(column), CAPTURE_SCHEMA,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    others = [c for c in messages.columns if c != column]
    raw = messages.select(*others, parsed.alias("r")).select(*others, "r.*")
    return shape_captures(raw, others)


def shape_captures(raw: DataFrame, others: list[str] | None = None) -> DataFrame:
    """Browser field names and text timestamps to the capture schema."""
    meta = F.when(
        F.col("meta").isNotNull(),
        F.struct(
            F.expr("try_to_timestamp(meta.captured_at)").alias("captured_at"),
            F.col("meta.stats").alias("stats"),
            F.coalesce(F.col("meta.iframe_info"),
                       F.array().cast("array<struct<src:string,sameOrigin:boolean>>")
                       ).alias("iframe_info"),
            F.col("meta.extraction_methods").alias("extraction_methods"),
        ),
    )
    return raw.select(
        *(others or []), "url", "title", F.col("html_extension").alias("html"),
        F.col("text_extension").alias("text"), meta.alias("meta"), "_corrupt",
    )


def read_fetches(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Fetch log with the failure fields filled in."""
    return shape_fetches(spark.read.schema(FETCH_SCHEMA).format(file_format).load(path))


def shape_fetches(fetches: DataFrame) -> DataFrame:
    """A failed fetch has no body, status 0 and its own URL as the final one.

    A 4xx or 5xx answer is a successful fetch.
    """
    ok = F.coalesce(F.col("success"), F.lit(False))
    known = (F.col("error") == "Request timeout") | F.col("error").startswith("HTTP error: ") | (
        F.col("error").startswith("Unexpected error: ")
    )
    error = F.when(known, F.col("error")).otherwise(
        F.concat(F.lit("Unexpected error: "), F.coalesce("error", F.lit("")))
    )
    return fetches.select(
        *[c for c in fetches.columns if c not in FETCH_SCHEMA_COLUMNS or c == "url"],
        F.when(ok, F.col("final_url")).otherwise(F.col("url")).alias("final_url"),
        F.when(ok, F.col("status_code")).otherwise(0).alias("status_code"),
        F.when(ok, F.coalesce("content_type", F.lit(""))).otherwise("").alias("content_type"),
        F.when(ok, F.col("html")).otherwise("").alias("html"),
        ok.alias("success"),
        F.when(~ok, error).alias("error"),
    )


FETCH_SCHEMA_COLUMNS = tuple(
    part.split()[0] for part in FETCH_SCHEMA.split(", ") if not part.startswith("fetched_at")
)
