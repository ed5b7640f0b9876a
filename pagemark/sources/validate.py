"""Checking captures before any work is done on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemark.functions.urls import split_url


def http_url(url: Column) -> Column:
    parts = split_url(url)
    return parts["scheme"].isin("http", "https") & (F.coalesce(parts["authority"], F.lit("")) != "")


def reject_reason(df: DataFrame) -> Column:
    """Why a capture cannot be taken in; NULL if it can."""
    missing = F.lit("missing ")
    reason = F.when(F.col("_corrupt").isNotNull(), "unparsable record") if (
        "_corrupt" in df.columns
    ) else F.when(F.lit(False), "")
    for name in ("url", "title", "html", "text", "meta"):
        reason = reason.when(F.col(name).isNull(), F.concat(missing, F.lit(name)))
    meta = F.col("meta")
    reason = reason.when(meta["captured_at"].isNull(), "missing meta.captured_at")
    reason = reason.when(meta["stats"].isNull(), "missing meta.stats")
    for name in ("char_count", "headings", "lists"):
        reason = reason.when(
            meta["stats"][name].isNull(), F.concat(missing, F.lit(f"meta.stats.{name}"))
        )
    bad_iframe = F.exists(
        meta["iframe_info"], lambda i: i["src"].isNull() | i["sameOrigin"].isNull()
    )
    reason = reason.when(F.coalesce(bad_iframe, F.lit(False)), "incomplete meta.iframe_info")
    return reason.when(~http_url(F.col("url")), "url is not http(s)")


def flag_captures(captures: DataFrame) -> DataFrame:
    return captures.withColumn("reason", reject_reason(captures))


def validate_captures(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid captures, quarantined captures with their reason)."""
    flagged = flag_captures(captures)
    valid = flagged.filter(F.col("reason").isNull()).drop("reason", "_corrupt")
    return valid, flagged.filter(F.col("reason").isNotNull())
