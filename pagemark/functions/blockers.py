"""Access blockers, read from the re-fetched page."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemark.dialect import CAPTCHA_WORDS, LOGIN_WORDS, PAYWALL_WORDS, PROBE_BELOW_CHARS
from pagemark.functions.arrays import let, reused
from pagemark.functions.html import trim_space

LOGIN_FORM = r"""(?i:<form\s(?:[^>]*\s)?action\s*=\s*)["']?[^"'>]*login"""
PASSWORD_INPUT = r"""(?i)<input\s(?:[^>]*\s)?type\s*=\s*["']?password["'\s/>]"""


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\-", "-") for w in words)


def should_probe(char_count: Column, below: int = PROBE_BELOW_CHARS) -> Column:
    return char_count < below


def login_required(status: Column, html: Column, html_lower: Column | None = None) -> Column:
    lowered = F.lower(html) if html_lower is None else html_lower
    form = html.rlike(LOGIN_FORM) | html.rlike(PASSWORD_INPUT)
    return F.coalesce(status.isin(401, 403), F.lit(False)) | (
        lowered.rlike(_any_of(LOGIN_WORDS)) & form
    )


def paywall(html_lower: Column, text_lower: Column) -> Column:
    return html_lower.rlike(_any_of(PAYWALL_WORDS)) | text_lower.rlike(_any_of(PAYWALL_WORDS))


def captcha(html_lower: Column) -> Column:
    return html_lower.rlike(_any_of(CAPTCHA_WORDS))


def cross_origin_iframe(html_lower: Column, text: Column) -> Column:
    return (F.length(trim_space(text)) < 200) & html_lower.contains("<iframe")


def content_too_thin(text: Column, login: Column) -> Column:
    return (F.length(trim_space(text)) < 100) & ~login


def probe_error(html: Column, error: Column) -> Column:
    """NULL for a page that loaded."""
    return (
        F.when(error == "Request timeout", "Page load timeout")
        .when(error.isNotNull() & (error != ""), F.concat(F.lit("Probe error: "), error))
        .when(html.isNull(), "No response received")
    )


@reused
def blocker_flags(status: Column, html: Column, text: Column, error: Column) -> Column:
    """All flags of a page as one struct; nothing but the error if it did not load."""
    def flags(s: Column) -> Column:
        loaded = s["error"].isNull()
        login = login_required(s["status"], s["html"], s["lower"])

        def flag(c: Column) -> Column:
            return F.when(loaded, c).otherwise(False)

        return F.struct(
            flag(login).alias("login_required"),
            flag(paywall(s["lower"], F.lower(s["text"]))).alias("paywall"),
            flag(captcha(s["lower"])).alias("captcha"),
            flag(cross_origin_iframe(s["lower"], s["text"])).alias("cross_origin_iframe"),
            flag(content_too_thin(s["text"], login)).alias("content_too_thin"),
            F.lit(False).alias("csp_blocked"),
            s["error"].alias("error"),
        )

    inputs = F.struct(
        status.alias("status"), html.alias("html"), F.lower(html).alias("lower"),
        text.alias("text"), probe_error(html, error).alias("error"),
    )
    return let(inputs, flags)


def blocker_type(flags: Column) -> Column:
    """The blocker that decides the outcome, or NULL."""
    return (
        F.when(flags["login_required"], "login wall")
        .when(flags["paywall"], "paywall")
        .when(flags["captcha"], "CAPTCHA")
    )


def blocker_code(flags: Column) -> Column:
    """First flag as an error code, or NULL."""
    return (
        F.when(flags["login_required"], "login-required")
        .when(flags["paywall"], "paywall")
        .when(flags["captcha"], "captcha")
        .when(flags["cross_origin_iframe"], "cross-origin-iframe")
        .when(flags["content_too_thin"], "content-too-thin")
        .when(flags["csp_blocked"], "csp-blocked")
    )
