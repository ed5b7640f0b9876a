"""URLs and links: tracking parameters, resolution, redirect keys, file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemark.dialect import LINK_PATTERN, TOKEN_PARAMS, TRACKING_PARAMS, URL_RE
from pagemark.functions.arrays import join, let, reused

LINK_PIECES = LINK_PATTERN + r"|[^\[]+|\["
# schemes whose references resolve against a base, and those that take an authority
RELATIVE_SCHEMES = ("http", "https", "ftp", "file", "ws", "wss", "sftp", "")


@reused
def split_url(url: Column) -> Column:
    """scheme, authority (NULL if absent), path, query, fragment."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")

    def parts(u: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(u, URL_RE, 1)).alias("scheme"),
            F.when(u.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//"),
                   F.regexp_extract(u, URL_RE, 2)).alias("authority"),
            F.regexp_extract(u, URL_RE, 3).alias("path"),
            F.regexp_extract(u, URL_RE, 4).alias("query"),
            F.regexp_extract(u, URL_RE, 5).alias("fragment"),
        )

    return let(clean, parts)


def _bad_authority(p: Column) -> Column:
    authority = F.coalesce(p["authority"], F.lit(""))
    return authority.contains("[") != authority.contains("]")


def _unsplit(scheme: Column, authority: Column, path: Column, query: Column,
             fragment: Column) -> Column:
    authority = F.coalesce(authority, F.lit(""))
    slash = F.when((authority != "") & (path != "") & ~path.startswith("/"), "/").otherwise("")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""),
        slash, path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def decode_component(text: Column) -> Column:
    """Form decoding that leaves malformed percent escapes as they are."""
    safe = F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), text)


def encode_component(text: Column) -> Column:
    return F.replace(
        F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def clean_query(query: Column) -> Column:
    """Drop tracking and blank parameters, group repeated keys, encode again."""
    def parse(item: Column) -> Column:
        at = F.instr(item, "=")
        return F.struct(
            decode_component(F.substring(item, F.lit(1), at - 1)).alias("k"),
            decode_component(F.substr(item, at + 1)).alias("v"),
        )

    items = F.filter(F.split(query, "&"), lambda q: q.rlike("(?s)^[^=]*=."))
    pairs = F.filter(F.transform(items, parse), lambda p: ~p["k"].isin(*TRACKING_PARAMS))

    def grouped(ps: Column) -> Column:
        keys = F.array_distinct(F.transform(ps, lambda p: p["k"]))
        return let(
            keys,
            lambda ks: F.when(F.size(ks) == F.size(ps), ps).otherwise(
                F.flatten(F.transform(ks, lambda k: F.filter(ps, lambda p: p["k"] == k)))
            ),
        )

    def render(p: Column) -> Column:
        return F.concat(encode_component(p["k"]), F.lit("="), encode_component(p["v"]))

    return F.when(query == "", "").otherwise(
        F.array_join(F.transform(let(pairs, grouped), render), "&")
    )


@reused
def strip_tracking(url: Column) -> Column:
    """URL without tracking parameters; an unparsable URL comes back unchanged."""
    def strip(u: Column) -> Column:
        return let(
            split_url(u),
            lambda p: F.when(_bad_authority(p), u).otherwise(
                _unsplit(p["scheme"], p["authority"], p["path"], clean_query(p["query"]),
                         p["fragment"])
            ),
        )

    return let(url, strip)


def _merge_paths(base_path: Column, path: Column) -> Column:
    """Reference path placed on the base path, dot segments folded."""
    base_dir = F.regexp_replace(base_path, "[^/]+$", "")
    raw = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.when(base_dir == "", "/").otherwise(base_dir), path)
    )

    def fold(segments: Column) -> Column:
        n = F.size(segments)
        # empty segments in the middle vanish, the outer two stay
        inner = F.filter(segments, lambda s, i: (i == 0) | (i == n - 1) | (s != ""))
        folded = F.aggregate(
            inner,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(
                s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
            ).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
        )
        last = F.element_at(segments, -1)
        closed = F.when(
            last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))
        ).otherwise(folded)
        return F.array_join(closed, "/")

    merged = let(F.split(raw, "/"), fold)
    return let(merged, lambda m: F.when(m == "", "/").otherwise(m))


@reused
def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute URL of ``ref`` seen from ``base``."""
    def combine(s: Column) -> Column:
        b, r = s["b"], s["r"]
        scheme = F.when(r["scheme"] == "", b["scheme"]).otherwise(r["scheme"])
        foreign = (scheme != b["scheme"]) | ~scheme.isin(*RELATIVE_SCHEMES)
        no_path = r["path"] == ""
        return (
            F.when(s["ref"] == "", s["base"])
            .when(s["base"] == "", s["ref"])
            .when(foreign, s["ref"])
            .when(
                F.coalesce(r["authority"], F.lit("")) != "",
                _unsplit(scheme, r["authority"], r["path"], r["query"], r["fragment"]),
            )
            .when(
                no_path,
                _unsplit(
                    scheme, b["authority"], b["path"],
                    F.when(r["query"] == "", b["query"]).otherwise(r["query"]), r["fragment"],
                ),
            )
            .otherwise(
                _unsplit(scheme, b["authority"], _merge_paths(b["path"], r["path"]),
                         r["query"], r["fragment"])
            )
        )

    inputs = F.struct(base.alias("base"), ref.alias("ref"))
    return let(
        inputs,
        lambda i: let(
            F.struct(i["base"].alias("base"), i["ref"].alias("ref"),
                     split_url(i["base"]).alias("b"), split_url(i["ref"]).alias("r")),
            combine,
        ),
    )


def url_host(url: Column) -> Column:
    """Host in lower case, without user, port and brackets."""
    authority = F.coalesce(split_url(url)["authority"], F.lit(""))
    return F.lower(F.regexp_replace(authority, r"^.*@|:\d*$", ""))


@reused
def redirect_key(url: Column) -> Column:
    """(host, path) that decides whether two URLs are the same page."""
    def path(p: Column) -> Column:
        decoded = F.coalesce(
            F.try_url_decode(
                F.replace(F.regexp_replace(p, "%(?![0-9a-fA-F]{2})", "%25"), F.lit("+"),
                          F.lit("%2B"))
            ),
            p,
        )
        return let(
            decoded,
            lambda d: F.when(d.isin("", "/"), "/").otherwise(F.regexp_replace(d, "/+$", "")),
        )

    return F.struct(
        F.regexp_replace(url_host(url), r"^www\.", "").alias("host"),
        path(split_url(url)["path"]).alias("path"),
    )


@reused
def was_redirected(original: Column, final: Column) -> Column:
    return redirect_key(original) != redirect_key(final)


def origin(url: Column) -> Column:
    """scheme://host:port with default ports dropped; NULL if there is none."""
    def build(p: Column) -> Column:
        authority = F.lower(F.regexp_replace(F.coalesce(p["authority"], F.lit("")), "^.*@", ""))
        default = F.when(p["scheme"].isin("http", "ws"), ":80").otherwise(":443")
        short = F.when(
            authority.endswith(":"), F.regexp_replace(authority, ":$", "")
        ).when(
            F.endswith(authority, default), F.regexp_replace(authority, r":\d+$", "")
        ).otherwise(authority)
        usable = p["scheme"].isin("http", "https", "ws", "wss", "ftp") & (authority != "")
        return F.when(usable, F.concat(p["scheme"], F.lit("://"), short))

    return let(split_url(url), build)


@reused
def same_origin(url: Column, page_url: Column) -> Column:
    return F.coalesce(origin(resolve_url(page_url, url)) == origin(page_url), F.lit(False))


def sanitize_filename(title: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(title, "[^A-Za-z0-9]", "_"), "_+", "_")
    return F.substring(safe, 1, 100)


def redact_tokens(url: Column) -> Column:
    for name in TOKEN_PARAMS:
        url = F.regexp_replace(url, f"(?i)({name}=)[^&]+", "$1[REDACTED]")
    return url


def link_pieces(md: Column) -> Column:
    """Markdown cut into links and the text between them, lossless."""
    return F.regexp_extract_all(md, F.lit(LINK_PIECES), F.lit(0))


def is_link(piece: Column) -> Column:
    return piece.startswith("[") & (F.length(piece) > 1)


def link_url(piece: Column) -> Column:
    return F.regexp_extract(piece, LINK_PATTERN, 2)


def link_text(piece: Column) -> Column:
    return F.regexp_extract(piece, LINK_PATTERN, 1)


@reused
def clean_link_url(base: Column, url: Column) -> Column:
    """Absolute, tracking-free URL; in-page anchors and mail addresses stay."""
    def fix(u: Column) -> Column:
        broken = _bad_authority(split_url(u))
        return F.when(u.startswith("#") | u.startswith("mailto:") | broken, u).otherwise(
            strip_tracking(resolve_url(base, u))
        )

    return let(url, fix)


def map_links(md: Column, change: Callable[[Column], Column]) -> Column:
    """Rewrite the URL of every Markdown link."""
    def piece(p: Column) -> Column:
        return F.when(
            is_link(p),
            F.concat(F.lit("["), link_text(p), F.lit("]("), change(link_url(p)), F.lit(")")),
        ).otherwise(p)

    return F.when(md == "", "").otherwise(join(F.transform(link_pieces(md), piece)))


@reused
def normalize_links(md: Column, base: Column) -> Column:
    return map_links(md, lambda u: clean_link_url(base, u))
