"""HTML to Markdown, and the repairs made on Markdown text.

Tags first become marker characters, then whitespace is collapsed, entities are
decoded and text is escaped, and last the markers become Markdown syntax. All steps
work on the whole page string; only lists, quotes, tables and code, whose meaning
depends on what encloses them, are cut into pieces, and only on pages that have them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemark.dialect import (
    DROPPED_TAGS, FRAGMENT_JAVA, INLINE_SPACE_CHARS, LINE_TAGS, TAG_RE, tags_re,
)
from pagemark.functions.arrays import join, let, reused, running
from pagemark.functions.html import (
    LINE_NAMES, _after_first_tag, _cut, attr, decode_entities, fragment_drop_regions, map_tags,
    protect, squeeze_space, token_tag, trim_space,
)
from pagemark.functions.languages import detect_code_language, lang_from_class

# markers; none of them counts as whitespace
PARA, CUT, LINE, BR = "\x01", "\x02", "\x03", "\x04"
STRONG, STRONG_END, EM, EM_END = "\x05", "\x06", "\x07", "\x08"
LINK, LINK_MID, LINK_END = "\x0e", "\x0f", "\x10"
IMG, IMG_MID, IMG_END = "\x11", "\x12", "\x13"
HEAD, CODE, CODE_END = "\x14", "\x15", "\x16"
QUOTE, QUOTE_END = "\x17", "\x18"
GLUE, PAD = "\x19", "\x1a"      # joins a bullet to its text; one column of indent
BREAKS = f"{PARA}{LINE}{BR}"

PRE = r"(?is)<pre(?:\s[^>]*)?>.*?(?:</pre\s*>|\z)"
INNER_TABLE = r"(?i)<table(?:\s[^>]*)?>(?:[^<]++|<(?!/?table[\s>]))*+</table\s*>"
CELL = r"(?i)<t[dh](?:\s[^>]*)?>"

def _has(text: Column, *needles: str) -> Column:
    found = F.contains(text, F.lit(needles[0]))
    for needle in needles[1:]:
        found = found | F.contains(text, F.lit(needle))
    return found


def _where(needles: tuple[str, ...], changed: Callable[[Column], Column],
           any_case: bool = False) -> Callable[[Column], Column]:
    """Apply ``changed`` only to strings that contain one of ``needles``."""
    def test(text: Column) -> Column:
        if any_case:
            return let(F.lower(text), lambda low: _has(low, *needles))
        return _has(text, *needles)

    return lambda text: let(text, lambda t: F.when(test(t), changed(t)).otherwise(t))


def _tail(array: Column) -> Column:
    return F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(0)))


def _most(array: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0)))


# ------------------------------------------------- structures with state or nesting

def _lists(html: Column) -> Column:
    """Bullets and numbers in place of list tags.

    The state is the stack of open lists: one letter and one item counter each.
    """
    def step(state: Column, part: Column) -> Column:
        def moved(name: Column) -> Column:
            closing = part.startswith("</")
            in_list = F.length(state["kinds"]) > 0
            opens = name.isin("ul", "ol") & ~closing
            closes = name.isin("ul", "ol") & closing & in_list
            first = F.coalesce(attr(part, "start").try_cast("int"), F.lit(1))
            kinds = (
                F.when(opens, F.concat(state["kinds"], F.substring(name, 1, 1)))
                .when(closes, F.left(state["kinds"], F.length(state["kinds"]) - 1))
                .otherwise(state["kinds"])
            )
            counts = (
                F.when(opens, F.concat(state["counts"], F.array(first - 1)))
                .when(closes, _most(state["counts"]))
                .when((name == "li") & ~closing & in_list,
                      F.concat(_most(state["counts"]),
                               F.array(F.element_at(state["counts"], -1) + 1)))
                .otherwise(state["counts"])
            )
            return F.struct(kinds.alias("kinds"), counts.alias("counts"))

        return let(token_tag(part), moved)

    def emit(state: Column, part: Column) -> Column:
        body, closing = _after_first_tag(part), part.startswith("</")
        depth = F.length(state["kinds"])
        indent = F.repeat(F.lit(PAD), F.greatest(depth - 1, F.lit(0)) * 4)
        bullet = F.when(
            state["kinds"].endswith("o"),
            F.concat(F.element_at(state["counts"], -1).cast("string"), F.lit(". ")),
        ).otherwise("- ")
        item = F.concat(F.lit(LINE), indent, bullet, F.lit(GLUE), body)
        nested = depth > F.when(closing, 0).otherwise(1)
        return (
            F.when(part.rlike("(?i)^<li"), item)
            .when(nested | part.rlike("(?i)^</li"), F.concat(F.lit(LINE), body))
            .otherwise(F.concat(F.lit(PARA), body))
        )

    start = F.struct(F.lit("").alias("kinds"), F.array().cast("array<int>").alias("counts"))
    return let(
        _cut(html, tags_re(("ul", "ol", "li"))),
        lambda parts: F.concat(
            F.get(parts, F.lit(0)), join(running(_tail(parts), start, step, emit, "string"))
        ),
    )


def _tables(html: Column) -> Column:
    """Tables to one pipe line per row.

    A table that holds another one lays out a page: only the inner one becomes pipes.
    """
    def cell(c: Column) -> Column:
        flat = F.regexp_replace(c, tags_re([*LINE_TAGS, "br"]), " ")
        flat = F.regexp_replace(flat, rf"[\s{BREAKS}{GLUE}{PAD}]+", " ")
        return F.trim(F.replace(flat, F.lit("|"), F.lit(r"\|")))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def render(rows: Column) -> Column:
        rule = line(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---")))
        lines = let(
            F.transform(rows, line),
            lambda ls: F.concat(F.array(F.get(ls, F.lit(0)), rule), _tail(ls)),
        )
        return F.when(
            F.size(rows) > 0, F.concat(F.lit(PARA), F.array_join(lines, LINE), F.lit(PARA))
        ).otherwise("")

    def table(t: Column) -> Column:
        rows = F.transform(
            _cut(t, r"(?i)<tr(?:\s[^>]*)?>"),
            lambda r: let(
                F.split(F.regexp_replace(r, CELL, CUT), CUT),
                lambda cs: F.transform(_tail(cs), cell),
            ),
        )
        return let(F.filter(rows, lambda cells: F.size(cells) > 0), render)

    pieces = F.split(F.regexp_replace(html, INNER_TABLE, CUT + "$0" + CUT), CUT)
    return join(
        F.transform(pieces, lambda p: F.when(p.rlike("(?i)^<table"), table(p)).otherwise(p))
    )


def _quotes(md: Column) -> Column:
    """Prefix the lines between quote markers."""
    def step(depth: Column, line: Column) -> Column:
        return (
            F.when(line == QUOTE, depth + 1)
            .when(line == QUOTE_END, F.greatest(depth - 1, F.lit(0)))
            .otherwise(depth)
        )

    def emit(depth: Column, line: Column) -> Column:
        quoted = F.rtrim(F.concat(F.repeat(F.lit("> "), depth), line))
        return F.when((depth == 0) | line.isin(QUOTE, QUOTE_END), line).otherwise(quoted)

    lines = join_lines(running(F.split(md, "\n"), F.lit(0), step, emit, "string"))
    # markers go with the empty quoted lines next to them
    lines = F.regexp_replace(lines, rf"{QUOTE}\n(?:>[> ]*\n|\n)*+", "")
    lines = F.regexp_replace(lines, rf"(?:>[> ]*+\n)*+{QUOTE_END}\n?", "")
    return F.regexp_replace(lines, r"\n+\z", "")


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


# ------------------------------------------------------------------------ code

@reused
def code_of(pre: Column) -> Column:
    """Text of a ``pre`` element."""
    inner = F.regexp_replace(_after_first_tag(pre), r"(?i)</pre\s*>$", "")
    broken = F.regexp_replace(inner, r"(?i)<br\s*/?>", "\n")
    return decode_entities(F.regexp_replace(broken, TAG_RE, ""))


@reused
def lang_of(pre: Column) -> Column:
    """Language of a ``pre`` element: class of its ``code``, else its own class."""
    code_tag = F.regexp_extract(pre, r"(?i)<code(?:\s[^>]*)?>", 0)
    pre_tag = F.regexp_extract(pre, r"^<[^>]*>", 0)
    langs = F.transform(
        F.when(code_tag == "", F.array().cast("array<string>")).otherwise(
            F.array(code_tag, pre_tag)),
        lambda tag: lang_from_class(F.coalesce(attr(tag, "class"), F.lit(""))),
    )
    return F.coalesce(F.get(F.filter(langs, lambda name: name != ""), F.lit(0)), F.lit(""))


def pre_elements(html: Column) -> Column:
    return F.regexp_extract_all(strip_comments(html), F.lit(PRE), F.lit(0))


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")


def _fence(pre: Column, detect_unlabelled: bool) -> Column:
    code = F.regexp_replace(F.regexp_replace(code_of(pre), r"^\n", ""), r"\s+\z", "")

    def build(s: Column) -> Column:
        lang = s["lang"]
        if detect_unlabelled:
            lang = F.when(lang == "", detect_code_language(s["code"])).otherwise(lang)
        return F.concat(F.lit("```"), lang, F.lit("\n"), s["code"], F.lit("\n```"))

    return let(F.struct(code.alias("code"), lang_of(pre).alias("lang")), build)


# ---------------------------------------------------------------- running text

def _mark_tags(html: Column) -> Column:
    """Every tag to a marker or to nothing."""
    def link(tok: Column) -> Column:
        href = attr(tok, "href")
        title = F.when(_has(tok, "title"), attr(tok, "title"))
        named = F.when(title.isNotNull(), F.concat(F.lit(' "'), title, F.lit('"'))).otherwise("")
        return F.when(
            href.isNotNull(), F.concat(F.lit(LINK), href, named, F.lit(LINK_MID))
        ).otherwise("")

    def image(tok: Column) -> Column:
        return F.concat(
            F.lit(IMG), F.coalesce(attr(tok, "alt"), F.lit("")),
            F.lit(IMG_MID), F.coalesce(attr(tok, "src"), F.lit("")), F.lit(IMG_END),
        )

    def marker(tok: Column, name: Column) -> Column:
        closing = tok.startswith("</")
        heading = F.concat(F.lit(PARA + HEAD), F.substring(name, 2, 1))

        def pair(opening: str, ending: str) -> Column:
            return F.when(closing, ending).otherwise(opening)

        return (
            F.when((name == "a") & closing, LINK_END)
            .when(name == "a", link(tok))
            .when(name.isin("b", "strong"), pair(STRONG, STRONG_END))
            .when(name.isin("i", "em"), pair(EM, EM_END))
            .when(name == "br", BR)
            .when(name.rlike("^h[1-6]$"), F.when(closing, PARA).otherwise(heading))
            .when(name == "hr", f"{PARA}---{PARA}")
            .when(name == "blockquote",
                  pair(f"{PARA}{QUOTE}{PARA}", f"{PARA}{QUOTE_END}{PARA}"))
            .when(name.isin(*LINE_NAMES), PARA)
            .when(name.isin("code", "kbd", "samp"), pair(CODE, CODE_END))
            .when(name.isin("del", "s"), "~~")
            .when(name == "img", image(tok))
            .otherwise("")
        )

    return map_tags(html, marker)


def _close_at_block_end(s: Column, opening: str, closing: str) -> Column:
    """End emphasis that is still open where its block ends."""
    return F.regexp_replace(
        s,
        rf"{opening}([^{opening}{closing}{PARA}{LINE}]*?)([ {BR}]*)([{PARA}{LINE}]|\z)",
        f"{opening}$1{closing}$2$3",
    )


def _emphasis(s: Column, opening: str, closing: str, symbol: str) -> Column:
    s = _close_at_block_end(s, opening, closing)
    s = F.regexp_replace(s, f"{opening}[ {BR}]*{closing}", "")
    s = F.regexp_replace(
        s,
        f"{opening}( ?)([^{opening}{closing}{PARA}{LINE}]*?)( ?){closing}",
        f"$1{symbol}$2{symbol}$3",
    )
    return F.regexp_replace(s, f"[{opening}{closing}]", "")


def _escape(s: Column) -> Column:
    """Backslash before ``*`` and ``_``, but not in URLs and code."""
    kept = f"{LINK}[^{LINK_MID}]*{LINK_MID}|{IMG_MID}[^{IMG_END}]*{IMG_END}|{CODE}[^{CODE_END}]*{CODE_END}"
    pieces = F.regexp_extract_all(
        s, F.lit(f"{kept}|[^{LINK}{IMG_MID}{CODE}]+|[{LINK}{IMG_MID}{CODE}]"), F.lit(0)
    )
    return join(
        F.transform(
            pieces,
            lambda p: F.when(p.rlike(f"^[{LINK}{IMG_MID}{CODE}]"), p).otherwise(
                F.regexp_replace(p, r"([*_])", r"\\$1")
            ),
        )
    )


def _links(s: Column) -> Column:
    # a link around blocks becomes one line
    pieces = F.regexp_extract_all(
        s, F.lit(f"{LINK}[^{LINK}{LINK_END}]*{LINK_END}|[^{LINK}]+|{LINK}"), F.lit(0)
    )
    flat = join(
        F.transform(
            pieces,
            lambda p: F.when(
                p.rlike(f"^{LINK}"),
                F.regexp_replace(p, f"[ {BREAKS}]*[{BREAKS}][ {BREAKS}]*(?:{HEAD}[1-6])?", " "),
            ).otherwise(p),
        )
    )
    s = F.when(s.rlike(f"{LINK_MID}[^{LINK_END}]*[{BREAKS}]"), flat).otherwise(s)
    s = F.regexp_replace(s, rf"{LINK}([^{LINK_MID}]+){LINK_MID}\1{LINK_END}", "<$1>")
    s = F.regexp_replace(s, f"{LINK}[^{LINK_MID}]*{LINK_MID} *{LINK_END}", "")
    s = F.regexp_replace(
        s, f"{LINK}([^{LINK_MID}]*){LINK_MID}( ?)([^{LINK}{LINK_END}]*?)( ?){LINK_END}",
        "$2[$3]($1)$4",
    )
    return F.regexp_replace(s, f"{LINK}[^{LINK_MID}]*{LINK_MID}|{LINK_END}", "")


def _running_text(html: Column, escape: bool) -> Column:
    s = decode_entities(squeeze_space(_mark_tags(html)))
    if escape:
        s = _where(("*", "_"), _escape)(s)
    s = _where((STRONG,), lambda t: _emphasis(t, STRONG, STRONG_END, "**"))(s)
    s = _where((EM,), lambda t: _emphasis(t, EM, EM_END, "*"))(s)
    s = _where(
        (IMG,),
        lambda t: F.regexp_replace(
            t, f"{IMG}([^{IMG_MID}]*){IMG_MID}([^{IMG_END}]*){IMG_END}", "![$1]($2)"
        ),
    )(s)
    s = _where((LINK,), _links)(s)
    s = _where(
        (CODE, CODE_END, STRONG_END, EM_END, LINK_END),
        lambda t: F.translate(
            F.regexp_replace(t, f"{CODE} *{CODE_END}|{STRONG_END}|{EM_END}|{LINK_END}", ""),
            CODE + CODE_END, "``",
        ),
    )(s)
    s = _where((GLUE,), lambda t: F.regexp_replace(t, f"{GLUE}[ {BREAKS}]*", ""))(s)
    s = _where((HEAD,), _headings)(s)
    s = F.regexp_replace(s, f"[ {LINE}{BR}]*{PARA}[ {BREAKS}]*", "\n\n")
    s = _where((LINE,), lambda t: F.regexp_replace(t, f"[ {BR}]*{LINE}[ {LINE}{BR}]*", "\n"))(s)
    s = _where((BR,), lambda t: F.regexp_replace(t, f" ?{BR} ?", "  \n"))(s)
    return trim_space(F.replace(s, F.lit(PAD), F.lit(" ")))


def _headings(s: Column) -> Column:
    s = F.regexp_replace(s, f"{HEAD}[1-6] ?{PARA}", PARA)
    s = F.regexp_replace(s, f"({HEAD}[1-6]) ", "$1")
    for level in range(1, 7):
        s = F.replace(s, F.lit(f"{HEAD}{level}"), F.lit("#" * level + " "))
    return s


@reused
def html_to_markdown(
    html: Column,
    escape: bool = True,
    detect_unlabelled: bool = False,
    dropped: tuple[str, ...] = DROPPED_TAGS,
) -> Column:
    """Markdown of an HTML string; NULL for NULL or empty input.

    ``detect_unlabelled`` also labels code whose class names no language.
    """
    s = fragment_drop_regions(protect(html), dropped)
    s = _where(("<li", "<ul", "<ol"), _lists, any_case=True)(s)
    s = _where(("<table",), _tables, any_case=True)(s)
    pieces = F.split(F.regexp_replace(s, PRE, CUT + "$0" + CUT), CUT)

    def render(p: Column) -> Column:
        return F.when(p.rlike(r"(?i)^<pre[\s/>]"), _fence(p, detect_unlabelled)).otherwise(
            _running_text(p, escape)
        )

    md = F.array_join(F.filter(F.transform(pieces, render), lambda p: p != ""), "\n\n")
    return F.when(html != "", _where((QUOTE,), _quotes)(md))


@reused
def with_metadata_header(md: Column, title: Column, url: Column, captured_at: Column) -> Column:
    """Title, source and capture time on top of the trimmed Markdown."""
    stamp = F.date_format(F.to_utc_timestamp(captured_at, F.current_timezone()),
                          "yyyy-MM-dd HH:mm:ss")
    return F.concat(
        F.lit("# "), title, F.lit("\n\n**Source**: "), url, F.lit("  \n**Captured**: "),
        stamp, F.lit(" UTC\n\n---\n\n"), trim_space(md),
    )


def conversion_fallback(title: Column, url: Column, error: Column, html: Column) -> Column:
    """What stands in for the Markdown of a page that could not be converted."""
    preview = F.when(html.isNull(), "").otherwise(
        F.concat(F.substring(html, 1, 1000), F.lit("..."))
    )
    return F.concat(
        F.lit("# "), title, F.lit("\n\n**Source**: "), url,
        F.lit("  \n**Error**: Failed to convert to Markdown: "), error,
        F.lit("\n\n```\n"), preview, F.lit("\n```\n"),
    )


NO_HTML = "No HTML content provided"


@reused
def convert(html: Column, title: Column, url: Column, captured_at: Column, **options) -> Column:
    """Markdown with its header, or the fallback for NULL and empty HTML."""
    return F.when(
        html.isNull() | (html == ""), conversion_fallback(title, url, F.lit(NO_HTML), html)
    ).otherwise(
        with_metadata_header(html_to_markdown(html, **options), title, url, captured_at)
    )


# ---------------------------------------------------------------------- repairs

FRAGMENT_PIECES = FRAGMENT_JAVA + "|[^`]+|`"


def fragments(md: Column) -> Column:
    """Inline code whose lines all start with a number, in order."""
    return F.filter(_fragment_pieces(md), is_fragment)


def _fragment_pieces(md: Column) -> Column:
    return F.regexp_extract_all(md, F.lit(FRAGMENT_PIECES), F.lit(0))


def is_fragment(piece: Column) -> Column:
    return piece.startswith("`") & (F.length(piece) > 1)


def fragment_code(piece: Column) -> Column:
    inner = F.regexp_replace(piece, "^`|`$", "")
    return F.regexp_replace(inner, r"(?md)^\p{Nd}+", "")


@reused
def fix_fragmented_code(md: Column) -> Column:
    """Numbered inline code to fenced blocks without the numbers."""
    def piece(p: Column) -> Column:
        fenced = let(
            fragment_code(p),
            lambda code: F.concat(
                F.lit("\n```"), detect_code_language(code), F.lit("\n"), code, F.lit("\n```\n")
            ),
        )
        return F.when(is_fragment(p), fenced).otherwise(p)

    return _where(("`",), lambda t: join(F.transform(_fragment_pieces(t), piece)))(md)


@reused
def clean_markdown(md: Column) -> Column:
    """Of consecutive blank lines keep the first."""
    blank = f"[{INLINE_SPACE_CHARS}]*+"
    return F.regexp_replace(
        md, rf"((?:(?<=\n)|\A){blank})(?:\n{blank}(?=\n|\z))++", "$1"
    )
