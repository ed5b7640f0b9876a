"""HTML as strings and arrays inside one row: text, regions, subtrees, blocks.

A page is one row, so everything here is a map over rows: no shuffle, no sort, no
row identity needed, and the same expressions work on streams. Structure is read
from the few tags that matter for an operator; the page is cut at those tags and a
running state (see ``arrays.running``) decides what to keep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemark.dialect import (
    BLOCK_TAGS, DROPPED_TAGS, ENTITIES, LINE_TAGS, NAMED_REFERENCES, LOOSE_SPACE_JAVA, NON_SPACE_RE,
    QUOTED_GT_DOUBLE_JAVA, QUOTED_GT_RE, QUOTED_GT_SINGLE_JAVA, RAW_RE, SPACE_LITERALS,
    TAG_NAME, TAG_RE, TOKEN_RE, VOID_TAGS, tags_re,
)
from pagemark.functions.arrays import constant_map, join, let, reused, running

BREAK = "\x01"      # stands for a line break that markup asks for
CUT = "\x02"        # marks the places a page is cut at
MARKERS = r"[\x01-\x08\x0e-\x1b\x7f]"

RAW_START = r"(?i)^<(?:script|style)[\s/>]"
LINE_NAMES = tuple(
    name for tag in LINE_TAGS
    for name in ([f"h{n}" for n in range(1, 7)] if tag == "h[1-6]" else [tag])
)
FIRST_TAG = r"^<[^>]*>"
ENTITY_PIECES = r"&#?[a-zA-Z0-9]+;|[^&]+|&"
LINK_CONTENT = r"(?is)<a(?:\s[^>]*)?>(.*?)(?:</a\s*>|\z)"
LAST_LINK_TAG = r"(?is)^.*(</?a(?:\s[^>]*)?>)"


@reused
def protect(html: Column) -> Column:
    """Make ``html`` safe for the tag regexes.

    Marker characters go, and ``>`` inside quoted attribute values becomes ``&gt;``.
    """
    def clean(h: Column) -> Column:
        bare = F.regexp_replace(h, MARKERS, "")
        return F.regexp_replace(
            F.regexp_replace(bare, QUOTED_GT_DOUBLE_JAVA, "$1$2&gt;"),
            QUOTED_GT_SINGLE_JAVA, "$1$2&gt;",
        )

    return let(
        html, lambda h: F.when(h.rlike(f"{MARKERS}|{QUOTED_GT_RE}"), clean(h)).otherwise(h)
    )


def token_array(html: Column) -> Column:
    """All tags, texts, comments and raw blocks of a page, in order and lossless."""
    return F.regexp_extract_all(html, F.lit(TOKEN_RE), F.lit(0))


def token_tag(tok: Column) -> Column:
    return F.lower(F.regexp_extract(tok, f"^</?({TAG_NAME})", 1))


def token_kind(tok: Column) -> Column:
    tag = token_tag(tok)
    return (
        F.when(tok.rlike(r"^<[!?]"), "comment")
        .when(tok.rlike(r"(?i)^<(?:script|style)(?:[\s/>])"), "raw")
        .when(tag == "", "text")
        .when(tok.startswith("</"), "close")
        .when(tag.isin(*VOID_TAGS) | tok.endswith("/>"), "void")
        .otherwise("open")
    )


def token_attrs(tok: Column) -> Column:
    return F.trim(F.regexp_extract(tok, rf"^<{TAG_NAME}([^>]*?)/?>", 1))


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute inside one opening tag; NULL if it is not there."""
    # whole attributes before it are stepped over, so a value is never looked into
    value_re = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
    other = rf"(?!{name}\s*=)[^\s>/][^\s=>/]*+(?:\s*+=\s*+{value_re})?+"
    pattern = (
        rf"(?is)^<[^\s/>]*+(?:[\s/]*+{other})*+[\s/]*+{name}\s*=\s*"
        r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    )

    def value(t: Column) -> Column:
        parts = F.concat(*(F.regexp_extract(t, pattern, i) for i in (1, 2, 3)))
        return F.when(t.rlike(pattern), decode_entities(parts))

    return let(tag, value)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references to characters, in one pass.

    A control character stands for a marker later on, so a number that means one becomes
    the replacement character.
    """
    common = constant_map(dict(ENTITIES))
    named = constant_map(NAMED_REFERENCES)

    def character(code: Column) -> Column:
        """Character of a hexadecimal code point; NULL if there is none."""
        number = F.conv(code, 16, 10).cast("int")
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        control = ((number < 32) & ~number.isin(9, 10, 13)) | (number == 127)
        return F.when(valid & control, "\ufffd").when(
            valid, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))

    def number(p: Column) -> Column:
        hexes = F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]{1,6});$", 1)
        digits = F.regexp_extract(p, "^&#([0-9]{1,7});$", 1)
        return let(F.when(hexes != "", hexes).otherwise(F.conv(digits, 10, 16)), character)

    def piece(p: Column) -> Column:
        found = F.when(p.startswith("&#"), number(p)).otherwise(
            F.coalesce(F.element_at(common, p), F.element_at(named, p)))
        return F.when(p == "&amp;", "&").when(
            p.startswith("&"), F.coalesce(found, p)
        ).otherwise(p)

    return let(
        text,
        lambda t: F.when(
            F.contains(t, F.lit("&")),
            join(F.transform(F.regexp_extract_all(t, F.lit(ENTITY_PIECES), F.lit(0)), piece)),
        ).otherwise(t),
    )


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_LITERALS))


def squeeze_space(text: Column) -> Column:
    """Every run of whitespace becomes one blank."""
    return F.regexp_replace(text, LOOSE_SPACE_JAVA, " ")


def map_tags(html: Column, change: Callable[[Column, Column], Column]) -> Column:
    """Replace every tag by ``change(tag, name)``; comments and raw blocks go.

    One pass over the page finds the tags; what is done with them then looks at short
    strings only.
    """
    def piece(tok: Column) -> Column:
        # a "<" that opens no tag is text
        tag = let(
            token_tag(tok),
            lambda name: F.when(name != "", change(tok, name)).otherwise(tok),
        )
        return (
            F.when(~tok.startswith("<"), tok)
            .when(tok.startswith("<!") | tok.startswith("<?") | tok.rlike(RAW_START), "")
            .otherwise(tag)
        )

    return join(F.transform(token_array(html), piece))


def count_words(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(text, F.lit(NON_SPACE_RE))


def strip_raw(html: Column) -> Column:
    """Drop scripts, styles, comments and declarations."""
    return F.regexp_replace(html, RAW_RE, "")


@reused
def fragment_text(html: Column) -> Column:
    """``visible_text`` for HTML that went through ``protect`` already."""
    s = map_tags(
        html, lambda tok, name: F.when(name.isin(*LINE_NAMES, "br"), BREAK).otherwise("")
    )
    s = F.regexp_replace(squeeze_space(s), f" ?{BREAK}[{BREAK} ]*", "\n")
    return trim_space(decode_entities(s))


@reused
def visible_text(html: Column) -> Column:
    """Text as a reader sees it: block tags break lines, entities are decoded."""
    return fragment_text(protect(html))


@reused
def page_text(html: Column) -> Column:
    """Visible text of the body of a whole page."""
    head = r"(?is)<head(?:\s[^>]*)?>.*?</head\s*>|<title(?:\s[^>]*)?>.*?</title\s*>"
    return fragment_text(F.regexp_replace(strip_raw(protect(html)), head, ""))


@reused
def document_title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)
    return trim_space(squeeze_space(decode_entities(raw)))


# ------------------------------------------------------------------- regions

def _cut(html: Column, at: str) -> Column:
    """Cut before every match of ``at``; element 0 is what precedes the first."""
    return F.split(F.regexp_replace(html, at, CUT + "$0"), CUT)


def _after_first_tag(part: Column) -> Column:
    return F.regexp_replace(part, FIRST_TAG, "")


def _self_closing(part: Column) -> Column:
    return part.rlike(r"^<[^>]*/>")


def _region_pieces(
    html: Column, cut_at: str, opens: Callable[[Column], Column], inside: bool
) -> Column:
    """Text inside (or outside) the outermost regions that ``opens`` starts.

    A region belongs to the tag that opened it and ends when that tag's own depth
    returns to zero; without an end tag it runs to the end of the page.
    """
    def step(state: Column, part: Column) -> Column:
        def decide(name: Column) -> Column:
            same = (state["depth"] > 0) & (name == state["tag"])
            starts = (state["depth"] == 0) & opens(part) & ~part.startswith("</")
            return (
                F.when(
                    starts & ~_self_closing(part) & ~name.isin(*VOID_TAGS),
                    F.struct(name.alias("tag"), F.lit(1).alias("depth"),
                             F.lit(True).alias("edge")),
                )
                .when(
                    same & part.startswith("</"),
                    F.struct(name.alias("tag"), (state["depth"] - 1).alias("depth"),
                             (state["depth"] == 1).alias("edge")),
                )
                .when(
                    same & ~_self_closing(part),
                    F.struct(name.alias("tag"), (state["depth"] + 1).alias("depth"),
                             F.lit(False).alias("edge")),
                )
                .otherwise(
                    F.struct(state["tag"].alias("tag"), state["depth"].alias("depth"),
                             F.lit(False).alias("edge"))
                )
            )

        return let(token_tag(part), decide)

    def emit(state: Column, part: Column) -> Column:
        within = state["depth"] > 0
        if inside:
            kept = F.when(state["edge"], _after_first_tag(part)).otherwise(part)
            return F.when(within, kept).otherwise("")
        stray = state["edge"] | opens(part) | part.startswith("</")
        kept = F.when(stray, _after_first_tag(part)).otherwise(part)
        return F.when(within, "").otherwise(kept)

    start = F.struct(
        F.lit("").alias("tag"), F.lit(0).alias("depth"), F.lit(False).alias("edge")
    )

    def assemble(parts: Column) -> Column:
        rest = running(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            start, step, emit, "string",
        )
        head = F.lit("") if inside else F.get(parts, F.lit(0))
        return F.when(F.size(parts) > 1, F.concat(head, join(rest))).otherwise(head)

    return let(_cut(html, cut_at), assemble)


def fragment_drop_regions(html: Column, tags: tuple[str, ...] = DROPPED_TAGS) -> Column:
    """``drop_regions`` for protected HTML: scripts and styles first, then the others."""
    others = tuple(t for t in tags if t not in ("script", "style"))
    return _region_pieces(strip_raw(html), tags_re(others), lambda part: F.lit(True), inside=False)


@reused
def drop_regions(html: Column, tags: tuple[str, ...] = DROPPED_TAGS) -> Column:
    """Remove the elements named in ``tags`` with all they contain.

    Scripts, styles and comments go in any case.
    """
    return fragment_drop_regions(protect(html), tags)


def keep_regions(html: Column, open_re: Column) -> Column:
    """Content of all elements whose opening tag matches, one after another."""
    return _region_pieces(
        html, TAG_RE, lambda part: F.rlike(part, F.concat(F.lit("^"), open_re)), inside=True
    )


def first_subtree(html: Column, open_re: Column | str) -> Column:
    """Inner HTML of the first element whose opening tag matches; NULL if none."""
    open_re = F.lit(open_re) if isinstance(open_re, str) else open_re

    def step(depth: Column, part: Column) -> Column:
        return (
            F.when(depth == 0, 0)
            .when(part.startswith("</"), depth - 1)
            .when(_self_closing(part), depth)
            .otherwise(depth + 1)
        )

    def assemble(parts: Column) -> Column:
        tail = running(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            F.lit(1), step,
            lambda depth, part: F.when(depth > 0, part).otherwise(""), "string",
        )
        return F.concat(F.get(parts, F.lit(0)), join(tail))

    def inner(s: Column) -> Column:
        rest = F.substr(s["html"], F.instr(s["html"], s["open"]) + F.length(s["open"]))
        same_tag = F.concat(F.lit("(?i:</?"), token_tag(s["open"]), F.lit(r")(?:[\s/][^>]*)?>"))
        parts = F.split(F.regexp_replace(rest, same_tag, F.lit(CUT + "$0")), CUT)
        return F.when(
            s["open"] != "",
            F.when(token_tag(s["open"]).isin(*VOID_TAGS), "").otherwise(let(parts, assemble)),
        )

    opening = F.call_function("regexp_extract", html, open_re, F.lit(0))
    return let(F.struct(html.alias("html"), opening.alias("open")), inner)


# -------------------------------------------------------------------- blocks

BLOCK_TYPE = "struct<html:string,words:int,link_words:int,inside:boolean,tag:string>"
KEPT_NAMES = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote")


def _may_link(block: Column) -> Column:
    return block.contains("<a") | block.contains("<A")


@reused
def text_blocks(html: Column) -> Column:
    """Non-empty text blocks of a page with word and link-word counts.

    ``inside`` says whether the block lies in an ``article`` or ``main`` element. A
    link that is still open when a block starts counts in that block as well.
    """
    def step(state: Column, block: Column) -> Column:
        def moved(name: Column) -> Column:
            landmark = name.isin("article", "main")
            depth = (
                F.when(landmark & block.startswith("</"),
                       F.greatest(state["depth"] - 1, F.lit(0)))
                .when(landmark, state["depth"] + 1)
                .otherwise(state["depth"])
            )
            last = F.when(
                _may_link(block) | block.contains("</a") | block.contains("</A"),
                F.regexp_extract(block, LAST_LINK_TAG, 1),
            ).otherwise("")
            link = F.when(last != "", ~last.startswith("</")).otherwise(state["link"])
            return F.struct(
                depth.alias("depth"), link.alias("link"), state["link"].alias("carried")
            )

        return let(token_tag(block), moved)

    def emit(state: Column, block: Column) -> Column:
        text = F.regexp_replace(block, TAG_RE, "")
        source = F.when(state["carried"], F.concat(F.lit("<a>"), block)).otherwise(block)
        links = F.array_join(
            F.regexp_extract_all(source, F.lit(LINK_CONTENT), F.lit(1)), " "
        )
        link_words = F.when(
            state["carried"] | _may_link(block), count_words(F.regexp_replace(links, TAG_RE, ""))
        ).otherwise(0)
        tag = F.when(block.startswith("</"), "").otherwise(token_tag(block))
        return F.struct(
            block.alias("html"), count_words(text).alias("words"),
            link_words.alias("link_words"), (state["depth"] > 0).alias("inside"),
            tag.alias("tag"),
        )

    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("link"), F.lit(False).alias("carried")
    )
    cleaned = fragment_drop_regions(html, (*DROPPED_TAGS, "title"))
    blocks = running(_cut(cleaned, tags_re(BLOCK_TAGS)), start, step, emit, BLOCK_TYPE)
    return F.filter(blocks, lambda b: b["words"] > 0)


def content_blocks(blocks: Column) -> Column:
    """The blocks that belong to the main content.

    Shallow-text-feature rules: link density of the block and its left neighbour and
    the word counts of the three. Inside ``article``/``main`` the link density alone
    decides, and a heading right before a kept block is kept.
    """
    def density(b: Column) -> Column:
        return F.coalesce(b["link_words"] / b["words"], F.lit(0.0))

    def words(b: Column) -> Column:
        return F.coalesce(b["words"], F.lit(0))

    def flags(bs: Column) -> Column:
        def keep(cur: Column, i: Column) -> Column:
            prev, nxt = F.get(bs, i - 1), F.get(bs, i + 1)
            after_text = (words(cur) > 16) | (words(nxt) > 15) | (words(prev) > 4)
            after_links = (words(cur) > 40) | (words(nxt) > 17)
            by_rule = F.when(density(prev) <= 5 / 9, after_text).otherwise(after_links)
            return (density(cur) <= 1 / 3) & (cur["inside"] | by_rule)

        return F.transform(bs, keep)

    def select(bs: Column) -> Column:
        return let(
            flags(bs),
            lambda keep: F.filter(
                bs,
                lambda b, i: F.get(keep, i)
                | (b["tag"].isin("h1", "h2", "h3") & F.coalesce(F.get(keep, i + 1), F.lit(False))),
            ),
        )

    return let(blocks, select)


def blocks_html(blocks: Column) -> Column:
    """Well-formed HTML made of text blocks."""
    def render(b: Column) -> Column:
        body = F.when(
            (b["tag"] == "") & ~b["html"].startswith("</"), b["html"]
        ).otherwise(_after_first_tag(b["html"]))
        name = F.when(b["tag"].isin(*KEPT_NAMES), b["tag"]).otherwise("p")
        plain = F.concat(F.lit("<"), name, F.lit(">"), body, F.lit("</"), name, F.lit(">"))
        # code keeps its attributes, they carry the language
        return F.when(b["tag"] == "pre", F.concat(b["html"], F.lit("</pre>"))).otherwise(plain)

    return join(F.transform(blocks, render))


@reused
def density_html(html: Column) -> Column:
    """Main content of any page as HTML, by text density; empty if there is none."""
    return blocks_html(content_blocks(text_blocks(protect(html))))
