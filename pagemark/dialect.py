"""Constants every module shares: character classes, regexes, limits, word lists.

Spark evaluates regexes with ``java.util.regex``, DuckDB (the checking side) with
RE2. Patterns named ``*_RE`` are valid in both; patterns named ``*_JAVA`` use
look-around or possessive repetition, which only Java has. Repetition of a group
is written possessively wherever the count depends on the data, because Java walks
a possessive loop with a counter and a backtracking one with its call stack.
"""

from __future__ import annotations

from html.entities import html5

# ---------------------------------------------------------------- characters
# ``\w`` of a Unicode-aware engine, and the whitespace that ``str.split()`` uses.
WORD = r"[\p{L}\p{N}_]"
WORDS_RE = WORD + "+"
SPACE_CHARS = r"\t-\r\x1c-\x20\x{85}\p{Z}"
SPACE_RE = f"[{SPACE_CHARS}]+"
NON_SPACE_RE = f"[^{SPACE_CHARS}]+"
# whitespace without the newline, for line-wise work
INLINE_SPACE_CHARS = r"\t\x0b-\r\x1c-\x20\x{85}\p{Z}"
# the same characters one by one, for trimming without a regex
SPACE_LITERALS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# whitespace that collapsing would change: everything but single blanks
LOOSE_SPACE_JAVA = rf"[{SPACE_CHARS}&&[^ ]][{SPACE_CHARS}]*| [{SPACE_CHARS}]+"
TRIM_RE = f"^[{SPACE_CHARS}]+|[{SPACE_CHARS}]+$"

# ---------------------------------------------------------------- HTML
TAG_NAME = r"[a-zA-Z][a-zA-Z0-9:-]*"
# alternatives share their first character, so a text position is ruled out at once
RAW_RE = (
    r"(?is)<(?:script\b.*?(?:</script\s*>|\z)"
    r"|style\b.*?(?:</style\s*>|\z)"
    r"|!--.*?(?:-->|\z)"
    r"|[!?][^>]*>)"
)
TAG_RE = r"</?[a-zA-Z][^>]*>"
TOKEN_RE = RAW_RE + "|" + TAG_RE + r"|[^<]+|<"
# ``>`` inside a quoted attribute value, which would end the tag too early
QUOTED_GT_RE = r"""=\s*(?:"[^"<>]*>[^"<]*"|'[^'<>]*>[^'<]*')"""
QUOTED_GT_DOUBLE_JAVA = r"""(\G(?!\A)|=\s*")([^"<>]*)>(?=[^"<]*")"""
QUOTED_GT_SINGLE_JAVA = r"""(\G(?!\A)|=\s*')([^'<>]*)>(?=[^'<]*')"""

DROPPED_TAGS = ("script", "style", "nav", "footer", "header", "aside", "iframe")

# tags that start a new line in visible text
LINE_TAGS = (
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h[1-6]", "head", "header",
    "hr", "html", "iframe", "legend", "li", "main", "nav", "ol", "p", "pre", "section",
    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
)
# tags that start a new text block in the density classifier
BLOCK_TAGS = (
    "article", "blockquote", "body", "div", "h[1-6]", "li", "main", "ol", "p", "pre",
    "section", "table", "td", "th", "tr", "ul",
)
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "source", "track", "wbr",
)


def tags_re(names: tuple[str, ...] | list[str], closing: bool = True) -> str:
    """Regex for the opening (and closing) tags of ``names``, any case."""
    slash = "/?" if closing else ""
    return rf"(?i:<{slash}(?:{'|'.join(names)}))(?:[\s/][^>]*)?>"


# frequent references, looked up first; the ampersand comes last so that ``&amp;lt;``
# becomes ``&lt;`` and not ``<``
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&#x27;", "'"), ("&#34;", '"'), ("&#60;", "<"), ("&#62;", ">"), ("&#160;", " "),
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
    ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"),
    ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"),
    ("&pound;", "£"), ("&deg;", "°"), ("&times;", "×"),
    ("&szlig;", "ß"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"),
    ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"),
    ("&eacute;", "é"), ("&egrave;", "è"), ("&agrave;", "à"),
    ("&ccedil;", "ç"), ("&ntilde;", "ñ"), ("&#38;", "&"), ("&amp;", "&"),
)

# all named references of HTML, as the standard library lists them
NAMED_REFERENCES = {f"&{name}": char for name, char in html5.items() if name.endswith(";")}

# ---------------------------------------------------------------- fixed values
# Limits, weights and word lists that results depend on; they have to equal the
# values of the engine whose results are matched.
MAX_TEXT_LEN = 50000
MIN_ARTICLE_CHARS = 500          # an extraction must be longer than this
PROBE_BELOW_CHARS = 500          # a re-fetched extraction below this is probed
TIE_THRESHOLD = 0.05
BLOCKER_PENALTY = 0.3
FETCH_TIMEOUT = "15 seconds"
WEIGHT_LEN, WEIGHT_DENSITY, WEIGHT_STRUCTURE = 0.35, 0.20, 0.10
WEIGHT_FRESHNESS, WEIGHT_LINKS = 0.10, 0.05

DATE_PATTERNS = (
    r"\d{4}-\d{2}-\d{2}",
    r"\d{1,2}/\d{1,2}/\d{4}",
    r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+\d{4}",
)
LINK_PATTERN = r"\[([^\]]+)\]\(([^)]+)\)"
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "msclkid", "ref", "source",
)
TOKEN_PARAMS = ("token", "api_key", "key", "secret", "auth")
LOGIN_WORDS = ("sign in", "log in", "login", "password", "authenticate", "session expired")
PAYWALL_WORDS = (
    "subscribe", "subscription", "premium", "member", "free trial", "unlock", "paywall",
)
CAPTCHA_WORDS = ("captcha", "recaptcha", "hcaptcha", "cf-challenge")
ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting")
CONFIDENCE = {"schema": 0.95, "semantic": 0.85, "readability": 0.70}
BLOCKER_CODES = (
    "content-mismatch", "login-required", "paywall", "captcha", "cross-origin-iframe",
    "content-too-thin", "csp-blocked", "fetch-failed", "extraction-failed",
)
# ---------------------------------------------------------------- end of fixed values

FRAGMENT_RE = r"`(\p{Nd}+[^\n`]*(?:\n\p{Nd}+[^\n`]*)*)`"
FRAGMENT_JAVA = r"`(\p{Nd}+[^\n`]*+(?:\n\p{Nd}+[^\n`]*+)*+)`"
URL_RE = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
