from urllib.parse import parse_qs, urlencode, urljoin, urlparse, urlunparse

from pyspark.sql import functions as F

from pagemark.dialect import TRACKING_PARAMS
from pagemark.functions import urls as U


def strip(url):
    p = urlparse(url)
    kept = {k: v for k, v in parse_qs(p.query).items() if k not in TRACKING_PARAMS}
    return urlunparse(p._replace(query=urlencode(kept, doseq=True)))


TRACKED = [
    *(f"https://x.org/a?{name}=1&k=v" for name in TRACKING_PARAMS),
    "https://x.org/a?UTM_SOURCE=1", "https://x.org/a?b=&c=1", "https://x.org/a?b=1&c=2&b=3#frag",
    "https://x.org/a?q=a%20b+c*~", "https://x.org/a?q=100%&r=%zz%41", "https://x.org/a?=v&k",
    "https://x.org/a?q=%C3%A9&r=é", "https://x.org?", "https://x.org/a#", "HTTP://X.org/A;p?q=1",
    "mailto:a@b.c?x=1&ref=2", "https://x.org/a?b==c", "//x.org/p?ref=1&a=b", "/p/q?a=1&ref=2",
    "https://x.org/a?utm%5Fsource=1&z=2", "",
]


def test_strip_tracking_equals_the_standard_library(apply):
    assert apply(U.strip_tracking, TRACKED) == [strip(u) for u in TRACKED]


def test_unparsable_url_stays(apply):
    assert apply(U.strip_tracking, ["http://[x/a?ref=1"]) == ["http://[x/a?ref=1"]


BASES = ["http://h.org/a/b/c?q=1#f", "https://h.org", "http://h.org/", "http://h.org/a/b/",
         "http://h.org/a//b/../c"]
REFS = ["x", "./x", "../x", "../../x", "../../../x", "/x", "/x/../y", "?y=1", "#s", "//o.org/z",
        "https://o.org/", "mailto:a@b", "javascript:f()", "x/", ".", "..", "x/./y", "x//y", "",
        "g;x=1/../y", "x?y/../z", "data:text/plain,hi", "./", "../"]


def test_resolve_equals_the_standard_library(apply):
    pairs = [(b, r) for b in BASES for r in REFS]
    assert apply(U.resolve_url, pairs) == [urljoin(b, r) for b, r in pairs]


def test_redirects(apply):
    pairs = [
        ("https://mill.test/herons", "https://mill.test/herons", False),
        ("http://mill.test/herons", "https://mill.test/herons", False),
        ("https://www.mill.test/herons", "https://mill.test/herons", False),
        ("https://mill.test/herons", "https://mill.test/herons/", False),
        ("http://www.mill.test/herons", "https://mill.test/herons/", False),
        ("https://mill.test/herons?fbclid=7", "https://mill.test/herons", False),
        ("https://mill.test/", "https://mill.test", False),
        ("https://Mill.test:443/a%20b", "https://mill.test/a b", False),
        ("https://mill.test/herons", "https://mill.test/gate", True),
        ("https://mill.test/herons", "https://weir.test/herons", True),
        ("https://news.mill.test/herons", "https://door.mill.test/gate", True),
        ("https://mill.test/@reed/count-of-six", "https://mill.test/gate", True),
    ]
    assert apply(U.was_redirected, [p[:2] for p in pairs]) == [p[2] for p in pairs]


def test_same_origin(apply):
    page = "https://e.com/p/q"
    cases = [("/a", True), ("https://e.com:443/x", True), ("http://e.com/", False), ("", True),
             ("https://o.e.com/", False), ("about:blank", False), ("//e.com/x", True),
             ("https://e.com:8443/", False)]
    assert apply(U.same_origin, [(u, page) for u, _ in cases]) == [w for _, w in cases]


def test_filenames_and_redaction(apply):
    assert apply(U.sanitize_filename, ["a  b--c", "été!", "x" * 120, "A_b_9"]) == [
        "a_b_c", "_t_", "x" * 100, "A_b_9"]
    urls = ["u?token=1&a=2", "u?API_KEY=q&access_token=zz#f", "u?auth=&b=1", "u?secret=a&key=b"]
    assert apply(U.redact_tokens, urls) == [
        "u?token=[REDACTED]&a=2", "u?API_KEY=[REDACTED]&access_token=[REDACTED]",
        "u?auth=&b=1", "u?secret=[REDACTED]&key=[REDACTED]"]


def test_normalize_links(apply):
    base = "https://e.com/a/b?x=1"
    cases = [
        ("see [t](c) end", "see [t](https://e.com/a/c) end"),
        ("[t](/r?utm_source=a&k=v)", "[t](https://e.com/r?k=v)"),
        ("[t](#top) [m](mailto:a@b)", "[t](#top) [m](mailto:a@b)"),
        ("![i](../i.png)", "![i](https://e.com/i.png)"),
        ("[a [b](c)", "[a [b](https://e.com/a/c)"),
        ("[x](http://[bad) [open", "[x](http://[bad) [open"),
        ("no links", "no links"), ("", ""),
    ]
    got = apply(lambda m: U.normalize_links(m, F.lit(base)), [c[0] for c in cases])
    assert got == [c[1] for c in cases]
