from pyspark.sql import functions as F

from pagemark.functions import blockers as B
from pagemark.functions import extract as X
from pagemark.functions import html as H
from pagemark.operators import tables

LONG = "word and more text " * 40


def test_tokens_are_lossless(spark):
    page = ('<!DOCTYPE html><p class="a">x &lt; y<br/>3 < 4</p><script>var t="</p>";</script>'
            "<!-- <p> --><style>p{}</style><b>unclosed")
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    rows = tables.tokenize_html(df).orderBy("pos").collect()
    assert "".join(r.tok for r in rows) == page
    assert [r.kind for r in rows] == ["comment", "open", "text", "void", "text", "text", "text",
                                      "close", "raw", "comment", "raw", "open", "text"]
    assert rows[1].tag == "p" and rows[1].attrs == 'class="a"'


def test_visible_text(apply):
    pages = ["<p>a  b</p><p>c</p>", "x<br>y", "a<b>b</b>c", "<script>no</script>t &amp;amp; &copy;",
             "<ul><li>1</li><li>2</li></ul>", ""]
    assert apply(H.visible_text, pages) == ["a b\nc", "x\ny", "abc", "t &amp; ©", "1\n2", ""]
    page = "<html><head><title>T</title></head><body>B</body></html>"
    assert apply(H.page_text, [page]) == ["B"]


def test_drop_regions(apply):
    pages = ["a<nav>b<nav>c</nav>d</nav>e", "<header><h1>x</h1></header>y<iframe src=z></iframe>",
             "a</nav>b", "a<aside>to the end", "<navx>kept</navx>", "<nav/>kept"]
    assert apply(H.drop_regions, pages) == ["ae", "y", "ab", "a", "<navx>kept</navx>", "kept"]


def test_density(apply):
    article = ("<html><body><article><h1>Winter count</h1><p>Herons were seen on the ice by the "
               "old mill.</p><p>Six of them stayed there until dark.</p></article>"
               "<footer>Printed in Ghent</footer></body></html>")
    links = "<div>" + "".join(f'<a href="{i}">link number {i}</a> ' for i in range(10)) + "</div>"
    plain = f"<body>{links}<p>{LONG}</p><p>short</p><a href=x><h3>card title</h3></a>{links}</body>"
    first, empty, mixed, none = apply(
        X.refetch_extraction, [article, "<html><body></body></html>", plain, None])
    assert first.success and first.text.startswith("Winter count\nHerons were")
    assert "Ghent" not in first.text and first.word_count == 19
    assert not empty.success and empty.error == "no content" and empty.text == "" and not none.success
    assert "link number" not in mixed.text and LONG.strip() in mixed.text


def test_structured_data(apply):
    def page(data):
        return f'<title>Doc</title><script type="application/ld+json">{data}</script>'

    body = f'"articleBody":"{LONG}"'
    cases = [
        page('{"@type":"Article","headline":"H",%s,"author":{"name":"A"},"description":"D"}' % body),
        page('[{"@type":"WebPage"},{"@type":"BlogPosting","name":"N",%s}]' % body),
        page('{"@type":"Article","headline":"H",%s' % body),
        page('{"@type":"Article","headline":"H",%s} trailing' % body),
        page('{"@type":"Product","headline":"H",%s}' % body),
        page('{"@type":["Article"],"headline":"H",%s}' % body),
        page('{"@type":"Article","headline":"H","articleBody":"short"}'),
        page("not json") + page('{"@type":"NewsArticle",%s}' % body),
        "<p>none</p>",
    ]
    got = apply(X.jsonld_extraction, cases)
    assert [r is not None for r in got] == [True, True, False, False, False, False, False, True, False]
    assert (got[0].title, got[0].byline, got[0].excerpt) == ("H", "A", "D")
    assert got[1].title == "N" and got[7].title is None and "<h1>undefined</h1>" in got[7].html
    marked = (f'<title>Doc</title><b itemprop="headline">HL</b><div itemprop="articleBody"><div>{LONG}'
              '</div>end</div>after<i itemprop=author>Al</i>')
    found, short = apply(X.microdata_extraction, [marked, marked.replace(LONG, "x")])
    assert found.title == "HL" and found.byline == "Al" and found.text.endswith("\nend") and short is None


def test_landmarks(apply):
    pages = [
        f"<title>D</title><main><article><h1>H</h1>{LONG}</article></main>",
        f"<title>D</title><main><article>short</article>{LONG}</main>",
        f'<div role="main"><div>x</div><article>A {LONG}</article></div>',
        f"<div role='main'><div>B</div>{LONG}</div>after",
        f"<article>short</article><article>{LONG}</article>",
        f"<title>D</title><div role=article><div>{LONG}</div>C</div>tail",
        f"<article><article>in</article>{LONG}</article>out",
        f"<p>{LONG}</p>",
    ]
    got = apply(X.landmark_extraction, pages)
    starts = [r and r.text.split()[0] for r in got]
    assert starts == ["H", "short", "A", "B", None, "word", "in", None]
    assert got[0].title == "H" and got[1].title == "D" and got[5].text.endswith("C")
    assert "out" not in got[6].text and "after" not in got[3].text


def test_best_extraction_order(spark, apply):
    ld = '<script type="application/ld+json">{"@type":"Article","articleBody":"%s"}</script>' % LONG
    page = f"<title>D</title>{ld}<article>{LONG}</article>"
    assert [e.method for e in apply(X.all_extractions, [page])[0]] == ["schema", "semantic", "readability"]
    assert apply(X.best_extraction, [page, page.replace(ld, ""), "<p>few words</p>", ""])[2] is None
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert [r.method for r in tables.pick_extraction(df).collect()] == ["schema"]


def test_iframes(apply):
    page = ('<iframe src="/a"></iframe><IFRAME src="https://o.com/x?a=1&amp;b=2"></iframe><iframe></iframe>'
            '<!-- <iframe src="no"></iframe> -->')
    got = apply(lambda h: X.iframes(h, F.lit("http://e.com/p")), [page, "<p>"])
    assert [(i.src, i.sameOrigin) for i in got[0]] == [
        ("http://e.com/a", True), ("https://o.com/x?a=1&b=2", False), ("", True)]
    assert got[1] == []


def test_blockers(apply):
    good = "six herons stand there " * 100
    rows = [
        (401, '<form><input type="password"></form>', "log in to see the count", None),
        (200, '<p class="paywall">full count</p>', "a subscription opens the whole count", None),
        (200, '<p id="hcaptcha"></p>', "one captcha first", None),
        (200, "<body>heron</body>", "ice", None),
        (200, '<body><iframe src="https://mill.test/f"></iframe></body>', "wait", None),
        (200, "<article>" + "<p>heron after heron</p>" * 50 + "</article>", good, None),
        (200, '<form action="/user/login">password</form>', good, None),
        (200, "<p>password</p>", good, None),
        (0, "", "", "Request timeout"), (0, "", "", "HTTP error: x"), (200, None, None, None),
    ]
    got = apply(B.blocker_flags, rows, ["int", "string", "string", "string"])
    assert got[0].login_required and not got[0].content_too_thin
    assert got[1].paywall and got[2].captcha and got[3].content_too_thin
    assert got[4].cross_origin_iframe
    assert not any(got[5][:6]) and got[6].login_required and not got[7].login_required
    assert [g.error for g in got[8:]] == [
        "Page load timeout", "Probe error: HTTP error: x", "No response received"]
    assert not any(got[8][:6])


def test_attributes_and_references(apply):
    tags = ['<a title="see href=q" href="real">', "<a data-href='no' href=yes>", '<a title="x"href="y">',
            "<a href = 'a b' >", "<a = href=x/y>", '<a "odd" href=z>', "<a>", "<abbr/href=1>",
            '<a href="&aacute;&rarr;&frac12;&AMP;&notthere;">']
    assert apply(lambda t: H.attr(t, "href"), tags) == [
        "real", "yes", "y", "a b", "x/y", "z", None, "1", "á→½&&notthere;"]
    texts = ["&ecirc;&nbsp;&amp;lt;", "a&#5;b&#x6;c&#127;", "&#9;&#10;&#8364;", None]
    assert apply(H.decode_entities, texts) == ["ê\u00a0&lt;", "a\ufffdb\ufffdc\ufffd", "\t\n€", None]
