import re

from pyspark.sql import functions as F

from pagemark.functions import languages as L
from pagemark.functions import markdown as M

PAGES = [
    ("<h2>Tide tables</h2><div><p>Low water comes at dawn.</p></div>", "## Tide tables\n\nLow water comes at dawn."),
    ('<main><style media=print>p > b{margin:2px}</style><p>Eels sleep under the weir.<script type="module">'
     'let k = "</p>";</script></p></main>', "Eels sleep under the weir."),
    ('<ol><li>Ask <a href="http://weir.test/log_9">log_9</a> first</li></ol>',
     "1. Ask [log\\_9](http://weir.test/log_9) first"),
    ("<section><h2>Mill</h2><h4>Wheel</h4><blockquote>Stones <i>grind</i> grain</blockquote><ol><li>oak</li> <li>ash"
     "</li></ol><p>Then<br><strong>flour</strong></p></section>",
     "## Mill\n\n#### Wheel\n\n> Stones *grind* grain\n\n1. oak\n2. ash\n\nThen  \n**flour**"),
    ("<ol start=3><li>x<li>y<ul><li>deep</li></ul></ol>after", "3. x\n4. y\n    - deep\n\nafter"),
    ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2|3</td></tr></table>",
     "| A | B |\n| --- | --- |\n| 1 | 2\\|3 |"),
    ("<p><b>open<p>next</p><footer>gone</footer>", "**open**\n\nnext"),
    ('<img src="a_b.png" alt="al">', "![al](a_b.png)"),
    ('<a href="q"><h3>big</h3><p>card</p></a>', "[big card](q)"),
    ('<a href="https://e.com">https://e.com</a> <a href="x" title="T">y</a>', '<https://e.com> [y](x "T")'),
    ("5 &lt; 6 &amp;lt; &#8364; &unknown; <code>a_b</code>", "5 < 6 &lt; € &unknown; `a_b`"),
    ('<div title="a > b">t</div>', "t"),
    ('<pre><code class="lang-python">\ndef f():\n    print("x")\n    </code></pre><p>t</p>'
     '<pre class="s-lang-js"><code>a &lt; b</code></pre><pre>n</pre>',
     '```python\ndef f():\n    print("x")\n```\n\nt\n\n```javascript\na < b\n```\n\n```\nn\n```'),
    ("", None), (None, None),
]


def test_html_to_markdown(apply):
    assert apply(M.html_to_markdown, [p[0] for p in PAGES]) == [p[1] for p in PAGES]


def test_deep_and_long_pages(apply):
    many = "".join(f"<li>item {i}</li>" for i in range(3000))
    nested = "<nav><nav>x</nav>y</nav>kept<aside>" + "<div>" * 500 + "gone"
    listed, kept = apply(M.html_to_markdown, [f"<ul>{many}</ul>", nested])
    assert listed.count("\n- ") == 2999 and kept == "kept"


def test_header_and_fallback(spark):
    df = spark.createDataFrame(
        [(0, "<p>six herons</p>", "2021-05-04T03:02:01Z"), (1, None, "2021-05-04T03:02:01Z"),
         (2, "", "2021-05-04T03:02:01Z")], "i int, html string, at string")
    out = df.select("i", M.convert(F.col("html"), F.lit("Weir log no. 9"), F.lit("http://weir.test/9"),
                                   F.to_timestamp("at")).alias("m")).orderBy("i").collect()
    assert out[0].m == ("# Weir log no. 9\n\n**Source**: http://weir.test/9  \n"
                        "**Captured**: 2021-05-04 03:02:01 UTC\n\n---\n\nsix herons")
    assert "Failed to convert to Markdown" in out[1].m and out[1].m.endswith("```\n\n```\n")
    assert out[2].m.endswith("```\n...\n```\n")


def test_fragments(apply):
    cases = [
        ("rain\n`1import weir as w\n2\n3# sluice\n4gate = w.open(\"low\")`\nsun",
         "rain\n\n```python\nimport weir as w\n\n# sluice\ngate = w.open(\"low\")\n```\n\nsun"),
        ("`1const eels = [];`", "\n```javascript\nconst eels = [];\n```\n"),
        ("`404`", "\n```\n\n```\n"),
        ("the `sluice` opens\n```sh\nls\n```", "the `sluice` opens\n```sh\nls\n```"),
        ("`1a\nb`", "`1a\nb`"), ("``1a``", "`\n```\na\n```\n`"),
    ]
    assert apply(M.fix_fragmented_code, [c[0] for c in cases]) == [c[1] for c in cases]
    long = "`" + "\n".join(f"{i}x" for i in range(30000)) + "`"
    assert apply(M.fix_fragmented_code, [long])[0].count("\nx") == 30000


def clean(text):
    out, blank = [], False
    for line in text.split("\n"):
        now = not line.strip()
        if not (now and blank):
            out.append(line)
        blank = now
    return "\n".join(out)


def test_clean_markdown_equals_python(apply):
    texts = ["a\n\n\nb", "a\n \n\t\n   b\n\n\n", "\n\n\nx", "a\n\nb", "", "\n", "x\n \n\ny",
             "\n# T\n\n\nP\n\n\n\nQ\n\n\n", " \n \nx  \n", "a\r\n\r\n\r\nb"]
    assert apply(M.clean_markdown, texts) == [clean(t) for t in texts]


def test_class_languages(apply):
    cases = {"s-lang-js": "javascript", "lang-python": "python", "language-javascript": "javascript",
             "hljs-typescript": "typescript", "prism-bash": "bash", "lang-go": "go",
             "lang-c++": "c", "code-block": "block", "x lang-RS y": "rust", "": "", "plain": ""}
    assert apply(L.lang_from_class, list(cases)) == list(cases.values())
    aliases = {"js": "javascript", "py": "python", "ts": "typescript", "sh": "bash", "yml": "yaml",
               "c++": "cpp", "c#": "csharp", "golang": "go", "rs": "rust", "rb": "ruby", "zig": "zig"}
    assert apply(L.normalize_language, list(aliases)) == list(aliases.values())
    assert len(L.LANGUAGE_ALIASES) == 67


SNIPPETS = [
    ("\n    import os\n    def hello():\n        print(1)\n", "python"),
    ("const x = 10;\nfunction test() {}", "javascript"), ("$ npm install\n$ git commit", "bash"),
    ("<!doctype html>\n<html></html>", "html"), ("package main\nfunc main() {}", "go"),
    ("fn main() {\n let mut x = 5;\n println!(x);\n}", "rust"), ("<?xml version='1'?>", "xml"),
    ("x: string", "typescript"), ('{"a": [1]}', "json"), ('{"a": [1]} tail', ""),
    ("p { color: red }", "css"), ("select 1", "sql"), ("a\n  - item", "yaml"),
    ("let mut y", "javascript"), ("System.out.println(1)", "java"), ("#include <stdio.h>", "c"),
    ("std::cout", "cpp"), ("namespace X", "csharp"), ("puts 1", "ruby"), ("<?php", "php"),
    ("func f -> Int", "swift"), ("fun f", "kotlin"), ("# T\n[a](b)", "markdown"),
    ("RUN make", "dockerfile"), ("public class A", "python"), ("FROM ubuntu", "sql"),
    ("key:", "python"), ("nothing here", ""),
]


def test_code_detection(apply):
    assert apply(L.detect_code_language, [s[0] for s in SNIPPETS]) == [s[1] for s in SNIPPETS]


#: Two texts for each pattern of the rules that hold it, one with as little else as can be.
MATCHING = [
    "<HEAD", "<!doctype HTML>", "<SCRIPT", "<?xml", "<AppDomain>", "fn a(", "fn  a_1 (", "let mut ", "let  mut\tx",
    "use std::", "use\n std::io", "println!", "const a", "let  b", "var\nc", "function f(", "function  f (", "=>",
    "console.log", "console.warn", "async function", "await ", "x.then(", "Office.onReady", "asyncResult",
    "getElementById", "querySelector", ":any", ": string", "interface I", "import a", "from  b", "def f(", "def f  (",
    "class C", "print(", "print  (", "if __name__ ==", "a:", "a:  \nb", "$ ls", "x\n$ y", "#!/bin/sh", "#! /bin/bash",
    "sudo x", "ls\n", "export A=", "{\"a\":1}", "[1]", "a:{", "a: 'b", "p{}", "p  {color:red}", "margin:", "select",
    "JOIN", "key:", "\n - a", " -  b", "package p", "func f(", "public class", "private interface", "protected class",
    "System.out.println", "#include <a>", "#include<iostream> std::", "std::", "int main(", "int  main (",
    "namespace n", "using System", "end", "def", "require", "puts", "attr_accessor", "<?php", "$a =", "$a=",
    "func a ->", "var a ->", "let a->", "fun a", "val a", "# a [b](c)", "## a\n[](", "###### [b]()", "from", "run x", "\nCOPY a",
    "nothing at all", "", None,
]


def test_needed_strings_lose_no_match(spark):
    df = spark.createDataFrame([(t,) for t in MATCHING], "t string")
    patterns = list(dict.fromkeys(p for _, *groups in L.DETECTION_RULES for g in groups for p in g))
    assert set(L.NEEDED) <= set(patterns) and len(set(patterns) - set(L.NEEDED)) <= 4
    found = df.select("t", *(F.col("t").rlike(L._java_flags(p)).alias(f"p{i}") for i, p in enumerate(patterns))).collect()
    for i, pattern in enumerate(patterns):
        hits = [r.t for r in found if r[f"p{i}"]]
        assert hits, pattern
        assert all(any(n in t for n in L.NEEDED.get(pattern, ("",))) for t in hits), pattern


def test_detection_is_that_of_the_rules_alone(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for t in [*MATCHING, *(s[0] for s in SNIPPETS)]], "t string")
    guarded = df.select(L.detect_code_language(F.trim("t"))).collect()
    monkeypatch.setattr(L, "NEEDED", {})
    assert guarded == df.select(L.detect_code_language(F.trim("t"))).collect()


def test_detect_unlabelled_option(apply):
    page = "<pre><code>import os</code></pre>"
    assert apply(lambda h: M.html_to_markdown(h, detect_unlabelled=True), [page]) == [
        "```python\nimport os\n```"]
    assert re.match("```\n", apply(M.html_to_markdown, [page])[0])


def test_no_markers_from_references(apply):
    from pagemark.functions.markdown import html_to_markdown

    got = apply(html_to_markdown, ["<p>a&#5;b&#6;c &#14;http://x&#15;y&#16;</p>"])
    assert "**" not in got[0] and "](" not in got[0]
