"""Articles of many kinds of elements, wrappers with odd names, and awkward rows, of the main text."""

import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from resistrum.llm import html

PRIORS = html.weights_of({})
P = "<p>" + ("some words of a paragraph here " * 4).strip() + "</p>"
PAGES = {
    "list": "<h1>Head line</h1>" + P + "<ul>" + "".join(f"<li>item number {k} is here</li>" for k in range(30)) + "</ul>" + P,
    "words in a list": "<h1>Head line</h1>" + P + "<ol>" + "".join(f"<li>item{k}" for k in range(30)) + "</ol>" + P,
    "table": "<h1>Head line</h1>" + P + "<table>" + "".join(f"<tr><td>cell {k}</td><td>{k * k}</td></tr>" for k in range(30)) + "</table>" + P,
    "inline": "<h1>Head line</h1><p>" + " ".join(f"<em>w{k}</em> <code>c{k}</code>" for k in range(40)) + "</p>",
    "div and span": "<div><span>Title of it</span></div>" + "".join(f"<div><span>Sentence number {k} of ten.</span></div>" for k in range(10)),
    "pre": "<h1>Head line</h1><pre>x = 1</pre>", "quotes": P + "<blockquote>" + P + "</blockquote><dl><dt>one term</dt><dd>what it is</dd></dl><my-part>" + P + "</my-part>",
}


@pytest.fixture(scope="module")
def from_pages(spark, sf):
    return html.learned(spark.read.parquet(f"{sf}/pages.parquet"))


def blocks(markup):
    parts = re.split(r"</?(?:h1|p|ul|ol|li|table|tr|td|div|pre|blockquote|dl|dt|dd)>", re.sub(r"</?(?:em|code|span|my-part)>", "", markup))
    return "\n".join(b for b in (" ".join(x.split()) for x in parts) if b)


@pytest.mark.parametrize("name", sorted(PAGES))
@pytest.mark.parametrize("around", ["{}", "<article>{}</article>", "<div class=post><nav><ul><li><a href=x>Home</a></ul></nav>{}<footer>owners of it</footer></div>"])
def test_whole_articles(from_pages, name, around):
    for weights in (PRIORS, from_pages):
        assert html.main_text(f"<body>{around.format(PAGES[name])}</body>", weights) == blocks(PAGES[name])


@pytest.mark.parametrize("begin", ["<div class='wp-menu'>", "<div class=page-with-comments>", "<div class=layout-nav>", "<div class='page-navigation'>", "<div class='post related'>", "<div id=single-comments>", "<nav>", "<aside>", "<div class=menu><div class=related>"])
def test_what_holds_the_article_is_content(from_pages, begin):
    page = f"<body><nav><a href=x>our menu</a></nav>{begin}<article><h1>Head line</h1>{P}<div class=ad>buy it</div>{P}</article><ul class=menu><li>more menu</ul></div></div><div class=comments>{P * 9}</div></body>"
    for weights in (PRIORS, from_pages):
        assert html.main_text(page, weights) == blocks(f"<h1>Head line</h1>{P}{P}")


def test_what_holds_other_articles_is_not(from_pages):
    for weights in (PRIORS, from_pages):
        assert html.main_text(f"<div>{P * 3}</div><aside class=related><article><p>a teaser</p></article></aside>", weights) == blocks(P * 3)
        assert html.main_text(f"<main><p>short text of it all</p><div class=comments>{P * 9}</div></main>", weights) == "short text of it all"
        assert html.main_text(f"<main><article>{P}</article><section class=comments><article class=comment>{P * 9}</article></section></main>", weights) == blocks(P)
        assert html.main_text(f"<main><div id=comment>{P}</div></main>", weights) == blocks(P)
        assert html.main_text(f"<div class=comments>{P}</div>", weights) == ""


def test_lists_of_links_are_no_text(from_pages):
    links = "<ul>" + "".join(f"<li><a href=x>Section {k}</a></li>" for k in range(20)) + "</ul>"
    for weights in (PRIORS, from_pages):
        assert html.main_text(f"<body><div>{links}</div>{P}<p>see <a href=y>this page</a> too</p><div>{links}</div></body>", weights) == blocks(P + "<p>see this page too</p>")


def test_weights_are_those_of_the_class():
    counts = {("tag", "p"): (900, 10), ("tag", "div"): (0, 500), ("tag", "a"): (1, 99), ("tag", "li"): (5, 80)}
    w = html.weights_of(counts)
    assert w["tag", "p"] == w["tag", "div"] == w["tag", "table"] == w["tag", "h2"] and w["tag", "li"] == w["tag", "td"] == -1.0 and w["tag", "a"] == -2.0 and w["end", "p"] == 0.0


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", P), (3, "u", P), (None, None, f"<nav>menu</nav>{P}"), (5, "u", P * 3000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(-1)})
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html.extracted(d, html.learned(d)).collect())
    text = blocks(P)
    want = [(1, None, "", 0), (2, "u", "", 0), (3, "u", text, len(text)), (3, "u", text, len(text)), (0, None, text, len(text)), (5, "u", "\n".join([text] * 3000), 3000 * (len(text) + 1) - 1)]
    assert got == sorted(want)
    assert html.extracted(d.limit(0), html.learned(d.limit(0))).count() == 0


def test_time_grows_with_the_page():
    def seconds(page):
        began = time.process_time()
        html.main_text(page, PRIORS)
        return time.process_time() - began

    for piece in ("<div>x ", "<div class=ad>x ", "<ul><li>x ", "<form><p>x ", "<nav><article>x ", "</b>"):
        small = min(seconds(piece * 10_000) for _ in range(3))
        assert seconds(piece * 80_000) < 8 * small * 4


def test_ends_of_elements_score_nothing():
    kinds = Counter(x[0] for x in html.items("<div><p>a<br>b</p></div>"))
    assert kinds == {"tag": 3, "end": 2, "text": 2}
