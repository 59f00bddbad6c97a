"""Tree, selectors, extraction, markdown and readability, without Spark but for the UDF."""

import json

import pytest

from pagequarry.html import extract, render, select
from pagequarry.html.dom import parse
from pagequarry.html.spec import parse_field_spec, parse_schema
from pagequarry.functions.text import Transform

PRODUCT = '<html><body><h1 class="title"> Widget </h1><span class="price">$9</span><a href="/a">A</a><a href="/b">B</a><img src="1.png"><img src="2.png"><meta name="sku" content="W1"></body></html>'


def test_flat_fields():
    fields = [parse_field_spec(s) for s in ("title=h1.title", "price=.price", "links=a[]@href", "images=img[]@src", "sku=meta[name='sku']@content", "none=.nope")]
    assert extract.css(parse(PRODUCT), fields) == {"title": "Widget", "price": "$9", "links": ["/a", "/b"], "images": ["1.png", "2.png"], "sku": "W1"}


@pytest.mark.parametrize("spec", ["", "a", "=x", "a=", "a=[]", "a=@href"])
def test_bad_field_specs(spec):
    with pytest.raises(ValueError):
        parse_field_spec(spec)


TREE = parse('<div id="top" class="a b"><p>one<p>two <b>bold<p>three</b></div><ul><li>x<li class="y" data-k="Foo-Bar">y<li>z</ul><p lang="en-US">four</p>')


@pytest.mark.parametrize("selector,texts", [
    ("#top p", ["one", "two bold", "three"]), ("div.a.b > p", ["one", "two bold", "three"]), ("p b", ["bold", "three"]), ("li", ["x", "y", "z"]), ("li.y + li", ["z"]), ("li ~ li", ["y", "z"]), ("li:first-child", ["x"]), ("li:last-child", ["z"]),
    ("li:nth-child(2)", ["y"]), ("li:nth-child(odd)", ["x", "z"]), ("li:not(.y)", ["x", "z"]), ("[data-k]", ["y"]), ('[data-k="foo-bar" i]', ["y"]), ("[data-k^=Foo]", ["y"]), ("[data-k$=Bar]", ["y"]), ("[data-k*='o-B']", ["y"]), ("[class~=b] b", ["bold", "three"]),
    ("p:contains('wo')", ["two bold"]), ("li, b", ["bold", "three", "x", "y", "z"]), ("p[lang|=en]", ["four"]),
])
def test_selectors(selector, texts):
    assert [n.text().strip() for n in select.find_all(TREE, selector)] == texts


@pytest.mark.parametrize("selector", ["", "a >", "a::before", "a:hover", "a[", "a:nth-child(x)", "a | b"])
def test_bad_selectors(selector):
    with pytest.raises(ValueError):
        select.find_all(TREE, selector)


def test_raw_text_entities_and_tables():
    doc = parse('<script>var t="</p>";</script><p>a &amp; b &copy;</p><table><tr><td>1<td>2<tr><td>3</table>')
    assert select.find(doc, "p").text() == "a & b ©"
    assert [len(r.elements()) for r in select.find_all(doc, "tr")] == [2, 1]
    assert select.find(parse(""), "body") is not None and parse(None).text() == ""


def schema(fields, version=2):
    return parse_schema({"version": version, "fields": fields})


BOOK = '<h1>Logic</h1><p id="pub"> First <i>1999</i></p><ul id="toc"><li><a href="#1">One</a><li><a href="#2">Two</a></ul>'


def test_nested_schema():
    s = schema({
        "title": {"selector": [".x", "h1"], "transforms": [{"type": "lowercase"}]}, "year": {"selector": "#pub", "transforms": [{"type": "regex", "pattern": "[0-9]{4}"}]}, "gone": {"selector": "#no"},
        "toc": {"selector": "#toc li", "multiple": True, "fields": {"label": {"selector": "a"}, "href": {"selector": "a", "attr": "href"}, "all": {"selector": ""}, "skipped": {"attr": "x"}}},
    })
    assert extract.schema(parse(BOOK), s) == {"title": "logic", "year": "1999", "toc": [{"label": "One", "href": "#1", "all": "One"}, {"label": "Two", "href": "#2", "all": "Two"}]}


@pytest.mark.parametrize("version,fields", [
    (3, {"a": {"selector": "x"}}), (2, {}), (2, {"a": {"selector": ""}}), (2, {"a": {}}), (1, {"a": {"selector": ["x", "y"]}}), (1, {"a": {"selector": "x", "transforms": [{"type": "trim"}]}}), (2, {"a": {"selector": "x", "transforms": [{"type": "nope"}]}}),
    (2, {"a": {"selector": "x", "transforms": [{"type": "regex"}]}}), (2, {"a": {"selector": "x", "transforms": [{"type": "split"}]}}), (2, {"a": {"selector": "x", "fields": {"b": {"selector": "y"}}, "transforms": [{"type": "trim"}]}}), (2, {"a": {"selector": "x", "surprise": 1}}),
])
def test_bad_schemas(version, fields):
    with pytest.raises(ValueError):
        schema(fields, version)


LINKS = '<a href="/a#x">1</a><a href="/a">2</a><a href="#top">3</a><a href="javascript:0">4</a><a href="mailto:x@y">5</a><a href="tel:1">6</a><a href="https://other.org/z">7</a><a href="https://sub.e.com/s">8</a><a href="ftp://e.com/f">9</a><a>10</a><a class="n" href="é x">11</a>'


def test_links():
    doc = parse(LINKS)
    assert extract.all_links(doc, "https://e.com/d/") == ["https://e.com/a", "https://other.org/z", "https://sub.e.com/s", "https://e.com/d/%C3%A9%20x"]
    assert extract.all_links(doc, "https://e.com/d/", True) == ["https://e.com/a", "https://sub.e.com/s", "https://e.com/d/%C3%A9%20x"]
    assert extract.first_link(doc, "https://e.com/", "a") == "https://e.com/a#x"
    assert extract.first_link(doc, "https://e.com/", "a[href*=other]", True) is None


META = """<html lang="en"><head><title> T </title><meta property="og:title" content="OG"><meta NAME="Description" content="D"><meta property="twitter:card" content="s"><meta name="twitter:description" content="TD"><link rel="canonical" href="/c">
<meta property="article:published_time" content="2024-01-02T03:04:05Z"><script type="application/ld+json">{"b":1,"a":[2]}</script><script type="application/ld+json">{oops</script></head></html>"""


def test_metadata():
    m = extract.metadata(parse(META), "https://e.com/x")
    assert (m["title"], m["description"], m["canonical"], m["language"]) == ("OG", "TD", "https://e.com/c", "en")
    assert m["twitter"] == {"description": "TD"} and m["open_graph"] == {"title": "OG"}  # twitter: is read from name alone
    assert m["published"] == ["2024-01-02T03:04:05Z"] and m["json_ld"] == ['{"a":[2],"b":1}']
    bare = extract.metadata(parse("<title>x</title>"), "https://e.com/")
    assert (bare["title"], bare["canonical"], bare["json_ld"]) == ("x", "", [])


def test_of_several_tags_the_first_counts():
    page = """<meta property="og:title" content="First"><meta property="og:title" content="Second"><meta name="description" content=" "><meta name="description" content="late"><title>T</title>
    <meta property="twitter:description" content="no"><link rel="Canonical" href="/no"><link rel="canonical" href="/yes"><script type="Application/LD+JSON">{"a":1}</script>"""
    m = extract.metadata(parse(page), "https://e.com/")
    assert (m["title"], m["description"], m["canonical"], m["open_graph"]["title"], m["json_ld"]) == ("First", "", "https://e.com/yes", "Second", [])
    assert extract.metadata(parse('<title>T</title><meta property="og:title" content=" ">'), "")["title"] == "T"


@pytest.mark.parametrize("tag", ["div", "span", "b", "a", "blockquote", "p", "ul><li", "table><tr><td"])
def test_deep_pages_do_no_harm(tag):
    n = 100_000 if tag in ("div", "p") else 3000
    tags = tag.split("><")
    page = "<title>t</title>" + ("<" + "><".join(tags) + ">") * n + "some words in the midst of it, and some more" + "".join(f"</{t}>" for t in reversed(tags)) * n
    doc = parse(page)
    assert "some words" in doc.text() and "some words" in render.to_html(doc) and "some words" in render.to_markdown(doc, "https://e.com/")
    assert extract.all_links(doc, "https://e.com/") == [] and extract.metadata(doc, "")["title"] == "t" and not extract.is_shell(doc)
    assert "some words" in render.readable(doc, page)


def test_shells_and_required():
    assert extract.is_shell(parse('<div id="app"> <!-- c --> </div>')) and extract.is_shell(parse("<app-root></app-root>"))
    assert not extract.is_shell(parse('<div id="app"><p></p></div>')) and not extract.is_shell(parse('<div id="app">x</div>'))
    assert extract.missed_selector(parse("<h1 class=title>x</h1>"), ["h1.title", ".price"]) == ".price"


def test_markdown():
    md = render.to_markdown(parse('<h2>Head</h2><p>Some <b>bold</b> and <em>em</em> <a href="/l">link</a>.</p><ul><li>a<li>b<ol><li>c</ol></ul><pre><code>x = 1</code></pre><blockquote>q</blockquote><table><tr><th>k<th>v<tr><td>1<td>2</table><img src="i.png" alt="I">'), "https://e.com/")
    for part in ("## Head", "**bold**", "*em*", "[link](https://e.com/l)", "- a", "  1. c", "```\nx = 1\n```", "> q", "| k | v |", "![I](https://e.com/i.png)"):
        assert part in md


def test_readable():
    body = "<p>" + "A long sentence of the article, with commas, and more words than any menu has. " * 5 + "</p>"
    page = f'<nav><a href="/">Home</a></nav><div class="content"><h1>T</h1>{body}{body}</div><footer>Privacy policy</footer>'
    out = render.readable(parse(page), page)
    assert "long sentence" in out and "Privacy policy" not in out and "Home" not in out
    assert render.readable(parse("<p>x</p>"), "<p>x</p>") == "<p>x</p>"


def test_expressions_in_sql(spark):
    """The SQL functions say what the Column functions say."""
    from pyspark.sql import functions as F

    from pagequarry.functions import quality, urls
    from pagequarry.sql import register

    assert {"canonicalize_url", "url_host", "classify_failure", "check_validity", "detect_soft_block"} <= set(register(spark))
    wall = "<title>Just a moment...</title>" + "x" * 600
    rows = [
        (" HTTPS://u@E.com:443/a?b=2&a=1&utm_source=q&c#f", 200, "text/html", "x" * 600, None), ("http://[::1]:80", 429, "", "", "dial tcp: no such host"), ("nonsense", 600, None, None, "x509: bad"),
        ("ftp://E.org:21/é?", 200, "Image/SVG+xml", "<svg/>", None), ("https://e.org", 200, "application/x-pdf", "%PDF", None), ("https://e.org/?&&", 200, "text/html", wall, "status 503"), (None, 0, None, None, None),
    ]
    df = spark.createDataFrame(rows, "url string, status int, ct string, body string, err string")
    a = df.selectExpr("canonicalize_url(url) AS c", "url_host(url) AS h", "classify_failure(err, '', status) AS f", "check_validity(status, ct, body) AS v", "detect_soft_block(body) AS b")
    b = df.select(urls.canonicalize_url("url"), urls.url_host("url"), quality.classify_failure("err", F.lit(""), "status"), quality.validity("status", "ct", "body"), quality.soft_block("body"))
    assert list(map(tuple, a.collect())) == list(map(tuple, b.collect()))


def test_functions_in_sql(spark):
    from pagequarry.sql import register

    assert "extract_links" in register(spark)
    r = spark.sql("SELECT extract_links('<a href=\"/x\">y</a>', 'https://e.com/') AS l, extract_css('<h1>T</h1>', 'h=h1') AS c, to_markdown('<h1>T</h1>', '') AS m, is_spa_shell('<div id=\"root\"></div>') AS s, readable(NULL) AS r").first()
    assert (r.l, json.loads(r.c), r.m, r.s, r.r) == (["https://e.com/x"], {"h": "T"}, "# T", True, "")
    assert extract.transform("a b", [Transform("split", separator=" ")]) == ["a", "b"]
