"""Scalar functions on tables of cases."""

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import pdftext, quality, text, urls


def apply(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[1] for r in sorted(df.select("i", column.alias("o")).collect())]


CANONICAL = [
    ("HTTPS://Example.COM/Path", "https://example.com/Path"), ("https://example.com", "https://example.com/"), ("https://example.com/a#frag", "https://example.com/a"), ("http://example.com:80/a", "http://example.com/a"),
    ("https://example.com:443/a", "https://example.com/a"), ("http://example.com:8080/a", "http://example.com:8080/a"), ("https://e.com/?utm_source=x&b=2&a=1", "https://e.com/?a=1&b=2"), ("https://e.com/?fbclid=1&q=x", "https://e.com/?q=x"),
    ("https://e.com/?z=1&a=2", "https://e.com/?a=2&z=1"), ("https://e.com/?a=2&a=1", "https://e.com/?a=1&a=2"), ("https://e.com/?utm_source=x&UTM_Medium=y", "https://e.com/"), ("https://e.com/?V=Abc", "https://e.com/?V=Abc"),
    ("  https://e.com/a/  ", "https://e.com/a/"), ("https://e.com/?a-b=1&a=1", "https://e.com/?a=1&a-b=1"), ("https://e.com/?a=&a", "https://e.com/?a&a="), ("https://e.com/?&&x=1&", "https://e.com/?x=1"), ("https://u:p@E.com/", "https://u:p@e.com/"),
    ("", None), ("   ", None), ("not-a-url", None), ("/just/a/path", None), ("example.com/no/scheme", None), (None, None),
]


def test_canonicalize(spark):
    assert apply(spark, [c[0] for c in CANONICAL], "u string", urls.canonicalize_url("u")) == [c[1] for c in CANONICAL]
    once = [c[1] for c in CANONICAL]
    assert apply(spark, once, "u string", urls.canonicalize_url("u")) == once
    assert apply(spark, ["https://e.com/#top"], "u string", urls.canonicalize_url("u", keep_fragment=True)) == ["https://e.com/#top"]
    assert apply(spark, ["https://e.com/?custom=1&ref=2"], "u string", urls.canonicalize_url("u", ["custom"])) == ["https://e.com/?ref=2"]


def test_hosts(spark):
    assert apply(spark, ["https://A.Example.com:8080/x", "http://[::1]:80/", "http://[::1]/", "nope", None], "u string", urls.url_host("u")) == ["a.example.com", "[::1]", "[::1]", None, None]


RESOLVE = [("/x", "https://e.com/x"), ("x", "https://e.com/a/x"), ("../x", "https://e.com/x"), ("./x", "https://e.com/a/x"), ("//o.org/y", "https://o.org/y"), ("?q=1", "https://e.com/a/b?q=1"), ("https://z.net/1", "https://z.net/1"), ("x/../../y/.", "https://e.com/y/"), ("#f", "https://e.com/a/b#f"), ("mailto:a@b", "mailto:a@b"), ("/../../q", "https://e.com/q")]


def test_resolve(spark):
    assert apply(spark, [r[0] for r in RESOLVE], "r string", urls.resolve_url(F.lit("https://e.com/a/b"), "r")) == [r[1] for r in RESOLVE]


def test_same_domain_and_patterns(spark):
    pairs = [("e.com", "e.com", True), ("a.e.com", "e.com", True), ("e.com", "a.e.com", True), ("ae.com", "e.com", False), ("a.x.com", "b.x.com", False)]
    assert apply(spark, [p[:2] for p in pairs], "a string, b string", urls.same_domain(F.col("a"), F.col("b"))) == [p[2] for p in pairs]
    pats = [("a.gov", "*.gov", True), ("gov", "*.gov", False), (".gov", "*.gov", False), ("X.gov", "x.GOV", True), ("a.b.gov", "*.b.gov", True), ("b.gov", "*.b.gov", False)]
    assert apply(spark, [p[:2] for p in pats], "h string, p string", urls.match_host_pattern(F.col("h"), F.col("p"))) == [p[2] for p in pats]


def test_skip_links_and_fnv(spark):
    assert apply(spark, ["", "#a", "JavaScript:x", "mailto:a", "tel:1", "/ok"], "h string", urls.skip_link(F.col("h"))) == [True] * 5 + [False]

    def fnv(b):
        h = 2166136261
        for x in b:
            h = ((h ^ x) * 16777619) % 2**32
        return h

    cases = ["", "a", "example.com", "é"]
    assert apply(spark, cases, "h string", urls.fnv1a_32("h")) == [fnv(c.encode()) for c in cases]


PAD = "<!--" + "x" * 600 + "-->"
VALIDITY = [
    (200, "text/html", f"<p>hello</p>{PAD}", True, "", False), (404, "text/html", PAD, False, "http 404", False), (500, "text/html", PAD, False, "http 500", True), (429, "text/html", PAD, False, "http 429", True),
    (0, "text/html", PAD, False, "no response", True), (301, "text/html", PAD, False, "http 301", True), (200, "text/html", "<p>tiny</p>", False, "body below threshold", True),
    (200, "text/html", f'<div id="root"></div>{PAD}', False, "spa shell detected", True), (200, "text/html", f'<div id="__next"> </div>{PAD}', False, "spa shell detected", True), (200, "text/html", f'<div id="root"><p>x</p></div>{PAD}', True, "", False),
    (200, "application/json", "{}", True, "", False), (200, "image/png", "x", False, "unsupported content-type: image/png", False), (200, "", f"<p>hello</p>{PAD}", True, "", False), (200, "application/xhtml+xml", "<p>", False, "body below threshold", True),
    (200, "text/html", f"<title>Just a moment...</title>{PAD}", False, "soft block: cloudflare/just a moment", True), (200, "text/html", f"access denied cf-chl {PAD}", False, "soft block: cloudflare/cf-chl", True),
    (200, "text/html", "access denied" + "x" * 51188, True, "", False), (200, "text/html", "access denied" + "x" * 51187, False, "soft block: generic/access denied", True),
]


def test_validity(spark):
    got = apply(spark, [v[:3] for v in VALIDITY], "s int, c string, b string", quality.validity("s", "c", "b"))
    assert [(g.valid, g.reason, g.escalate) for g in got] == [v[3:] for v in VALIDITY]


FAILURES = [
    ("", "", 200, "success"), ("blocked by robots.txt", "", 0, "robots_blocked"), ("", "spa shell detected", 200, "spa_shell"), ("", "soft block: cloudflare/cf-chl", 200, "soft_block"), ("follow: none", "", 0, "follow_failed"),
    ("x509: certificate is valid for *.wpengine.com", "", 0, "parked_domain"), ("dial tcp: lookup x: no such host", "", 0, "dns_failure"), ("net::ERR_NAME_NOT_RESOLVED", "", 0, "dns_failure"), ("connect: connection refused", "", 0, "connection_refused"),
    ("tls: handshake failure", "", 0, "tls_error"), ("context deadline exceeded", "", 0, "timeout"), ("cloudflare says no", "", 0, "cloudflare_block"), ("", "http 530", 530, "http_5xx"), ("http: http 404", "", 0, "http_4xx"),
    ("status: 503", "", 0, "http_5xx"), ("all tiers exhausted: []", "", 0, "all_tiers_exhausted"), ("extract: bad", "", 200, "extraction_failed"), ("something weird", "", 0, "other"), ("", "x", 1020, "cloudflare_block"),
]


def test_failures(spark):
    assert apply(spark, [f[:3] for f in FAILURES], "e string, r string, s int", quality.classify_failure("e", "r", "s")) == [f[3] for f in FAILURES]
    reach = apply(spark, list(quality.CATEGORIES), "c string", quality.is_reachable("c"))
    assert {c for c, r in zip(quality.CATEGORIES, reach) if r} == set(quality.REACHABLE)


def test_retry_rules(spark):
    assert apply(spark, [429, 500, 502, 503, 504, 404], "s int", quality.is_retryable_status("s")) == [True, False, True, True, True, False]
    errors = [("read tcp: connection reset by peer", True), ("x509: certificate has expired", False), ("context canceled", False), ("unexpected EOF", True), ("unsupported protocol scheme", False), (None, False)]
    assert apply(spark, [e[0] for e in errors], "e string", quality.is_retryable_error("e")) == [e[1] for e in errors]
    bounds = apply(spark, [0, 1, 6, 9], "a int", quality.backoff_bounds(F.lit(500), F.col("a")))
    assert [(b.low, b.high) for b in bounds] == [(375, 625), (750, 1250), (10000, 10000), (10000, 10000)]
    delays = apply(spark, [1] * 50, "a int", quality.backoff_delay(F.lit(500), F.col("a")))
    assert all(750 <= d <= 1250 for d in delays)


T = text.Transform


@pytest.mark.parametrize("value,steps,want", [
    ("  a ", [T("trim")], "a"), ("AbC", [T("lowercase")], "abc"), ("AbC", [T("uppercase")], "ABC"), ("price: $12.50", [T("regex", r"\$([0-9.]+)")], "12.50"), ("price 12", [T("regex", r"[0-9]+")], "12"),
    ("none", [T("regex", r"[0-9]+")], "none"), ("none", [T("regex", r"[0-9")], "none"), ("a.b.c", [T("split", separator=".")], ["a", "b", "c"]), (" A,B ", [T("trim"), T("lowercase"), T("split", separator=","), T("uppercase")], ["a", "b"]),
])
def test_transforms(spark, value, steps, want):
    from pagequarry.html.extract import transform

    assert apply(spark, [value], "v string", text.apply_transforms("v", steps)) == [want]
    assert transform(value, steps) == want


def test_dates(spark):
    cases = [("2024-03-01T10:00:00Z", "2024-03-01 10:00:00"), ("2024-03-01T10:00:00+02:00", "2024-03-01 08:00:00"), ("2024-03-01", "2024-03-01 00:00:00"), ("Fri, 15 Mar 2024 10:00:00 GMT", "2024-03-15 10:00:00"), ("garbage", None), ("", None), (None, None)]
    got = apply(spark, [c[0] for c in cases], "d string", text.published_at("d").cast("string"))
    assert got == [c[1] for c in cases]
    assert apply(spark, ["Fri Mar 15 10:00:00 2024 UTC", "Fri Mar  5 10:00:00 2024", "x"], "d string", text.pdf_date("d").cast("string")) == ["2024-03-15 10:00:00", "2024-03-05 10:00:00", None]


def test_pdf_text(spark):
    assert apply(spark, ["short", " \f \f", "long enough text of a page", None], "t string", pdftext.is_stub("t")) == [True, True, False, True]
    pages = apply(spark, ["a\fb\f"], "t string", pdftext.pages_of("t"))
    assert [(p.number, p.text) for p in pages[0]] == [(1, "a"), (2, "b")]
    assert apply(spark, ["Incorrect password", "PDF file is encrypted", "io"], "m string", pdftext.is_encryption_error("m")) == [True, True, False]
    info = apply(spark, ["Title:  Sample\nAuthor: J\nPages:   12\nCreationDate: Fri Mar 15 10:00:00 2024 UTC\n"], "t string", pdftext.info("t"))[0]
    assert (info.title, info.author, info.page_count, str(info.created_at)) == ("Sample", "J", 12, "2024-03-15 10:00:00")
    rungs = [("x" * 20, None, None), (" ", "y" * 20, None), (" ", " ", "z" * 20), (" ", " ", " ")]
    got = apply(spark, rungs, "a string, b string, c string", pdftext.extract("a", "b", "c"))
    assert [(g.tier, g.used_ocr, g.category) for g in got] == [("pdftotext", False, "success"), ("pdftotext-layout", False, "success"), ("tesseract", True, "success"), ("", False, "extraction_failed")]
    assert apply(spark, [(" ", " ")], "a string, b string", pdftext.extract("a", "b")["category"]) == ["pdf_tooling_missing"]
