"""Routing, queue, crawl, politeness, statistics, records, sources and streams on small frames."""

import gzip
import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagequarry import api
from pagequarry.html.spec import parse_field_spec, parse_schema
from pagequarry.operators import crawl, frontier, politeness, records, route, stats
from pagequarry.sources import config, seeds, tables
from pagequarry.streaming import jobs

TIME = "TIMESTAMP '2024-01-01 00:00:00'"
GOOD = "<p>hello</p>" + "x" * 600
WALL = "<title>Just a moment...</title>" + "x" * 600
ATT = "url string, tier string, ord int, status_code int, content_type string, body string, error string, duration_ms long"


def attempts(spark, *rows):
    return spark.createDataFrame([(u, t, o, s, "text/html", b, e, 100) for u, t, o, s, b, e in rows], ATT)


def outcome(spark, *rows, **kw):
    return {r.url: r for r in route.outcomes(route.check_attempts(attempts(spark, *rows), **kw)).collect()}


def test_first_valid_attempt_wins(spark):
    got = outcome(
        spark, ("a", "http", 0, 200, GOOD, None), ("a", "chromium", 1, 200, GOOD, None), ("b", "http", 0, 503, GOOD, None), ("b", "chromium", 1, 200, GOOD, None), ("c", "http", 0, 404, GOOD, None), ("c", "chromium", 1, 200, GOOD, None),
        ("d", "http", 0, 200, WALL, None), ("d", "chromium", 1, 200, WALL, None), ("e", "http", 0, 0, None, "dial tcp: no such host"), ("e", "chromium", 1, 0, None, "page load error"), ("f", "http", 0, 403, GOOD, None), ("f", "chromium", 1, 200, GOOD, None),
    )
    assert (got["a"].tier, got["a"].n_attempts, got["a"].error, got["a"].failure_category) == ("http", 1, None, "success")
    assert (got["b"].tier, got["b"].n_attempts, got["b"].valid) == ("chromium", 2, True)
    assert (got["c"].tier, got["c"].n_attempts, got["c"].error, got["c"].failure_category) == ("http", 1, "http: http 404", "http_4xx")
    assert got["d"].error == "all tiers exhausted: [http:soft block: cloudflare/just a moment chromium:soft block: cloudflare/just a moment]"
    assert (got["d"].soft_block.vendor, got["d"].soft_block.tiers, got["d"].failure_category) == ("cloudflare", ["http", "chromium"], "soft_block")
    assert (got["e"].status_code, got["e"].tier, got["e"].failure_category) == (0, "chromium", "dns_failure")
    assert outcome(spark, ("f", "http", 0, 403, GOOD, None), ("f", "chromium", 1, 200, GOOD, None), rotate_codes=[403])["f"].tier == "chromium"


def test_preferred_tier_goes_first(spark):
    a = attempts(spark, ("https://h.org/1", "http", 0, 200, GOOD, None), ("https://h.org/1", "chromium", 1, 200, GOOD, None), ("https://o.org/1", "http", 0, 200, GOOD, None))
    got = route.reorder(a, spark.createDataFrame([("h.org", "chromium")], "host string, tier string")).orderBy("url", "ord").collect()
    assert [(r.url[8], r.tier, r.ord) for r in got] == [("h", "chromium", 0), ("h", "http", 1), ("o", "http", 0)]


def test_content_cache(spark):
    a = attempts(spark, ("u", "http", 0, 0, None, "timeout"), ("v", "http", 0, 200, GOOD, None))
    cache = spark.createDataFrame([("u", "http", 200, "text/html", GOOD)], "url string, tier string, status_code int, content_type string, body string")
    fresh, old = cache.withColumn("stored_at", F.expr(TIME) - F.expr("INTERVAL 24 HOURS")), cache.withColumn("stored_at", F.expr(TIME) - F.expr("INTERVAL 25 HOURS"))
    made = route.walk_ladder(route.check_attempts(route.with_cache(a, fresh, F.expr(TIME), 24)))
    assert {r.url: (r.valid, r.from_cache) for r in made.collect()} == {"u": (True, True), "v": (True, False)}
    assert [r.url for r in route.cache_puts(made, F.expr(TIME)).collect()] == ["v"] and route.tier_observations(made, F.expr(TIME)).count() == 1
    for c, ttl in ((old, 24), (fresh, 0)):
        assert not any(r.from_cache for r in route.with_cache(a, c, F.expr(TIME), ttl).collect())


def test_queue(spark):
    s = spark.createDataFrame([(0, "https://e.com/?b=1&a=2", "f"), (1, "bad", ""), (2, "https://E.com/?a=2&b=1#x", ""), (70000, "https://e.com/2", "")], "pos long, url string, fallback string")
    q = frontier.enqueue(s, F.expr(TIME))
    assert [(r.url, r.seq, r.fallback) for r in q.orderBy("seq").collect()] == [("https://e.com/?a=2&b=1", 0, "f"), ("https://e.com/2", 1, "")]
    assert tuple(frontier.enqueue_summary(s).first()) == (2, 1, 1, 1)
    q = q.withColumn("state", F.when(F.col("seq") == 0, "in_flight").otherwise("queued"))
    back = frontier.recover(q).orderBy("seq").collect()
    assert [(r.seq, r.state) for r in back] == [(1, "queued"), (2, "queued")]
    assert api.resume(q).count() == 2
    c = frontier.counts(q).first()
    assert (c.queued, c.in_flight, c.done, c.success_rate) == (1, 1, 0, 0.0)
    assert [r.url for r in frontier.next_urls(q, 1).collect()] == ["https://e.com/2"]
    log = spark.createDataFrame([("u", "enqueue", "", "", 1, 0), ("u", "next", "", "", 2, 1), ("u", "failed", "http", "boom", 3, 2), ("u", "recover", "", "", 3, 3), ("u", "next", "", "", 4, 4), ("u", "done", "chromium", "", 5, 5)], "url string, op string, tier string, err string, ts int, n int")
    r = frontier.replay(log).first()
    assert (r.state, r.attempts, r.last_tier, r.last_error) == ("done", 2, "chromium", "boom")


EDGES = [("/", "a", 0), ("/", "b", 1), ("a", "c", 0), ("a", "/", 1), ("b", "d", 0), ("b", "c", 1), ("d", "e", 0), ("e", "/", 0)]


def test_crawl(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string, ord int")
    s = spark.createDataFrame([("/",)], "url string")
    run = lambda depth, limit: [(r.url, r.depth) for r in crawl.crawl(s, e, depth, limit).orderBy("rank").collect()]
    assert run(9, 0) == [("/", 0), ("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3)]
    assert run(1, 0) == [("/", 0), ("a", 1), ("b", 1)]
    assert run(9, 4) == [("/", 0), ("a", 1), ("b", 1), ("c", 2)] and run(0, 0) == [("/", 0)] and run(9, 1) == [("/", 0)]


def test_map_union(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "url string, pos long")
    b = spark.createDataFrame([("z", 0), ("y", 1)], "url string, pos long")
    assert sorted((r.url, r.source) for r in crawl.map_union(a, b).collect()) == [("x", "sitemap"), ("y", "sitemap"), ("z", "crawl")]
    assert [r.url for r in crawl.map_union(a, b, limit=1).collect()] == ["x"] and crawl.map_union(a, b, sources="crawl").count() == 2
    with pytest.raises(ValueError):
        crawl.map_union(a, b, sources="none")


def test_sitemap_limits(spark):
    docs = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc>j</loc></sitemap></sitemapindex>"), ("j", "<sitemapindex><sitemap><loc>k</loc></sitemap></sitemapindex>"), ("k", "<urlset><url><loc>p1</loc></url><url><loc>p2</loc></url></urlset>")], "url string, body string")
    start = spark.createDataFrame([("i", 0)], "url string, pos long")
    assert crawl.walk_sitemaps(docs, start, max_depth=1)[0].count() == 0
    assert [r.url for r in crawl.walk_sitemaps(docs, start, max_urls=1)[0].collect()] == ["p1"]


def test_politeness(spark):
    rules = spark.createDataFrame([(0, "*.gov", 0.5, None, None), (1, "a.gov", 9.0, None, None), (2, "X.org", None, 2, 0.3)], "rule_idx int, match string, rate double, concurrency int, jitter double")
    hosts = spark.createDataFrame([("a.gov",), ("gov",), ("x.org",), ("o.net",)], "host string")
    got = {r.host: (r.rule_idx, r.rate, r.concurrency, r.jitter) for r in politeness.host_rules(hosts, rules).collect()}
    assert got == {"a.gov": (0, 0.5, 4, 0.0), "gov": (None, 1.0, 4, 0.0), "x.org": (2, 1.0, 2, 0.3), "o.net": (None, 1.0, 4, 0.0)}
    files = spark.createDataFrame([("h", 200, "User-agent: mybot\nDisallow: /only\n\nUser-agent: *\nDisallow: /private/ # no\nAllow: /private/ok\nDisallow:\n"), ("g", 404, "User-agent: *\nDisallow: /")], "host string, status int, body string")
    u = spark.createDataFrame([("https://h/private/x", "h"), ("https://h/private/ok?q", "h"), ("https://h/only", "h"), ("https://g/x", "g"), ("https://h", "h")], "url string, host string")
    allowed = lambda agent: [r.allowed for r in sorted(politeness.robots_allowed(u, politeness.parse_robots(files, agent)).collect(), key=lambda r: r.url)]
    assert allowed("*") == [True, True, True, True, False] and allowed("MyBot/1.0") == [True, True, False, True, True]
    q = spark.createDataFrame([("h", i) for i in range(4)], "host string, seq long")
    assert [r.start_s for r in politeness.pacing(q, F.lit(2.0), 2).orderBy("seq").collect()] == [0, 0, 0.5, 1]


def test_statistics(spark):
    rows = [("http", 100, "success"), ("http", 200, "success"), ("http", 300, "success"), ("chromium", 2500, "success"), ("http", 0, "dns_failure"), ("", 5, "")]
    r = spark.createDataFrame(rows, "tier string, duration_ms long, failure_category string")
    assert tuple(stats.totals(r).first()) == (6, 4, 2)
    assert stats.escalation_rate(r).first()[0] == 0.25
    assert {x.tier: tuple(x)[1:] for x in stats.latency(r).collect()} == {"http": (3, 200, 100, 300), "chromium": (1, 2500, 2500, 2500)}
    assert {x.tier: (x.attempted, x.succeeded) for x in stats.by_tier(r).collect()} == {"http": (4, 3), "chromium": (1, 1)}
    s = stats.snapshot(r).first()
    assert s.failures_by_category == {"success": 4, "dns_failure": 1, "uncategorized": 1} and s.latency["http"].avg_ms == 200


def test_fallbacks(spark):
    p = spark.createDataFrame([("a", "f", "http", 404, "http_4xx"), ("b", "f", "http", 404, "http_4xx"), ("c", "f", "http", 500, "http_5xx"), ("d", "", "http", 404, "http_4xx"), ("e", "f", "http", 0, "dns_failure")], "url string, fallback_url string, tier string, status_code int, failure_category string")
    f = spark.createDataFrame([("a", "f/x", "http", 200, "success"), ("b", None, None, None, "no_link"), ("c", "f/x", "http", 200, "success"), ("e", "f/x", "http", 500, "http_5xx")], "url string, followed string, tier string, status_code int, failure_category string")
    o = route.overlay_fallback(p, f)
    assert {r.url: (r.failure_category, r.discovery, r.fallback_state) for r in o.collect()} == {"a": ("success", "fallback", "succeeded"), "b": ("http_4xx", "primary", "no_link"), "c": ("http_5xx", "primary", "not_tried"), "d": ("http_4xx", "primary", "not_tried"), "e": ("dns_failure", "primary", "unreachable")}
    assert tuple(stats.fallbacks(o).first()) == (3, 1, 1, 1)


def test_records_and_sinks(spark, tmp_path):
    page = '<html lang="en"><head><title>T</title></head><body><h1>Head</h1><a href="/x">x</a>' + "<p>text</p>" * 80 + "</body></html>"
    outs = route.outcomes(route.check_attempts(attempts(spark, ("https://e.com/a", "http", 0, 200, page, None), ("https://e.com/b", "http", 0, 404, "no", None))))
    schema = parse_schema({"version": 1, "fields": {"h": {"selector": "h1"}, "link": {"selector": "a", "attr": "href"}}})
    recs = records.build(outs, F.expr(TIME), [parse_field_spec("h=title"), parse_field_spec("none=.none")], schema, "markdown")
    a, b = recs.orderBy("url").collect()
    assert a.extracted.asDict() == {"none": None, "h": "Head", "link": "/x"} and a.body.startswith("# Head") and a.metadata.page.title == "T" and tuple(a.metadata.extraction) == (2, 1)  # of the flat fields
    assert (b.failure_category, b.metadata.page, b.metadata.body_bytes) == ("http_4xx", None, 2)
    assert [r.url for r in records.dead_letters(recs).collect()] == ["https://e.com/b"]
    lines = [json.loads(r.line) for r in records.jsonl(recs).collect()]
    assert all("none" not in x.get("extracted", {}) for x in lines) and sum("extracted" in x for x in lines) == 1
    records.write(recs, f"{tmp_path}/r.jsonl")
    assert tables.read_records(spark, f"{tmp_path}/r.jsonl").where("extracted['h'] = 'Head'").count() == 1
    records.write(recs, f"{tmp_path}/r.csv", ["url", "extracted.h", "metadata.page.title"])
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"{tmp_path}/r.csv").collect()), key=str)[0] == ("https://e.com/a", "Head", "T")
    flat = records.flatten(recs)
    assert flat.columns[-3:] == ["extracted.h", "extracted.link", "extracted.none"] and flat.first()["content_type"] == ""
    assert {r["content_type"] for r in records.flatten(recs, parity=False).collect()} == {"text/html"}
    with pytest.raises(ValueError):
        records.write(recs, f"{tmp_path}/x.jsonl", ["url"])


def test_seed_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# comment\nhttps://a.org/\n\n  https://b.org/  \n")
    (tmp_path / "s.csv").write_text("name, URL, other\nx, https://a.org/, https://f.org/\ny,,\nz, https://b.org/\n")
    (tmp_path / "s.tsv").write_text("first\tsecond\nhttps://a.org/\t1\n")
    assert [r.url for r in seeds.read_seeds(spark, f"{tmp_path}/s.txt").collect()] == ["https://a.org/", "https://b.org/"]
    assert [(r.url, r.fallback) for r in seeds.read_seeds(spark, f"{tmp_path}/s.csv", fallback_column="OTHER").collect()] == [("https://a.org/", "https://f.org/"), ("https://b.org/", "")]
    assert [r.url for r in seeds.read_seeds(spark, f"{tmp_path}/s.tsv").collect()] == ["https://a.org/"]
    with pytest.raises(ValueError):
        seeds.read_seeds(spark, f"{tmp_path}/s.txt", fallback_column="x")
    for n in (1 << 20, (1 << 20) + 1):
        (tmp_path / "long.txt").write_text("https://a.org/\n" + "q" * n + "\n")
        if n == 1 << 20:
            assert seeds.read_seeds(spark, f"{tmp_path}/long.txt").count() == 2
        else:
            with pytest.raises(Exception, match="longer than"):
                seeds.read_seeds(spark, f"{tmp_path}/long.txt").collect()
    for bad in ({"url_column": "none"}, {"url_column": "url", "fallback_column": "url"}):
        with pytest.raises(ValueError):
            seeds.read_seeds(spark, f"{tmp_path}/s.csv", **bad)
    (tmp_path / "m.xml.gz").write_bytes(gzip.compress(b"<urlset><url><loc>p</loc></url></urlset>"))
    assert crawl.parse_sitemap(tables.read_sitemap_files(spark, f"{tmp_path}/m.xml.gz")).first().urls == ["p"]


def test_configuration(tmp_path):
    p = f"{tmp_path}/job.json"
    config.JobConfig(id="j", depth=5).save(p)
    assert config.JobConfig.load(p).check().depth == 5 and config.JobConfig(force_tier="http").ladder == ["http"]
    assert re.fullmatch(r"\d{8}T\d{6}-[0-9a-f]{12}", config.new_id())
    for bad in ({"fallback_column": "x"}, {"csv_columns": ["a"]}, {"format": "pdf"}, {"tiers": ["x"]}, {"timeout": "soon"}, {"force_tier": "x"}, {"proxy_url": "http://a", "proxy_file": "b"}, {"rotate_on_status": "4x"}, {"actions": ["jump:x"]}):
        with pytest.raises(ValueError):
            config.JobConfig(**bad).check()
    assert config.parse_action("type:#q=text") == config.Action("type", "#q", "text") and config.parse_action("sleep:2s").value == "2s"
    for bad in ("click", "click:", "sleep:later", "jump:x", "type:#q"):
        with pytest.raises(ValueError):
            config.parse_action(bad)
    Path(f"{tmp_path}/a.yaml").write_text("version: 1\nactions:\n  - {type: click, selector: a}\n  - {type: sleep, value: 1s}\n")
    assert [a.type for a in config.load_actions(f"{tmp_path}/a.yaml")] == ["click", "sleep"]
    with pytest.raises(ValueError):
        config.parse_host_rules({"version": 1, "rules": [{"match": "x"}]})
    assert config.parse_status_codes("403, 429") == [403, 429] and config.parse_viewport("1280x720") == (1280, 720) and config.parse_tiers("http") == ["http"]
    for f, bad in ((config.parse_status_codes, "4x"), (config.parse_viewport, "0x1"), (config.parse_tiers, "ftp")):
        with pytest.raises(ValueError):
            f(bad)
    assert config.mask_proxy("http://u:p@h:1") == "http://***@h:1" and config.duration_ms("1h30m") == 5.4e6


def test_commands(spark):
    a = attempts(spark, ("https://e.com/", "http", 0, 200, '<a href="/a">a</a><a href="https://o.org/">o</a>' + GOOD, None), ("https://e.com/a", "http", 0, 200, '<a href="/b?utm_source=x">b</a>' + GOOD, None))
    seed = spark.createDataFrame([("https://E.com",)], "url string")
    assert [r.url for r in api.crawl(seed, a, config.JobConfig()).orderBy("rank").collect()] == ["https://e.com/", "https://e.com/a", "https://e.com/b"]
    s = spark.createDataFrame([(0, "https://E.com#x", ""), (1, "https://e.com/", "")], "pos long, url string, fallback string")
    assert [r.url for r in api.batch(s, a, config.JobConfig(selectors=["l=a@href"]), F.expr(TIME)).collect()] == ["https://e.com/"]


def test_a_batch_from_seeds_to_files(spark, tmp_path):
    good = lambda t: f"<html><head><title>{t}</title></head><body><h1>{t}</h1><a class='to' href='/{t}x?utm_source=q'>to</a>" + "<p>text</p>" * 80 + "</body></html>"
    e = "https://e.com/"
    a = attempts(
        spark,
        (e, "http", 0, 200, good("home"), None), (e + "gone", "http", 0, 404, "no", None), (e + "lost", "http", 0, 404, "no", None), (e + "dead", "http", 0, 0, None, "lookup: no such host"),
        (e + "old", "http", 0, 200, good("old"), None), (e + "oldx", "http", 0, 200, good("found"), None), (e + "bare", "http", 0, 200, GOOD, None), (e + "slow", "http", 0, 503, "x", None),
        (e + "slow", "chromium", 1, 200, good("slow"), None), (e + "down", "http", 0, 500, "x", None), (e + "barred/x", "http", 0, 200, good("barred"), None), (e + "kept", "http", 0, 503, "x", None),
    )
    rows = [(e, ""), (e + "gone", e + "old"), (e + "lost", e + "bare"), (e + "dead", e + "nowhere"), (e + "slow", e + "old"), (e + "down", e + "old"), (e + "barred/x", ""), (e + "kept", ""), (e + "never", "")]
    seeds_ = spark.createDataFrame([(i, u, f) for i, (u, f) in enumerate(rows)], "pos long, url string, fallback string")
    rules = spark.createDataFrame([("e.com", "disallow", "/barred/*", 0)], "host string, type string, path string, n int")
    cache = spark.createDataFrame([(e + "kept", "http", 200, "text/html", good("cached"), "2024-01-31 23:00:00")], "url string, tier string, status_code int, content_type string, body string, stored_at string").withColumn("stored_at", F.to_timestamp("stored_at"))
    cfg = config.JobConfig(selectors=["h=h1"], fallback_column="f", fallback_selector="a.to", cache_enabled=True, format="json", output="out.jsonl")
    job = api.batch_job(seeds_, a, cfg, F.expr(TIME), robots=rules, content_cache=cache)
    got = {r.url: r for r in job.records.collect()}
    assert {u.removeprefix(e): (r.failure_category, r.tier) for u, r in got.items()} == {
        "": ("success", "http"), "gone": ("success", "http"), "lost": ("http_4xx", "http"), "dead": ("dns_failure", "http"), "slow": ("success", "chromium"), "down": ("http_5xx", "http"), "barred/x": ("robots_blocked", "http"), "kept": ("success", "http"),
    }
    gone = got[e + "gone"]
    assert gone.canonical_url == e + "oldx" and gone.extracted.h == "found" and tuple(gone.metadata.discovery) == ("fallback", e + "gone", e + "old") and json.loads(gone.body) == {"h": "found"}
    assert tuple(got[e + "slow"].metadata.discovery) == ("primary", e + "slow", e + "old") and got[e].metadata.discovery is None
    assert got[e + "kept"].metadata.from_cache and not got[e].metadata.from_cache and got[e + "barred/x"].metadata is None
    assert tuple(job.fallbacks.first()) == (3, 1, 1, 1)
    assert sorted(r.url.removeprefix(e) for r in job.dead_letters.collect()) == ["barred/x", "dead", "down", "lost"]
    s = job.stats.first()
    assert (s.total, s.reachable, s.failures_by_category["robots_blocked"]) == (8, 4, 1)
    assert {(r.url.removeprefix(e), r.tier) for r in job.cache_puts.collect()} == {("", "http"), ("slow", "chromium"), ("old", "http"), ("oldx", "http"), ("bare", "http")}
    assert [r.host for r in job.tiers.collect()] == ["e.com"]
    api.write_job(job, cfg, str(tmp_path))
    assert tables.read_records(spark, f"{tmp_path}/out.jsonl").count() == 8 and spark.read.json(f"{tmp_path}/dead_letter.jsonl").count() == 4 and spark.read.json(f"{tmp_path}/stats.json").first().total == 8
    only = api.batch(seeds_, a, config.JobConfig(force_tier="chromium"), F.expr(TIME))
    assert [(r.url, r.metadata.extraction) for r in only.collect()] == [(e + "slow", None)]


def test_maps_follow_pages_of_any_status(spark):
    a = attempts(spark, ("https://e.com/", "http", 0, 404, '<a href="/a">a</a>', None), ("https://e.com/a", "http", 0, 200, '<a href="/b">b</a>', None))
    seed = spark.createDataFrame([("https://e.com",)], "url string")
    maps = spark.createDataFrame([], "url string, body string"), spark.createDataFrame([], "url string, pos long")
    assert [r.url for r in api.site_map(seed, a, *maps, config.JobConfig(depth=2, sources="crawl")).orderBy("pos").collect()] == ["https://e.com/", "https://e.com/a", "https://e.com/b"]
    assert [r.url for r in api.crawl(seed, a, config.JobConfig()).collect()] == ["https://e.com/"]


def test_pdf_records_hold_their_pages(spark):
    outs = spark.createDataFrame([("u", True, "http", 200, "application/pdf", "%PDF-1.7 raw", 5, None, "success", None)], "url string, valid boolean, tier string, status_code int, content_type string, body string, duration_ms long, error string, failure_category string, soft_block struct<detected:boolean,vendor:string,marker:string,tiers:array<string>>")
    texts = spark.createDataFrame([("u", "First page of it all.\fSecond page.\f", None, None, "Title: Report\nPages: 2\n")], "url string, plain string, layout string, ocr string, info string")
    r = records.build(records.apply_pdf(outs, texts), F.expr(TIME), body_format="html").first()
    assert [tuple(p) for p in r.metadata.pdf.pages] == [(1, "First page of it all."), (2, "Second page.")] and r.metadata.page.title == "Report"
    assert (r.body_format, r.metadata.body_bytes, r.body) == ("markdown", 12, "First page of it all.\n\nSecond page.\n\n")


def stream_of(spark, df, path):
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_cache_entries_live_for_their_time(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    schema = "ts timestamp, url string, tier string, body string"
    files = [[(0, "a", "one"), (1, "b", "two"), (30, "a", "newer"), (20, "a", "older")], [(70, "c", "x")], [(120, "d", "y")], [(121, "d", "z")]]
    for k, rows in enumerate(files):
        spark.createDataFrame([(t0 + timedelta(minutes=m), u, "http", body) for m, u, body in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/k={k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    out = jobs.run_to_end(jobs.cache_entries(stream, ttl_ms=3_600_000, late="0 seconds"), "update", f"{tmp_path}/out").collect()
    minute = lambda r: (r.stored_ms // 60_000) % 1440
    assert [(r.body, minute(r)) for r in out if r.url == "a" and r.live] == [("newer", 30)]
    assert {(r.url, r.body) for r in out if not r.live} == {("b", "two"), ("a", "newer")}


def test_jitter_only_adds(spark):
    q = spark.createDataFrame([(f"h{i % 3}", i) for i in range(60)], "host string, seq long")
    a, b = ({(r.host, r.seq): r.start_s for r in politeness.pacing(q, F.lit(2.0), 1, j).collect()} for j in (0.0, 0.5))
    assert all(0 <= b[k] - a[k] <= 0.25 for k in a) and sum(b[k] > a[k] for k in a) > 40


def test_streams_equal_batches(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=7 * i), f"h{i % 4}", "chromium" if i % 3 == 0 else "http", "success" if i % 2 else "http_4xx", i) for i in range(60)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, host string, tier string, category string, duration_ms long")
    run = lambda f, name, mode, df=log: jobs.run_to_end(f(stream_of(spark, df, f"{tmp_path}/{name}")), mode, f"{tmp_path}/{name}-out").collect()
    assert {(r.host, r.tier) for r in run(jobs.learn_tiers, "tiers", "complete")} == {(r.host, r.tier) for r in route.latest_tier(log.where("category = 'success'"), "ts", "event_id").collect()}
    assert sorted(map(tuple, run(jobs.live_stats, "live", "complete"))) == sorted(map(tuple, jobs.live_stats(log).collect()))
    hourly = {tuple(r) for r in run(lambda s: jobs.hourly(s, "30 days"), "hourly", "append")}
    assert hourly <= {tuple(r) for r in jobs.hourly(log).collect()}
    queue = log.select("host", F.col("event_id").alias("seq"))
    assert sorted(r.start_s for r in run(lambda s: jobs.pacer(s, 0.5, 2), "pace", "append", queue)) == sorted(r.start_s for r in politeness.pacing(queue, F.lit(0.5), 2).collect())
    urls = spark.createDataFrame([("https://E.com/#a",), ("https://e.com/",), ("https://e.com/2",), ("bad",)], "url string")
    assert {r.canonical_url for r in run(jobs.dedup_queue, "seen", "append", urls)} == {"https://e.com/", "https://e.com/2"}
    ops = spark.createDataFrame([("u", "enqueue", "", "", t0, 0), ("u", "next", "", "", t0, 1), ("u", "failed", "http", "boom", t0, 2)], "url string, op string, tier string, err string, ts timestamp, n long").coalesce(1)
    ops.write.parquet(f"{tmp_path}/ops")
    stream = spark.readStream.schema(ops.schema).parquet(f"{tmp_path}/ops")
    got = jobs.run_to_end(jobs.state_machine(stream), "update", f"{tmp_path}/ops-out").collect()
    assert [tuple(r) for r in got] == [("u", "failed", 1, "http", "boom", 1)]
