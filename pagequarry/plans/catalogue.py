"""The registered queries and their SQL twins: one entry an operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import pdftext, quality, text, urls
from pagequarry.html.functions import merge_fields, page_metadata, parse_page
from pagequarry.html.spec import parse_field_spec, parse_schema
from pagequarry.operators import crawl, frontier, politeness, records, route, stats
from pagequarry.plans import inputs as I
from pagequarry.plans import oracle as O
from pagequarry.plans.inputs import duck, spark_input
from pagequarry.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


# ---- URLs ----

_C = O.canonical("url")


@register(f"""SELECT host, count(*) AS n_pages, CAST(sum(bytes) AS BIGINT) AS n_bytes, CAST(sum(n_links) AS BIGINT) AS n_links FROM (
  SELECT {O.host("canonical_url")} AS host, bytes, n_links FROM (SELECT {_C} AS canonical_url, strlen(html) AS bytes, len(list_distinct({O.links("html")})) AS n_links, row_number() OVER (PARTITION BY {_C} ORDER BY page_id) AS rn FROM pages) p WHERE rn = 1) q GROUP BY host""")
def host_summary(spark, d):
    links = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))))
    p = _pages(spark, d).select("page_id", "url", F.octet_length("html").alias("bytes"), links.alias("n_links"))
    first = frontier.first_seen(p, "page_id")
    return first.groupBy(urls.url_host("canonical_url").alias("host")).agg(F.count(F.lit(1)).alias("n_pages"), F.sum("bytes").cast("long").alias("n_bytes"), F.sum("n_links").alias("n_links"))


@register(f"SELECT page_id, {_C} AS canonical_url FROM pages")
def canonical_urls(spark, d):
    return _pages(spark, d).select("page_id", urls.canonicalize_url("url").alias("canonical_url"))


@register(f"SELECT page_id, {O.canonical('url', fragment=True)} AS canonical_url FROM pages")
def canonical_keep_fragment(spark, d):
    return _pages(spark, d).select("page_id", urls.canonicalize_url("url", keep_fragment=True).alias("canonical_url"))


@register(f"SELECT page_id, {O.canonical('url', tracking=['page'])} AS canonical_url FROM pages")
def canonical_custom_params(spark, d):
    return _pages(spark, d).select("page_id", urls.canonicalize_url("url", ["page"]).alias("canonical_url"))


_ODD = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN upper(url) WHEN 1 THEN concat(' ', replace(url, '.example', '.EXAMPLE'), ' ') WHEN 2 THEN regexp_replace(url, '^(https?)://([^/?#]*)', 'http://u@{port}') WHEN 3 THEN 'not-a-url' ELSE url END AS url FROM {pages}"
_ODD = _ODD.replace("u@{port}", "u@H.example.org:8080")


@register(f"SELECT page_id, {O.host('url')} AS host, {O.host_raw('url')} AS host_raw, {_C} AS canonical_url FROM ({duck(_ODD)}) o")
def url_hosts(spark, d):
    return spark_input(spark, d, _ODD).select("page_id", urls.url_host("url").alias("host"), urls.host_of("url").alias("host_raw"), urls.canonicalize_url("url").alias("canonical_url"))


@register(f"""SELECT page_id, pattern, CASE WHEN pattern[1] = '*' THEN ends_with(h, substr(pattern, 2)) AND length(h) > length(pattern) - 1 ELSE h = pattern END AS matches
FROM (SELECT page_id, {O.host("url")} AS h FROM pages) p, (SELECT unnest(['*.example.org', '*.com', 'm.ththth.example.net', '*.net']) AS pattern) q""")
def host_patterns(spark, d):
    patterns = F.explode(F.array(*[F.lit(x) for x in ("*.example.org", "*.com", "m.ththth.example.net", "*.net")])).alias("pattern")
    return _pages(spark, d).select("page_id", urls.url_host("url").alias("h"), patterns).select("page_id", "pattern", urls.match_host_pattern(F.col("h"), F.col("pattern")).alias("matches"))


@register("SELECT page_id, concat('sha256:', sha256(html)) AS content_hash, concat('shots/', sha256(url), '.png') AS screenshot FROM pages")
def content_hash(spark, d):
    return _pages(spark, d).select("page_id", urls.content_hash("html").alias("content_hash"), records.screenshot_path("shots", F.col("url")).alias("screenshot"))


@register(f"""SELECT page_id, i, concat(regexp_extract(url, '^([^/]*//[^/?#]*)', 1), CASE i WHEN 0 THEN '/a/b' WHEN 1 THEN '/y' WHEN 2 THEN '/z?q=1#f' ELSE concat(CASE WHEN {O.part("url", 3)} = '' THEN '/' ELSE {O.part("url", 3)} END, '?k=v') END) AS resolved
FROM pages, (SELECT unnest([0, 1, 2, 3]) AS i) n""")
def resolved_links(spark, d):
    ref = F.posexplode(F.array(F.lit("/a/b"), F.lit("/x/../y"), F.lit("/./z?q=1#f"), F.lit("?k=v"))).alias("i", "ref")
    p = _pages(spark, d).select("page_id", "url", ref)
    base = F.when(urls.part(F.col("url"), 3) == "", F.regexp_replace("url", r"^([^/]*//[^/?#]*)", "$1/")).otherwise(F.col("url"))
    return p.select("page_id", "i", urls.resolve_url(base, "ref").alias("resolved"))


_FNV = f"list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(range(1, length({O.host('url')}) + 1), lambda i: CAST(ascii(substr({O.host('url')}, CAST(i AS BIGINT), 1)) AS HUGEINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296)"


@register(f"SELECT page_id, CAST(fnv AS BIGINT) AS fnv, CAST(fnv % 7 AS INTEGER) AS slot FROM (SELECT page_id, {_FNV} AS fnv FROM pages) p")
def proxy_pool(spark, d):
    return _pages(spark, d).select("page_id", urls.fnv1a_32(urls.url_host("url")).alias("fnv"), urls.pool_index(urls.url_host("url"), 7).alias("slot"))


# ---- queue ----

_SEEN = f"SELECT *, row_number() OVER (PARTITION BY c ORDER BY pos) AS rn FROM (SELECT *, {_C} AS c FROM ({duck(I.SEEDS)}) s) t WHERE c IS NOT NULL"


@register(f"SELECT c AS canonical_url, pos, fallback FROM ({_SEEN}) x WHERE rn = 1")
def first_seen_dedup(spark, d):
    return frontier.first_seen(spark_input(spark, d, I.SEEDS)).select("canonical_url", "pos", "fallback")


@register(f"SELECT c AS url, fallback, row_number() OVER (ORDER BY pos) - 1 AS seq FROM ({_SEEN}) x WHERE rn = 1")
def frontier_seq(spark, d):
    return frontier.enqueue(spark_input(spark, d, I.SEEDS), F.expr(NOW)).select("url", "fallback", "seq")


@register(f"""SELECT (SELECT count(*) FROM ({_SEEN}) x WHERE rn = 1) AS added, (SELECT count(*) FROM ({_SEEN}) x WHERE rn > 1) AS dupes,
  (SELECT count(*) FROM ({duck(I.SEEDS)}) s WHERE {_C} IS NULL) AS skipped, (SELECT count(*) FROM ({_SEEN}) x WHERE rn = 1 AND fallback <> '') AS with_fallback""")
def enqueue_summary(spark, d):
    return frontier.enqueue_summary(spark_input(spark, d, I.SEEDS))


_STATE = "CASE WHEN op IN ('enqueue', 'recover') THEN 'queued' WHEN op = 'next' THEN 'in_flight' WHEN op = 'done' THEN 'done' ELSE 'failed' END"


@register(f"""SELECT url, max_by({_STATE}, n) AS state, CAST(count(*) FILTER (op = 'next') AS INTEGER) AS attempts, coalesce(max_by(tier, n) FILTER (op IN ('done', 'failed')), '') AS last_tier,
  coalesce(max_by(err, n) FILTER (op = 'failed'), '') AS last_error FROM (SELECT url, op, tier, err, row_number() OVER (ORDER BY ts, n) AS n FROM ({duck(I.OPS)}) o) p GROUP BY url""")
def frontier_states(spark, d):
    return frontier.replay(spark_input(spark, d, I.OPS)).select("url", "state", "attempts", "last_tier", "last_error")


@register(f"""SELECT count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'in_flight') AS in_flight, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) AS total,
  round(count(*) FILTER (state = 'done') / count(*) FILTER (state IN ('done', 'failed')), 6) AS success_rate FROM ({duck(I.FRONTIER)}) f""")
def frontier_counts(spark, d):
    return frontier.counts(spark_input(spark, d, I.FRONTIER)).withColumn("success_rate", F.round("success_rate", 6))


@register(f"""WITH f AS ({duck(I.FRONTIER)}) SELECT url, state, seq FROM f WHERE state <> 'in_flight'
UNION ALL SELECT url, 'queued', (SELECT max(seq) FROM f) + row_number() OVER (ORDER BY seq) FROM f WHERE state = 'in_flight'""")
def frontier_recover(spark, d):
    return frontier.recover(spark_input(spark, d, I.FRONTIER))


@register(f"SELECT url, seq FROM ({duck(I.FRONTIER)}) f WHERE state = 'queued' ORDER BY seq LIMIT 10")
def frontier_next(spark, d):
    return frontier.next_urls(spark_input(spark, d, I.FRONTIER), 10).select("url", "seq")


@register("SELECT DISTINCT l.page_id, l.url FROM (SELECT page_id, concat('https://p', page_id * 2, '.example.org/') AS url FROM pages) l WHERE l.url NOT IN (SELECT concat('https://p', page_id, '.example.org/') FROM pages)")
def seen_anti_join(spark, d):
    p = _pages(spark, d)
    links = p.select("page_id", F.concat(F.lit("https://p"), F.col("page_id") * 2, F.lit(".example.org/")).alias("url"))
    return frontier.unseen(links, p.select(F.concat(F.lit("https://p"), "page_id", F.lit(".example.org/")).alias("url"))).select("page_id", "url")


# ---- quality and routing ----

_A = duck(I.ATTEMPTS)
_K = duck(I.KEYED_ATTEMPTS)


@register(f"SELECT page_id, tier, {O.html('content_type')} AS html, contains(content_type, 'application/pdf') OR contains(content_type, 'application/x-pdf') AS pdf, contains(content_type, 'application/json') OR contains(content_type, '+json') AS json FROM ({_A}) a")
def content_kind(spark, d):
    a = spark_input(spark, d, I.ATTEMPTS)
    return a.select("page_id", "tier", quality.is_html("content_type").alias("html"), quality.is_pdf("content_type").alias("pdf"), quality.is_json("content_type").alias("json"))


@register(f"SELECT page_id, tier, valid, reason, escalate FROM ({O.checked(_A)}) c")
def validity_check(spark, d):
    return route.check_attempts(spark_input(spark, d, I.ATTEMPTS)).select("page_id", "tier", "valid", "reason", "escalate")


@register(f"SELECT page_id, tier, {O.soft_block('body', 'vendor')} AS vendor, {O.soft_block('body', 'marker')} AS marker FROM ({_A}) a")
def soft_block(spark, d):
    a = spark_input(spark, d, I.ATTEMPTS).withColumn("b", quality.soft_block("body"))
    return a.select("page_id", "tier", "b.vendor", "b.marker")


@register(f"SELECT page_id, tier, {O.shell('body')} AS shell FROM ({_A}) a")
def spa_shell(spark, d):
    a = spark_input(spark, d, I.ATTEMPTS)
    return a.select("page_id", "tier", parse_page("body", "url", shell=True)["shell"].alias("shell"))


@register(f"SELECT page_id, tier, {O.classify('error', 'reason', 'status_code')} AS category FROM ({O.checked(_A)}) c")
def failure_class(spark, d):
    c = route.check_attempts(spark_input(spark, d, I.ATTEMPTS))
    return c.select("page_id", "tier", quality.classify_failure("error", "reason", "status_code").alias("category"))


@register(f"SELECT category, count(*) AS n, {O.reachable('category')} AS reachable, category IN ('http_4xx', 'dns_failure') AS try_fallback FROM (SELECT {O.classify('error', 'reason', 'status_code')} AS category FROM ({O.checked(_A)}) c) k GROUP BY category")
def reachability(spark, d):
    c = route.check_attempts(spark_input(spark, d, I.ATTEMPTS)).select(quality.classify_failure("error", "reason", "status_code").alias("category"))
    n = c.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return n.select("category", "n", quality.is_reachable("category").alias("reachable"), quality.should_try_fallback("category").alias("try_fallback"))


@register(f"""SELECT page_id, tier, status_code IN (429, 502, 503, 504) AS by_status, NOT regexp_matches(lower(coalesce(error, '')), 'context canceled|context deadline exceeded|x509:|certificate')
  AND regexp_matches(lower(coalesce(error, '')), 'timeout|timed out|connection reset|connection refused|network is unreachable|no route to host|eof|use of closed network connection|^(dial|read|write) (tcp|udp)') AS by_error FROM ({_A}) a""")
def retryable(spark, d):
    a = spark_input(spark, d, I.ATTEMPTS)
    return a.select("page_id", "tier", quality.is_retryable_status("status_code").alias("by_status"), quality.is_retryable_error("error").alias("by_error"))


@register("SELECT page_id, round(least(500 * power(2, least(page_id % 9, 6)) * 0.75, 10000), 6) AS low, round(least(500 * power(2, least(page_id % 9, 6)) * 1.25, 10000), 6) AS high FROM pages")
def backoff_envelope(spark, d):
    b = _pages(spark, d).withColumn("b", quality.backoff_bounds(F.lit(500), (F.col("page_id") % 9).cast("int")))
    return b.select("page_id", F.round("b.low", 6).alias("low"), F.round("b.high", 6).alias("high"))


_OUT = f"""SELECT url, max(CASE WHEN valid THEN 1 ELSE 0 END) = 1 AS valid, arg_max(tier, ord) AS tier, coalesce(arg_max(status_code, ord) FILTER (WHERE coalesce(error, '') = ''), 0) AS status_code, count(*) AS n_attempts,
  CASE WHEN max(CASE WHEN valid THEN 1 ELSE 0 END) = 1 THEN NULL WHEN NOT arg_max(escalate, ord) THEN concat(arg_max(tier, ord), ': ', arg_max(CASE WHEN coalesce(error, '') <> '' THEN error ELSE reason END, ord))
  ELSE concat('all tiers exhausted: [', string_agg(concat(tier, ':', CASE WHEN coalesce(error, '') <> '' THEN error ELSE reason END), ' ' ORDER BY ord), ']') END AS error FROM ({O.made(_K)}) m GROUP BY url"""


def _outcomes(spark, d):
    return route.outcomes(route.check_attempts(spark_input(spark, d, I.KEYED_ATTEMPTS)))


@register(f"SELECT url, valid, tier, CAST(n_attempts AS INTEGER) AS n_attempts, error, CASE WHEN valid THEN 'success' ELSE {O.classify('error', chr(39) * 2, 'status_code')} END AS failure_category FROM ({_OUT}) o")
def route_winner(spark, d):
    return _outcomes(spark, d).select("url", "valid", "tier", "n_attempts", "error", "failure_category")


@register(f"SELECT url, status_code FROM ({_OUT}) o WHERE NOT valid")
def route_last_evidence(spark, d):
    return _outcomes(spark, d).where(~F.col("valid")).select("url", "status_code")


@register(f"SELECT url, error FROM ({_OUT}) o WHERE starts_with(error, 'all tiers exhausted')")
def exhausted_reason(spark, d):
    return _outcomes(spark, d).where(F.col("error").startswith("all tiers exhausted")).select("url", "error")


@register(f"""SELECT url, arg_min({O.soft_block('body', 'vendor')}, ord) AS vendor, arg_min({O.soft_block('body', 'marker')}, ord) AS marker, string_agg(tier, ',' ORDER BY ord) AS tiers
FROM ({O.made(_K)}) m WHERE starts_with(reason, 'soft block') GROUP BY url""")
def soft_block_rollup(spark, d):
    return _outcomes(spark, d).where("soft_block IS NOT NULL").select("url", "soft_block.vendor", "soft_block.marker", F.array_join("soft_block.tiers", ",").alias("tiers"))


@register(f"SELECT url, {O.classify('error', chr(39) * 2, 'status_code')} AS failure_category FROM ({_OUT}) o WHERE NOT valid AND NOT {O.reachable(O.classify('error', chr(39) * 2, 'status_code'))}")
def dead_letter(spark, d):
    return records.dead_letters(_outcomes(spark, d)).select("url", "failure_category")


@register(f"SELECT url, tier, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN tier = CASE WHEN page_id % 2 = 0 THEN 'chromium' ELSE 'http' END THEN 0 ELSE 1 END, ord) - 1 AS ord FROM ({_K}) a")
def route_reorder(spark, d):
    a = spark_input(spark, d, I.KEYED_ATTEMPTS)
    preferred = a.select(urls.host_of("url").alias("host"), F.when(F.col("page_id") % 2 == 0, "chromium").otherwise("http").alias("tier")).distinct()
    return route.reorder(a, preferred).select("url", "tier", F.col("ord").cast("long").alias("ord"))


_LOG = duck(I.FETCH_LOG)


@register(f"SELECT host, arg_max(tier, k) AS tier FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k FROM ({_LOG}) l WHERE category = 'success') m GROUP BY host")
def tier_learning(spark, d):
    log = spark_input(spark, d, I.FETCH_LOG).where("category = 'success'")
    return route.latest_tier(log, "ts", "event_id").select("host", "tier")


@register(f"""SELECT l.host, coalesce(t.tier, 'http') AS tier, count(*) AS n FROM ({_LOG}) l LEFT JOIN (SELECT host, arg_max(tier, k) AS tier FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k FROM ({_LOG}) l WHERE category = 'success') m GROUP BY host) t ON t.host = l.host GROUP BY 1, 2""")
def tier_lookup(spark, d):
    log = spark_input(spark, d, I.FETCH_LOG)
    known = route.latest_tier(log.where("category = 'success'"), "ts", "event_id").select("host", F.col("tier").alias("known"))
    return log.join(known, "host", "left").groupBy("host", F.coalesce("known", F.lit("http")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@register(f"""SELECT url, tier, page_id % 3 = 0 AND page_id % 48 <= 24 AND tier = 'http' AS from_cache, CASE WHEN page_id % 3 = 0 AND page_id % 48 <= 24 AND tier = 'http' THEN 200 ELSE status_code END AS status_code FROM ({_K}) a""")
def content_cache_hit(spark, d):
    a = spark_input(spark, d, I.KEYED_ATTEMPTS)
    stored = F.expr(NOW) - F.make_dt_interval(F.lit(0), (F.col("page_id") % 48).cast("int"))
    cache = a.where("page_id % 3 = 0 AND tier = 'http'").select("url", "tier", F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.lit("cached").alias("body"), stored.alias("stored_at"))
    return route.with_cache(a, cache, F.expr(NOW), 24).select("url", "tier", "from_cache", "status_code")


_PRIMARY = "SELECT concat('p', page_id) AS url, CASE WHEN page_id % 2 = 0 THEN 'fb' ELSE '' END AS fallback_url, 'http' AS tier, CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 0 ELSE 200 END AS status_code, CASE page_id % 5 WHEN 0 THEN 'http_4xx' WHEN 1 THEN 'dns_failure' ELSE 'success' END AS failure_category FROM {pages}"
_FALLBACK = "SELECT concat('p', page_id) AS url, CASE WHEN page_id % 3 = 0 THEN concat('f', page_id) END AS followed, 'chromium' AS tier, 200 AS status_code, CASE page_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'no_link' ELSE 'timeout' END AS failure_category FROM {pages}"
_OVER = f"""SELECT p.url, CASE WHEN won THEN 'chromium' ELSE tier END AS tier, CASE WHEN won THEN 200 ELSE status_code END AS status_code, CASE WHEN won THEN 'success' ELSE failure_category END AS failure_category, CASE WHEN won THEN 'fallback' ELSE 'primary' END AS discovery,
  CASE WHEN won THEN followed END AS followed_url, CASE WHEN NOT tried THEN 'not_tried' WHEN won THEN 'succeeded' WHEN f_category = 'no_link' THEN 'no_link' ELSE 'unreachable' END AS fallback_state
FROM (SELECT p.*, f.followed, f.failure_category AS f_category, p.failure_category IN ('http_4xx', 'dns_failure') AND p.fallback_url <> '' AS tried, tried AND f.failure_category = 'success' AS won FROM ({duck(_PRIMARY)}) p JOIN ({duck(_FALLBACK)}) f ON f.url = p.url) p"""


def _overlaid(spark, d):
    return route.overlay_fallback(spark_input(spark, d, _PRIMARY), spark_input(spark, d, _FALLBACK))


@register("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 0.0 ELSE round(0.25 / (page_id % 4), 6) END AS bound FROM pages")
def jitter_bounds(spark, d):
    return _pages(spark, d).select("page_id", F.round(quality.jitter_bound(F.col("page_id") % 4, F.lit(0.25)), 6).alias("bound"))


@register(f"SELECT url, tier, status_code, sha256(body) AS body FROM ({O.made(_K)}) m WHERE valid")
def cache_puts(spark, d):
    made = route.walk_ladder(route.check_attempts(spark_input(spark, d, I.KEYED_ATTEMPTS)))
    return route.cache_puts(made, F.expr(NOW)).select("url", "tier", "status_code", F.sha2(F.col("body").cast("binary"), 256).alias("body"))


@register(_OVER)
def fallback_overlay(spark, d):
    return _overlaid(spark, d).drop("fallback_url")


@register(f"SELECT count(*) FILTER (fallback_state <> 'not_tried') AS attempted, count(*) FILTER (fallback_state = 'succeeded') AS succeeded, count(*) FILTER (fallback_state = 'no_link') AS no_link, count(*) FILTER (fallback_state = 'unreachable') AS unreachable FROM ({_OVER}) o")
def stats_fallback(spark, d):
    return stats.fallbacks(_overlaid(spark, d))


# ---- statistics ----

_R = duck(I.RECORDS)
_OK = O.reachable("failure_category")


def _records(spark, d):
    return spark_input(spark, d, I.RECORDS)


@register(f"SELECT count(*) AS total, count(*) FILTER ({_OK}) AS reachable, count(*) FILTER (NOT {_OK}) AS unreachable FROM ({_R}) r")
def stats_totals(spark, d):
    return stats.totals(_records(spark, d))


@register(f"SELECT tier, count(*) AS attempted, count(*) FILTER (failure_category = 'success' AND duration_ms > 0) AS succeeded FROM ({_R}) r GROUP BY tier")
def stats_by_tier(spark, d):
    return stats.by_tier(_records(spark, d))


@register(f"SELECT failure_category AS category, count(*) AS n FROM ({_R}) r GROUP BY 1")
def stats_by_category(spark, d):
    return stats.by_category(_records(spark, d))


@register(f"SELECT tier, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) // count(*) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms FROM ({_R}) r WHERE failure_category = 'success' AND duration_ms > 0 GROUP BY tier")
def stats_latency(spark, d):
    return stats.latency(_records(spark, d))


@register(f"SELECT round(count(*) FILTER (failure_category = 'success' AND duration_ms > 0 AND tier = 'chromium') / count(*) FILTER ({_OK}), 6) AS escalation_rate FROM ({_R}) r")
def stats_escalation(spark, d):
    return stats.escalation_rate(_records(spark, d)).withColumn("escalation_rate", F.round("escalation_rate", 6))


@register(f"SELECT date_diff('millisecond', date_trunc('millisecond', min(fetched_at)), date_trunc('millisecond', max(fetched_at))) AS wall_clock_ms FROM ({_R}) r")
def stats_wall_clock(spark, d):
    return stats.wall_clock(_records(spark, d))


_HIT = "failure_category = 'success' AND duration_ms > 0"


@register(f"""SELECT count(*) AS total, count(*) FILTER ({_OK}) AS reachable, count(*) FILTER (NOT {_OK}) AS unreachable, round(count(*) FILTER ({_HIT} AND tier = 'chromium') / count(*) FILTER ({_OK}), 6) AS escalation_rate,
  (SELECT string_agg(concat(tier, '=', n), ';' ORDER BY tier) FROM (SELECT tier, count(*) AS n FROM ({_R}) a GROUP BY tier) b) AS tier_attempted, (SELECT string_agg(concat(tier, '=', n), ';' ORDER BY tier) FROM (SELECT tier, count(*) AS n FROM ({_R}) a WHERE {_HIT} GROUP BY tier) b) AS tier_succeeded,
  (SELECT string_agg(concat(failure_category, '=', n), ';' ORDER BY failure_category) FROM (SELECT failure_category, count(*) AS n FROM ({_R}) a GROUP BY 1) b) AS failures,
  (SELECT string_agg(concat(tier, '=', n, ',', avg_ms, ',', lo, ',', hi), ';' ORDER BY tier) FROM (SELECT tier, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) // count(*) AS avg_ms, min(duration_ms) AS lo, max(duration_ms) AS hi FROM ({_R}) a WHERE {_HIT} GROUP BY tier) b) AS latency FROM ({_R}) r""")
def stats_snapshot(spark, d):
    flat = lambda c, value: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), ";")
    number = lambda v: v.cast("string")
    return stats.snapshot(_records(spark, d)).select(
        "total", "reachable", "unreachable", F.round("escalation_rate", 6).alias("escalation_rate"), flat("tier_attempted", number).alias("tier_attempted"), flat("tier_succeeded", number).alias("tier_succeeded"),
        flat("failures_by_category", number).alias("failures"), flat("latency", lambda v: F.concat_ws(",", v["hits"], v["avg_ms"], v["min_ms"], v["max_ms"])).alias("latency"),
    )


@register(f"SELECT date_trunc('hour', ts) AS hour, tier, category, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM ({_LOG}) l GROUP BY 1, 2, 3")
def fetch_events_hourly(spark, d):
    log = spark_input(spark, d, I.FETCH_LOG)
    g = log.groupBy(F.window("ts", "1 hour").alias("w"), "tier", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms"))
    return g.select(F.col("w.start").alias("hour"), "tier", "category", "n", "total_ms")


# ---- streams: all of a table's files as a stream, to the end ----


def _stream(spark, d, table, sql):
    """sql over one table, a file or a folder of files, read as a stream.

    The path is a pattern that only the table matches: a stream takes a lone file by no other."""
    batch = spark.read.parquet(f"{d}/{table}.parquet")
    rows = spark.readStream.schema(batch.schema).parquet(f"{d}/{{{table}}}.parquet")
    return spark.sql(sql, **{table: rows})


def _to_end(spark, stream, mode):
    return jobs.run_to_end(stream, mode, f"{crawl.shared_folder(spark)}/pagequarry-stream-{uuid.uuid4().hex}")


@register(f"SELECT tier, category, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM ({_LOG}) l GROUP BY 1, 2")
def stream_live_stats(spark, d):
    return _to_end(spark, jobs.live_stats(_stream(spark, d, "events", I.FETCH_LOG)), "complete")


@register(_SQL["tier_learning"])
def stream_tier_learning(spark, d):
    return _to_end(spark, jobs.learn_tiers(_stream(spark, d, "events", I.FETCH_LOG)), "complete").select("host", "tier")


@register(f"SELECT DISTINCT {_C} AS canonical_url FROM pages WHERE {_C} IS NOT NULL")
def stream_dedup_queue(spark, d):
    return _to_end(spark, jobs.dedup_queue(_stream(spark, d, "pages", "SELECT page_id, url FROM {pages}")), "append").select("canonical_url")


@register(_SQL["frontier_states"])
def stream_state_machine(spark, d):
    out = _to_end(spark, jobs.state_machine(_stream(spark, d, "events", I.OPS)), "update")
    last = out.groupBy("url").agg(F.max_by(F.struct("state", "attempts", "last_tier", "last_error"), "version").alias("r"))
    return last.select("url", "r.*")


# ---- politeness ----


@register(f"""SELECT h.host, arg_min(rule_idx, rule_idx) AS rule_idx, coalesce(arg_min(rate, rule_idx), 1.0) AS rate, coalesce(arg_min(concurrency, rule_idx), 4) AS concurrency
FROM (SELECT DISTINCT {O.host("url")} AS host FROM pages) h LEFT JOIN ({duck(I.HOST_RULES)}) r ON CASE WHEN r.match[1] = '*' THEN ends_with(h.host, lower(substr(r.match, 2))) AND length(h.host) > length(r.match) - 1 ELSE h.host = lower(r.match) END GROUP BY h.host""")
def host_rule_match(spark, d):
    hosts = _pages(spark, d).select(urls.url_host("url").alias("host"))
    return politeness.host_rules(hosts, spark_input(spark, d, I.HOST_RULES)).select("host", "rule_idx", "rate", "concurrency")


_ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /de/ # german\nAllow: /de/6\nDisallow: fr/1\nDisallow: /*.html$\nAllow: /en/4*.html\nDisallow: /es/*5/*\nDisallow: /en/7\nAllow: /en/7\nSitemap: https://x.org/sitemap.xml\n"


# a pattern is longer than the plain rules here; of equal rules the first counts
_BARRED = """CASE WHEN regexp_matches(p, '^/en/4.*[.]html') THEN false WHEN regexp_matches(p, '[.]html$') THEN true WHEN regexp_matches(p, '/es/.*5/') THEN true
  WHEN starts_with(p, '/de/6') THEN false ELSE starts_with(p, '/de/') OR starts_with(p, '/fr/1') OR starts_with(p, '/en/7') END"""


@register(f"SELECT page_id, NOT ({_BARRED}) OR ends_with(h, '.com') AS allowed FROM (SELECT page_id, {O.host('url')} AS h, {O.part('url', 3)} AS p FROM pages) q")
def robots_filter(spark, d):
    p = _pages(spark, d).select("page_id", "url", urls.url_host("url").alias("host"))
    files = p.select("host").distinct().select("host", F.when(F.col("host").endswith(".com"), 404).otherwise(200).alias("status"), F.lit(_ROBOTS).alias("body"))
    checked = politeness.robots_allowed(p.select("url", "host").distinct(), politeness.parse_robots(files))
    return p.join(checked.select("url", "allowed"), "url").select("page_id", "allowed")


@register(f"SELECT DISTINCT {O.host('url')} AS host, 0 AS pos, concat('https://', {O.host('url')}, '/sitemap.xml') AS sitemap FROM pages")
def robots_sitemaps(spark, d):
    hosts = _pages(spark, d).select(urls.url_host("url").alias("host")).distinct()
    files = hosts.withColumn("body", F.concat(F.lit("User-agent: *\nsitemap: https://"), "host", F.lit("/sitemap.xml \n")))
    return politeness.sitemap_directives(files).select("host", "pos", F.col("url").alias("sitemap"))


@register(f"SELECT page_id, round(greatest(row_number() OVER (PARTITION BY h ORDER BY page_id) - 2, 0) / 0.5, 6) AS start_s FROM (SELECT page_id, {O.host('url')} AS h FROM pages) p")
def pacing_schedule(spark, d):
    q = _pages(spark, d).select(urls.url_host("url").alias("host"), F.col("page_id").alias("seq"))
    return politeness.pacing(q, F.lit(0.5), 2).select(F.col("seq").alias("page_id"), F.round("start_s", 6).alias("start_s"))


# ---- documents ----


_TITLE = O.unescape("trim(regexp_extract(html, '<title>([^<]*)</title>', 1))")
_HEAD = O.unescape("trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1))")


@register(f"SELECT page_id, {_TITLE} AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS language FROM pages")
def page_title(spark, d):
    p = _pages(spark, d).withColumn("m", page_metadata("html", "url"))
    return p.select("page_id", "m.title", "m.language")


_H1 = [parse_field_spec(s) for s in ("h1=article > h1", "ad=div.ad", "paragraphs=article p[]", "href=nav a:first-child@href", "missing=#nothing")]


@register(f"""SELECT page_id, {_HEAD} AS h1, trim(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1)) AS ad, len(regexp_extract_all(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>')) AS n_paragraphs, regexp_extract(html, '<nav><ul><li><a href="([^"]*)"', 1) AS href, 4 AS hits FROM pages""")
def page_fields(spark, d):
    p = _pages(spark, d).withColumn("x", parse_page("html", "url", css=_H1)["css"])
    hits = sum(F.when(F.col(f"x.{f.name}").isNotNull(), 1).otherwise(0) for f in _H1)
    return p.select("page_id", "x.h1", "x.ad", F.size("x.paragraphs").cast("long").alias("n_paragraphs"), "x.href", hits.alias("hits"))


_ENC = "replace(replace(replace(replace(replace(url_encode(x), '%2F', '/'), '%2C', ','), '%3A', ':'), '%21', '!'), '%27', '''')"
_ABS = f"list_transform({O.links('html')}, lambda x: concat(regexp_extract(url, '^([^/]*//[^/?#]*)', 1), {_ENC}))"


@register(f"SELECT page_id, array_to_string(list_distinct_keep, ' ') AS links FROM (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_keep FROM (SELECT page_id, {_ABS} AS l FROM pages) p) q")
def page_links(spark, d):
    return _pages(spark, d).select("page_id", F.array_join(parse_page("html", "url", links=True, same_domain=True)["links"], " ").alias("links"))


@register(f"SELECT page_id, {_ABS}[1] AS first_link FROM pages")
def first_link(spark, d):
    return _pages(spark, d).select("page_id", parse_page("html", "url", first='nav a[href^="/"]', same_domain=True)["first"].alias("first_link"))


@register(f"SELECT src, dst, CAST(ord - 1 AS INTEGER) AS ord FROM (SELECT url AS src, unnest(l) AS dst, generate_subscripts(l, 1) AS ord FROM (SELECT url, list_filter(m, lambda x, i: list_position(m, x) = i) AS l FROM (SELECT url, {_ABS} AS m FROM pages) o) p) q")
def link_edges(spark, d):
    return _pages(spark, d).select(F.col("url").alias("src"), F.posexplode(parse_page("html", "url", links=True)["links"]).alias("ord", "dst")).select("src", "dst", "ord")


@register(f"SELECT page_id, h = w OR ends_with(h, concat('.', w)) OR ends_with(w, concat('.', h)) AS same FROM (SELECT page_id, {O.host('url')} AS h, CASE page_id % 3 WHEN 0 THEN 'example.org' WHEN 1 THEN concat('a.', {O.host('url')}) ELSE 'ample.org' END AS w FROM pages) p")
def same_domain_pairs(spark, d):
    h = urls.url_host("url")
    w = F.when(F.col("page_id") % 3 == 0, "example.org").when(F.col("page_id") % 3 == 1, F.concat(F.lit("a."), h)).otherwise("ample.org")
    return _pages(spark, d).select("page_id", urls.same_domain(h, w).alias("same"))


_SCHEMA = parse_schema({
    "version": 2,
    "fields": {
        "heading": {"selector": [".missing", "h2", "article > h1"], "transforms": [{"type": "trim"}, {"type": "lowercase"}]},
        "host": {"selector": "footer", "transforms": [{"type": "regex", "pattern": "([a-z]+[.][a-z]+[.]example[.][a-z]+)"}]},
        "words": {"selector": "h1", "transforms": [{"type": "split", "separator": " "}]},
        "nav": {"selector": "nav li", "multiple": True, "fields": {"label": {"selector": "a"}, "href": {"selector": "a", "attr": "href"}, "self": {"selector": ""}}},
    },
})


def _extracted(spark, d):
    return _pages(spark, d).withColumn("s", parse_page("html", "url", schema=_SCHEMA)["schema"])


@register(f"SELECT page_id, lower({_HEAD}) AS heading FROM pages")
def fallback_selector(spark, d):
    return _extracted(spark, d).select("page_id", "s.heading")


@register(f"""SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n_nav, regexp_extract(html, '<li><a href="([^"]*)"', 1) AS href, regexp_extract(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS label, array_to_string(string_split({_HEAD}, ' '), '|') AS words FROM pages""")
def schema_extract(spark, d):
    return _extracted(spark, d).select("page_id", F.size("s.nav").cast("long").alias("n_nav"), F.col("s.nav")[0]["href"].alias("href"), F.col("s.nav")[0]["label"].alias("label"), F.array_join("s.words", "|").alias("words"))


_STEPS = [text.Transform("trim"), text.Transform("lowercase"), text.Transform("regex", "^([a-zà-ÿ]+) ")]


@register("SELECT page_id, CASE WHEN regexp_matches(t, '^([a-zà-ÿ]+) ') THEN regexp_extract(t, '^([a-zà-ÿ]+) ', 1) ELSE t END AS first_word, len(string_split(t, '. ')) AS n_parts FROM (SELECT page_id, lower(" + O.trim("regexp_extract(html, '<h1>([^<]*)</h1>', 1)") + ") AS t FROM pages) p")
def transform_pipeline(spark, d):
    h = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    return _pages(spark, d).select("page_id", text.apply_transforms(h, _STEPS).alias("first_word"), F.size(text.apply_transforms(h, [*_STEPS[:2], text.Transform("split", separator=". ")])).cast("long").alias("n_parts"))


@register("SELECT page_id, concat('flat ', page_id) AS a, concat('nested ', page_id) AS b, page_id AS c FROM pages")
def field_merge(spark, d):
    p = _pages(spark, d).select("page_id", F.struct(F.concat(F.lit("flat "), "page_id").alias("a"), F.lit("lost").alias("b")).alias("flat"), F.struct(F.concat(F.lit("nested "), "page_id").alias("b"), F.col("page_id").alias("c")).alias("nested"))
    return merge_fields(p, "flat", "nested").select("page_id", "extracted.*")


_PUB = "CASE page_id % 6 WHEN 0 THEN '2024-03-01T10:00:00Z' WHEN 1 THEN '2023-07-09' WHEN 2 THEN '2022-01-02 03:04:05' WHEN 3 THEN 'garbage' WHEN 4 THEN '2024-03-01T10:00:00+02:00' ELSE 'Fri, 15 Mar 2024 10:00:00 GMT' END"


@register(f"SELECT page_id, CASE page_id % 6 WHEN 0 THEN TIMESTAMP '2024-03-01 10:00:00' WHEN 1 THEN TIMESTAMP '2023-07-09 00:00:00' WHEN 2 THEN TIMESTAMP '2022-01-02 03:04:05' WHEN 4 THEN TIMESTAMP '2024-03-01 08:00:00' WHEN 5 THEN TIMESTAMP '2024-03-15 10:00:00' END AS published_at FROM pages")
def published_at(spark, d):
    return _pages(spark, d).select("page_id", text.published_at(F.expr(_PUB)).alias("published_at"))


_META = duck(I.META_PAGES)


def _pairs(column):
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@register(f"""SELECT page_id, concat('OG ', page_id) AS title, CASE WHEN page_id % 3 = 0 THEN 'From og' ELSE concat('About ', page_id) END AS description, concat(regexp_extract(url, '^([^/]*//[^/?#]*)', 1), '/c/', page_id) AS canonical,
  CASE page_id % 4 WHEN 0 THEN TIMESTAMP '2024-03-01 10:00:00' WHEN 1 THEN TIMESTAMP '2023-07-09 00:00:00' WHEN 2 THEN TIMESTAMP '2022-01-02 03:04:05' END AS published_at, concat('{{"@id":', page_id, '}}') AS json_ld, CASE WHEN page_id % 3 = 0 THEN 'description=From og;title=Later' ELSE 'title=Later' END AS og, concat('card=c', page_id % 3) AS twitter FROM pages""".replace("{{", "{").replace("}}", "}"))
def page_meta(spark, d):
    p = spark_input(spark, d, I.META_PAGES).withColumn("m", page_metadata("html", "url"))
    return p.select("page_id", "m.title", "m.description", "m.canonical", "m.published_at", F.array_join("m.json_ld", "\n").alias("json_ld"), _pairs("m.open_graph").alias("og"), _pairs("m.twitter").alias("twitter"))


@register()
def markdown_body(spark, d):
    return _pages(spark, d).select("page_id", parse_page("html", "url", markdown=True)["markdown"].alias("markdown"))


@register()
def readable_body(spark, d):
    return _pages(spark, d).select("page_id", parse_page("html", "url", readable=True)["readable"].alias("readable"))


# the row that counts: the winner, else the last answer
_REC = f"""SELECT o.url, o.valid, o.tier, o.error, coalesce(arg_max(m.status_code, m.ord) FILTER (WHERE coalesce(m.error, '') = ''), 0) AS status_code, arg_max(m.body, m.ord) FILTER (WHERE coalesce(m.error, '') = '') AS body,
  arg_max(m.content_type, m.ord) FILTER (WHERE coalesce(m.error, '') = '') AS content_type, arg_min(m.tier, m.ord) FILTER (WHERE starts_with(m.reason, 'soft block')) AS walled
FROM ({_OUT}) o JOIN ({O.made(_K)}) m ON m.url = o.url GROUP BY o.url, o.valid, o.tier, o.error"""
_PAGE = f"valid AND {O.html('content_type')}"
_TEXT = lambda tag: O.unescape(f"trim(regexp_extract(body, '<{tag}>([^<]*)</{tag}>', 1))")


@register(f"""SELECT url, url AS canonical_url, tier, status_code, CASE WHEN body IS NOT NULL THEN concat('sha256:', sha256(body)) END AS content_hash, CAST(strlen(body) AS INTEGER) AS body_bytes, CASE WHEN body IS NOT NULL THEN url END AS final_url,
  CASE WHEN valid THEN sha256(body) END AS body, CASE WHEN valid THEN 'html' END AS body_format, CASE WHEN {_PAGE} THEN nullif({_TEXT("h1")}, '') END AS h1, CASE WHEN {_PAGE} THEN {_TEXT("title")} END AS title,
  CASE WHEN valid THEN CASE WHEN {_PAGE} AND {_TEXT("h1")} <> '' THEN 1 ELSE 0 END END AS hits, walled, error, CASE WHEN valid THEN 'success' ELSE {O.classify('error', chr(39) * 2, 'status_code')} END AS failure_category FROM ({_REC}) r""")
def record_build(spark, d):
    built = records.build(_outcomes(spark, d), F.expr(NOW), css=[parse_field_spec("h1=article > h1"), parse_field_spec("none=.nothing")], body_format="html")
    m = "metadata."
    return built.select(
        "url", "canonical_url", "tier", "status_code", "content_hash", m + "body_bytes", m + "final_url", F.sha2(F.col("body").cast("binary"), 256).alias("body"), "body_format",
        "extracted.h1", m + "page.title", m + "extraction.hits", F.get(m + "soft_block.tiers", F.lit(0)).alias("walled"), "error", "failure_category",
    )


@register("""SELECT page_id, concat('url=', url, ';n=', page_id, CASE WHEN page_id % 2 = 0 THEN ';empty=' ELSE '' END) AS line FROM pages""")
def jsonl_file(spark, d):
    """Records written as JSON lines and read again: what is null isn't there, what is empty is."""
    rows = _pages(spark, d).select("page_id", F.struct("url", F.col("page_id").alias("n"), F.when(F.col("page_id") % 2 == 0, F.lit("")).alias("empty")).alias("r"))
    path = f"{crawl.shared_folder(spark)}/pagequarry-sink-{uuid.uuid4().hex}/records.jsonl"
    records.write(rows.select("r.*"), path)
    text = spark.read.text(path)
    has = lambda k: text["value"].contains(f'"{k}":')
    get = lambda k: F.get_json_object("value", f"$.{k}")
    line = F.concat(F.lit("url="), get("url"), F.lit(";n="), get("n"), F.when(has("empty"), F.concat(F.lit(";empty="), get("empty"))).otherwise(F.lit("")))
    return text.select(get("n").cast("long").alias("page_id"), line.alias("line"))


# ---- crawl, maps, sitemaps ----

_GRAPH = duck(I.PAGE_GRAPH)


def _graph(spark, d):
    g = spark_input(spark, d, I.PAGE_GRAPH)
    return g.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("ord"))


@register(f"""WITH RECURSIVE g AS ({_GRAPH}), b AS (SELECT CAST(0 AS BIGINT) AS url, 0 AS depth UNION SELECT g.dst, b.depth + 1 FROM b JOIN g ON g.src = b.url WHERE b.depth < 4) SELECT CAST(url AS VARCHAR) AS url, min(depth) AS depth FROM b GROUP BY url""")
def crawl_bfs(spark, d):
    return crawl.crawl(spark.createDataFrame([("0",)], "url string"), _graph(spark, d), 4, 0).select("url", "depth")


@register("SELECT CAST(page_id AS VARCHAR) AS url, page_id AS rank FROM pages WHERE page_id < 20")
def crawl_limit(spark, d):
    return crawl.crawl(spark.createDataFrame([("0",)], "url string"), _graph(spark, d), 10, 20).select("url", "rank")


@register("SELECT concat('u', page_id) AS url, CASE WHEN page_id % 2 = 0 THEN 'sitemap' ELSE 'crawl' END AS source FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0")
def map_union(spark, d):
    p = _pages(spark, d).select(F.concat(F.lit("u"), "page_id").alias("url"), F.col("page_id").alias("pos"))
    return crawl.map_union(p.where("pos % 2 = 0"), p.where("pos % 3 = 0")).select("url", "source")


@register("SELECT * FROM (VALUES ('https://x.org/1', 0), ('https://x.org/2', 1), ('https://x.org/3', 2)) v(url, pos)")
def sitemap_walk(spark, d):
    docs = spark_input(spark, d, I.SITEMAPS)
    pages, _ = crawl.walk_sitemaps(docs, spark.createDataFrame([("https://x.org/sitemap.xml", 0)], "url string, pos long"))
    return pages.select("url", F.col("pos").cast("int").alias("pos"))


_WALKED = "SELECT * FROM (VALUES ('https://x.org/sitemap.xml', 0, 0, 3, {t}), ('https://x.org/a.xml', 1, 2, 0, {t}), ('https://x.org/b.xml', 1, 2, 0, {t})) v(url, depth, urlset_count, index_count, truncated)"


@register(_WALKED.format(t="true"))
def sitemap_truncated(spark, d):
    docs = spark_input(spark, d, I.SITEMAPS)
    return crawl.walk_sitemaps(docs, spark.createDataFrame([("https://x.org/sitemap.xml", 0)], "url string, pos long"), max_urls=2)[1]


@register(_WALKED.format(t="false"))
def sitemap_sources(spark, d):
    docs = spark_input(spark, d, I.SITEMAPS)
    return crawl.walk_sitemaps(docs, spark.createDataFrame([("https://x.org/sitemap.xml", 0)], "url string, pos long"))[1]


@register("SELECT concat('u', page_id) AS url, 'sitemap' AS source FROM pages WHERE page_id % 2 = 0 AND page_id < 20")
def map_limit(spark, d):
    p = _pages(spark, d).select(F.concat(F.lit("u"), "page_id").alias("url"), F.col("page_id").alias("pos"))
    return crawl.map_union(p.where("pos % 2 = 0"), p.where("pos % 3 = 0"), 10).select("url", "source")


@register("SELECT concat('u', page_id) AS url, 'crawl' AS source FROM pages WHERE page_id % 3 = 0")
def map_sources(spark, d):
    p = _pages(spark, d).select(F.concat(F.lit("u"), "page_id").alias("url"), F.col("page_id").alias("pos"))
    return crawl.map_union(p.where("pos % 2 = 0"), p.where("pos % 3 = 0"), 0, "crawl").select("url", "source")


# ---- sinks ----


def _flat_records(spark, d):
    p = _pages(spark, d)
    return p.select("url", F.concat("url", F.lit("#c")).alias("canonical_url"), F.lit("http").alias("tier"), F.lit(200).alias("status_code"), F.col("page_id").alias("duration_ms"), F.lit("success").alias("failure_category"), F.lit(None).cast("string").alias("error"), F.struct(F.array(F.lit("a"), F.lit("b")).alias("tags"), (F.col("page_id") / 2).alias("price")).alias("extracted"), F.struct(F.lit("text/html").alias("content_type")).alias("metadata"), "page_id")


@register("""SELECT url, concat(url, '#c') AS canonical_url, 'http' AS tier, '200' AS status_code, CAST(page_id AS VARCHAR) AS duration_ms, '' AS content_type, 'success' AS failure_category, '' AS error, CASE WHEN page_id % 2 = 0 THEN CAST(page_id // 2 AS VARCHAR) ELSE concat(page_id // 2, '.5') END AS "extracted.price", '["a","b"]' AS "extracted.tags" FROM pages""")
def csv_flatten(spark, d):
    return records.flatten(_flat_records(spark, d))


@register("SELECT 'text/html' AS \"metadata.content_type\", url FROM pages")
def csv_columns(spark, d):
    return records.flatten(_flat_records(spark, d), ["metadata.content_type", "url"])


@register("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('k', page_id % 3) END AS dropped FROM pages")
def csv_dropped_keys(spark, d):
    r = _pages(spark, d).select("page_id", F.map_from_entries(F.array_distinct(F.array(F.struct(F.lit("k0").alias("k"), F.lit("x").alias("v")), F.struct(F.concat(F.lit("k"), (F.col("page_id") % 3).cast("string")).alias("k"), F.lit("x").alias("v"))))).alias("extracted"))
    return records.dropped_keys(r, records.locked_keys(r, "page_id")).select("page_id", F.array_join("dropped", ",").alias("dropped"))


@register("""SELECT page_id, concat('{"url":"', url, '","tier":"http","n":', page_id, CASE WHEN page_id % 2 = 0 THEN ',"empty":""' ELSE '' END, '}') AS line FROM pages""")
def jsonl_record(spark, d):
    r = _pages(spark, d).select("page_id", "url", F.lit("http").alias("tier"), F.col("page_id").alias("n"), F.when(F.col("page_id") % 2 == 0, F.lit("")).alias("empty"))
    return r.select("page_id", F.to_json(F.struct("url", "tier", "n", "empty")).alias("line"))


# ---- PDF text ----

_PDF = duck(I.PDF_TEXTS)
_STUB = lambda c: f"({c} IS NULL OR strlen({O.trim(f'replace({c}, chr(12), {chr(39) * 2})')}) < 16)"


@register(f"""SELECT doc_id, CASE WHEN NOT {_STUB("plain")} THEN 'pdftotext' WHEN NOT {_STUB("layout")} THEN 'pdftotext-layout' WHEN NOT {_STUB("ocr")} THEN 'tesseract' ELSE '' END AS tier,
  strlen(replace(CASE WHEN NOT {_STUB("plain")} THEN plain WHEN NOT {_STUB("layout")} THEN layout WHEN NOT {_STUB("ocr")} THEN ocr END, chr(12), concat(chr(10), chr(10)))) AS n_bytes,
  CASE WHEN {_STUB("plain")} AND {_STUB("layout")} AND {_STUB("ocr")} THEN 'extraction_failed' ELSE 'success' END AS category FROM ({_PDF}) p""")
def pdf_ladder(spark, d):
    p = spark_input(spark, d, I.PDF_TEXTS).withColumn("x", pdftext.extract("plain", "layout", "ocr"))
    return p.select("doc_id", "x.tier", F.octet_length("x.text").cast("long").alias("n_bytes"), "x.category")


@register(f"SELECT doc_id, CAST(i AS INTEGER) AS number, sha256(p[i]) AS page FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(plain, '\\x0c+$', ''), chr(12)) AS p FROM ({_PDF}) t) u) v")
def pdf_pages(spark, d):
    p = spark_input(spark, d, I.PDF_TEXTS).select("doc_id", F.explode(pdftext.pages_of("plain")).alias("p"))
    return p.select("doc_id", "p.number", F.sha2(F.col("p.text").cast("binary"), 256).alias("page"))


@register("SELECT conv_id, sha256(string_agg(text, chr(12) ORDER BY turn)) AS stitched FROM conversations GROUP BY conv_id")
def pdf_stitch(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    g = c.groupBy("conv_id").agg(F.collect_list(F.struct(F.concat(F.lit("page-"), "turn", F.lit(".png")).alias("name"), "text")).alias("pages"))  # the pages of one file
    return g.select("conv_id", F.sha2(pdftext.stitch(F.col("pages")).cast("binary"), 256).alias("stitched"))


_BENCH = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'extraction_failed' ELSE 'success' END AS outcome_no_ocr, CASE WHEN doc_id % 10 = 0 THEN 'extraction_failed' ELSE 'success' END AS outcome_ocr FROM {documents}"


@register(f"SELECT count(*) FILTER (outcome_no_ocr = 'success') AS success_no_ocr, count(*) FILTER (outcome_ocr = 'success') AS success_ocr, count(*) FILTER (outcome_no_ocr <> 'success' AND outcome_ocr = 'success') AS ocr_rescued FROM ({duck(_BENCH)}) b")
def pdf_bench(spark, d):
    return stats.pdf_bench(spark_input(spark, d, _BENCH))


_RUNS = "SELECT doc_id, concat('d', doc_id) AS url, CASE WHEN doc_id % 5 = {m} THEN 'extraction_failed' ELSE 'success' END AS outcome, CASE WHEN doc_id % 3 = 0 THEN 'tesseract' ELSE 'pdftotext' END AS tier FROM {{documents}} WHERE doc_id % 7 <> {m}"
_RUN_A, _RUN_B = _RUNS.format(m=0).replace("{{", "{").replace("}}", "}"), _RUNS.format(m=1).replace("{{", "{").replace("}}", "}")


@register(f"SELECT url, a.outcome AS outcome_no_ocr, a.tier AS tier_no_ocr, b.outcome AS outcome_ocr, b.tier AS tier_ocr FROM ({duck(_RUN_A)}) a FULL JOIN ({duck(_RUN_B)}) b USING (url)")
def pdf_cross_reference(spark, d):
    return stats.cross_reference(spark_input(spark, d, _RUN_A), spark_input(spark, d, _RUN_B))


_TRIES = """SELECT concat('p', page_id) AS url, 'http' AS tier, 0 AS ord, CAST(i AS INTEGER) AS try_no, CASE (page_id + i) % 6 WHEN 0 THEN 200 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 500 WHEN 4 THEN 429 ELSE 0 END AS status_code,
  CASE WHEN (page_id + i) % 6 = 5 THEN 'read tcp: connection reset by peer' END AS error FROM {pages}, (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n"""
_AGAIN = "status_code IN (429, 502, 503, 504) OR coalesce(error, '') <> ''"


@register(f"""SELECT url, status_code, try_no + 1 AS n_tries FROM (SELECT *, coalesce(min(CASE WHEN NOT ({_AGAIN}) THEN try_no END) OVER w, max(try_no) OVER w) AS stop FROM ({duck(_TRIES)}) t WHERE try_no <= 2 WINDOW w AS (PARTITION BY url)) q WHERE try_no = stop""")
def retry_loop(spark, d):
    return route.collapse_retries(spark_input(spark, d, _TRIES)).select("url", "status_code", "n_tries")


@register(f"""SELECT url, status_code, try_no AS rotated FROM (SELECT *, coalesce(min(CASE WHEN status_code NOT IN (429, 404) THEN try_no END) OVER w, max(try_no) OVER w) AS stop FROM ({duck(_TRIES)}) t WHERE try_no <= 1 WINDOW w AS (PARTITION BY url)) q WHERE try_no = stop""")
def proxy_rotation(spark, d):
    return route.rotate_proxies(spark_input(spark, d, _TRIES), [429, 404], 1).select("url", "status_code", "rotated")


@register(f"SELECT page_id AS seq, concat('https://p', page_id * 2, '.example.org/') AS url, f.state, f.state IS NULL AS dangling FROM pages LEFT JOIN ({duck(I.FRONTIER)}) f ON f.url = concat('https://p', page_id * 2, '.example.org/')")
def queue_pointers(spark, d):
    p = _pages(spark, d).select(F.col("page_id").alias("seq"), F.concat(F.lit("https://p"), F.col("page_id") * 2, F.lit(".example.org/")).alias("url"))
    return frontier.resolve_pointers(p, spark_input(spark, d, I.FRONTIER)).select("seq", "url", "state", "dangling")


@register(f"""SELECT url, CASE WHEN tier <> '' THEN 'text/markdown' ELSE 'application/pdf' END AS content_type, CASE WHEN tier <> '' THEN 'success' WHEN doc_id % 35 = 0 THEN 'pdf_tooling_missing' ELSE 'extraction_failed' END AS failure_category, tier AS extractor_tier, CASE WHEN tier <> '' THEN concat('Title ', doc_id) END AS title
FROM (SELECT doc_id, concat('d', doc_id) AS url, CASE WHEN doc_id % 35 = 0 THEN '' WHEN NOT {_STUB("plain")} THEN 'pdftotext' WHEN NOT {_STUB("layout")} THEN 'pdftotext-layout' ELSE '' END AS tier FROM ({_PDF}) p) q""")
def pdf_records(spark, d):
    t = spark_input(spark, d, I.PDF_TEXTS)
    gone = F.col("doc_id") % 35 == 0
    texts = t.select(F.concat(F.lit("d"), "doc_id").alias("url"), *[F.when(~gone, F.col(c)).alias(c) for c in ("plain", "layout", "ocr")], F.concat(F.lit("Title: Title "), "doc_id", F.lit("\nPages: 3\n")).alias("info"))
    outs = t.select(F.concat(F.lit("d"), "doc_id").alias("url"), F.lit(True).alias("valid"), F.lit("application/pdf").alias("content_type"), F.lit("%PDF-").alias("body"), F.lit(None).cast("string").alias("error"), F.lit("success").alias("failure_category"))
    r = records.apply_pdf(outs, texts)
    return r.select("url", "content_type", "failure_category", F.coalesce("pdf.extractor_tier", F.lit("")).alias("extractor_tier"), "title")


@register(f"SELECT page_id, tier, missed IS NULL AS complete FROM (SELECT page_id, tier, CASE WHEN NOT contains(body, '<h1>') THEN 'h1' WHEN NOT contains(body, '<nav>') THEN 'nav' END AS missed FROM ({_A}) a) m")
def required_selectors(spark, d):
    a = spark_input(spark, d, I.ATTEMPTS)
    return a.select("page_id", "tier", parse_page("body", "url", required=["h1", "nav"])["missed"].isNull().alias("complete"))
