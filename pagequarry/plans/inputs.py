"""Inputs derived from the driver's tables, in SQL that Spark and DuckDB both read.

``{pages}`` and the like stand for the tables: Spark gets frames for them, the oracle their names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "events", "pages", "orders", "customer", "nation", "region", "supplier", "part", "lineitem", "conversations", "labels", "benchmark")

ATTEMPTS = """SELECT page_id, url, 'http' AS tier, 0 AS ord,
  CASE page_id % 20 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 429 WHEN 3 THEN 0 WHEN 4 THEN 403 WHEN 5 THEN 301 WHEN 6 THEN 600 ELSE 200 END AS status_code,
  CASE page_id % 17 WHEN 5 THEN 'application/json' WHEN 6 THEN 'Image/PNG' WHEN 7 THEN '' WHEN 8 THEN 'application/pdf' WHEN 9 THEN 'application/x-pdf' WHEN 10 THEN 'image/svg+xml'
    WHEN 11 THEN 'application/ld+json' WHEN 12 THEN 'Application/XHTML+xml' WHEN 13 THEN 'TEXT/XML' WHEN 14 THEN 'text/plain' ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE page_id % 13
    WHEN 7 THEN concat('<html><body><div id="root"></div><!--', repeat('x', 600), '--></body></html>')
    WHEN 8 THEN concat('<html><head><title>Please wait</title></head><body class="cf-chl">', repeat('x', 600), '</body></html>')
    WHEN 9 THEN '<html>tiny</html>'
    WHEN 10 THEN concat('<html><h1>Access Denied</h1>', repeat('x', 600), '</html>')
    WHEN 11 THEN concat('<html><body><main id="app"> <!-- soon > --> </main><!--', repeat('x', 600), '--></body></html>')
    WHEN 12 THEN concat('<html><body><div id="Root"></div><p>', repeat('x', 600), '</p></body></html>')
    ELSE html END AS body,
  CASE page_id % 120 WHEN 3 THEN 'dial tcp: lookup x: no such host' WHEN 23 THEN 'connect: connection refused' WHEN 43 THEN 'x509: certificate has expired'
    WHEN 63 THEN 'x509: certificate is valid for *.wpengine.com' WHEN 83 THEN 'context deadline exceeded' WHEN 103 THEN 'something weird happened' END AS error,
  CAST(length(html) % 900 + 50 AS BIGINT) AS duration_ms
FROM {pages}
UNION ALL
SELECT page_id, url, 'chromium', 1,
  CASE WHEN page_id % 20 = 3 AND page_id % 120 <> 103 THEN 0 WHEN page_id % 40 = 1 THEN 503 ELSE 200 END, 'text/html',
  CASE WHEN page_id % 26 = 8 THEN concat('<html><title>Just a moment...</title>', repeat('x', 600), '</html>') ELSE html END,
  CASE WHEN page_id % 20 = 3 AND page_id % 120 <> 103 THEN 'chromium fetch: page load error' END,
  CAST(length(html) % 900 + 2050 AS BIGINT)
FROM {pages}"""

#: Attempts whose url is unique, so that they can be grouped by it.
KEYED_ATTEMPTS = f"SELECT concat('https://p', page_id, '.example.org/x') AS url, page_id, tier, ord, status_code, content_type, body, error, duration_ms FROM ({ATTEMPTS}) a"

FETCH_LOG = """SELECT event_id, ts, concat('h', user_id) AS host, CASE WHEN event_id % 8 = 0 THEN 'chromium' ELSE 'http' END AS tier,
  CASE event_type WHEN 'purchase' THEN 'extraction_failed' WHEN 'error' THEN 'http_4xx' ELSE 'success' END AS category, CAST(floor(value * 10) AS BIGINT) AS duration_ms
FROM {events}"""

RECORDS = f"SELECT event_id, ts AS fetched_at, host AS url, tier, duration_ms, category AS failure_category FROM ({FETCH_LOG}) f"

SEEDS = """SELECT page_id AS pos, url, CASE WHEN page_id % 3 = 0 THEN concat('https://fb.example.org/', page_id) ELSE '' END AS fallback FROM {pages}
UNION ALL SELECT page_id + 1000000, concat(regexp_extract(url, '^([^#]*)', 1), CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'utm_source=x'), '' FROM {pages} WHERE page_id % 5 = 0
UNION ALL SELECT page_id + 2000000, 'not-a-url', '' FROM {pages} WHERE page_id % 25 = 7"""

#: Operations on a queue: every event is one, its URL the user's.
OPS = """SELECT concat('https://u', user_id, '.example.net/') AS url, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'next' WHEN 'click' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'recover' END AS op,
  CASE WHEN event_id % 8 = 0 THEN 'chromium' ELSE 'http' END AS tier, CASE WHEN event_type = 'error' THEN concat('e', event_id % 7) END AS err, ts, event_id AS n
FROM {events}"""

FRONTIER = """SELECT concat('https://p', page_id, '.example.org/') AS url, CASE page_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'in_flight' WHEN 2 THEN 'done' ELSE 'failed' END AS state, page_id AS seq FROM {pages}"""

HOST_RULES = """SELECT 0 AS rule_idx, 'm.ththth.example.net' AS match, CAST(0.5 AS DOUBLE) AS rate, 1 AS concurrency, CAST(0.1 AS DOUBLE) AS jitter
UNION ALL SELECT 1, '*.example.org', CAST(2.0 AS DOUBLE), 2, CAST(0.2 AS DOUBLE) UNION ALL SELECT 2, '*.Example.net', CAST(4.0 AS DOUBLE), 3, CAST(0.3 AS DOUBLE) UNION ALL SELECT 3, '*.org', CAST(9.0 AS DOUBLE), 9, CAST(0.9 AS DOUBLE)"""

PAGE_GRAPH = """SELECT a.page_id AS src, b.page_id AS dst, CASE WHEN b.page_id = 2 * a.page_id + 1 THEN 0 WHEN b.page_id = 2 * a.page_id + 2 THEN 1 ELSE 2 END AS ord
FROM {pages} a JOIN {pages} b ON b.page_id = 2 * a.page_id + 1
UNION ALL SELECT a.page_id, b.page_id, 1 FROM {pages} a JOIN {pages} b ON b.page_id = 2 * a.page_id + 2
UNION ALL SELECT page_id, CAST(0 AS BIGINT), 2 FROM {pages}"""

SITEMAPS = """SELECT 'https://x.org/sitemap.xml' AS url, '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://x.org/a.xml</loc></sitemap><sitemap><loc> https://x.org/b.xml </loc></sitemap><sitemap><loc>https://x.org/sitemap.xml</loc></sitemap></sitemapindex>' AS body
UNION ALL SELECT 'https://x.org/a.xml', '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x.org/1</loc></url><url><loc>https://x.org/2</loc></url><url><loc>  </loc></url></urlset>'
UNION ALL SELECT 'https://x.org/b.xml', '<urlset><url><loc>https://x.org/2</loc></url><url><loc>https://x.org/3</loc></url></urlset>'
UNION ALL SELECT 'https://x.org/unused.xml', '<urlset><url><loc>https://x.org/9</loc></url></urlset>'"""

META_PAGES = """SELECT page_id, url, replace(html, '<meta charset="utf-8">', concat('<meta charset="utf-8"><meta property="og:title" content="OG ', page_id, '"><meta property="og:title" content="Later"><meta property="twitter:site" content="@p"><meta name="twitter:card" content="c', page_id % 3, '"><meta name="Description" content=" About ', page_id, ' ">',
  CASE WHEN page_id % 3 = 0 THEN '<meta property="og:description" content="From og">' ELSE '' END, '<link rel="canonical" href="/c/', page_id, '">',
  CASE page_id % 4 WHEN 0 THEN '<meta property="article:published_time" content="2024-03-01T10:00:00Z">' WHEN 1 THEN '<meta name="date" content="2023-07-09">' WHEN 2 THEN '<meta name="DC.date" content="2022-01-02 03:04:05">' ELSE '<meta name="pubdate" content="garbage">' END,
  '<script type="application/ld+json">{{"@id": ', page_id, '}}</script><script type="application/ld+json">{{bad</script>')) AS html FROM {pages}"""

PDF_TEXTS = """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE replace(text, chr(10), chr(12)) END AS plain, CASE WHEN doc_id % 14 = 0 THEN '' ELSE text END AS layout, CASE WHEN doc_id % 28 = 0 THEN NULL ELSE text END AS ocr FROM {documents}"""


def duck(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


def spark_input(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
