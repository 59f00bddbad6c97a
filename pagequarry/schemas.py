"""Table contracts, as DDL: fetches, records and the side tables."""

from __future__ import annotations

FETCHES = "url string, tier string, ord int, final_url string, status_code int, content_type string, body string, duration_ms bigint, error string, fetched_at timestamp, from_cache boolean"
FRONTIER = "url string, state string, attempts int, last_tier string, last_error string, enqueued_at timestamp, updated_at timestamp, seq bigint, fallback string, depth int"
TIER_CACHE = "host string, tier string, updated_at timestamp"
CONTENT_CACHE = "url string, tier string, final_url string, status_code int, content_type string, body string, stored_at timestamp"
HOST_RULES = "rule_idx int, match string, rate double, concurrency int, jitter double"
EDGES = "src string, dst string, ord int"
SITEMAP_SOURCES = "url string, depth int, status int, urlset_count int, index_count int, error string"
SEEDS = "pos bigint, url string, fallback string"
METADATA = (
    "struct<content_type:string,body_bytes:int,final_url:string,redirects:array<string>,extraction:struct<fields:int,hits:int>,discovery:struct<path:string,primary_url:string,fallback_url:string>,"
    "page:struct<title:string,description:string,canonical:string,language:string,published_at:timestamp,open_graph:map<string,string>,twitter:map<string,string>,json_ld:array<string>>,"
    "screenshot_path:string,from_cache:boolean,evasion:struct<browser_like:boolean,stealth:boolean,user_agent:string,jitter_ms:bigint,tls_match:string,proxy:boolean>,"
    "soft_block:struct<detected:boolean,vendor:string,marker:string,tiers:array<string>>,"
    "pdf:struct<page_count:int,title:string,author:string,created_at:timestamp,has_text_layer:boolean,used_ocr:boolean,extractor_tier:string,pages:array<struct<number:int,text:string>>>>"
)
RECORDS = f"url string, canonical_url string, fetched_at timestamp, tier string, status_code int, duration_ms bigint, content_hash string, extracted map<string,string>, body string, body_format string, metadata {METADATA}, error string, failure_category string"
