"""Page validity, soft blocks, failure classes and retry rules as CASE expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions.urls import col

#: Vendor and marker of walls, in order; the first that occurs counts.
SOFT_BLOCKS = (
    ("cloudflare", "cf-chl"), ("cloudflare", "cf-browser-verification"), ("cloudflare", "cf-turnstile"), ("cloudflare", "just a moment"), ("cloudflare", "checking your browser"), ("cloudflare", "challenges.cloudflare.com"),
    ("akamai", "akam_blocked"), ("akamai", "pardon our interruption"), ("akamai", "reference #18."),
    ("datadome", "datadome"), ("datadome", "dd-captcha"),
    ("incapsula", "_incapsula_resource"), ("incapsula", "incap_ses"),
    ("perimeterx", "px-captcha"), ("perimeterx", "_pxaction"), ("perimeterx", "_pxhd"),
    ("generic", "/recaptcha/api.js"), ("generic", "hcaptcha.com/1/api.js"), ("generic", "attention required"), ("generic", "you have been blocked"), ("generic", "access denied"), ("generic", "request unsuccessful"),
)
#: Ids and tags of application shells.
SHELL_IDS = ("root", "__next", "app", "__nuxt", "svelte")
SHELL_TAGS = ("app-root",)
#: What is taken as it is, beside HTML.
DIRECT = ("application/json", "application/xml", "text/xml", "text/plain", "application/pdf", "application/x-pdf")
REACHABLE = ("success", "extraction_failed", "pdf_tooling_missing")
CATEGORIES = (
    "success", "robots_blocked", "spa_shell", "soft_block", "follow_failed", "parked_domain", "dns_failure", "connection_refused", "tls_error", "timeout",
    "cloudflare_block", "http_4xx", "http_5xx", "all_tiers_exhausted", "extraction_failed", "pdf_tooling_missing", "other",
)


@dataclass(frozen=True)
class Checker:
    """Limits of the validity check; 0 bytes or an empty tuple switch a test off."""

    min_bytes: int = 512
    soft_block_bytes: int = 51200
    detect_soft_blocks: bool = True
    detect_shells: bool = True


def is_html(content_type: Column | str) -> Column:
    c = F.lower(col(content_type))
    return (c == "") | c.contains("text/html") | c.contains("application/xhtml")


def is_pdf(content_type: Column | str) -> Column:
    c = F.lower(col(content_type))
    return c.contains("application/pdf") | c.contains("application/x-pdf")


def is_json(content_type: Column | str) -> Column:
    c = F.lower(col(content_type))
    return c.contains("application/json") | c.contains("+json")


def soft_block(body: Column | str, limit: int = Checker.soft_block_bytes) -> Column:
    """struct(vendor, marker) of the first marker in catalogue order, null without one or for a longer body."""
    low = F.lower(col(body))
    out = None
    for vendor, marker in SOFT_BLOCKS:
        hit = F.struct(F.lit(vendor).alias("vendor"), F.lit(marker).alias("marker"))
        out = F.when(low.contains(marker), hit) if out is None else out.when(low.contains(marker), hit)
    return F.when(F.octet_length(col(body)) <= limit, out)


def maybe_shell(body: Column | str) -> Column:
    """Whether a known mount point occurs at all; only then is it worth parsing the page for its emptiness."""
    ids, tags = "|".join(map(re.escape, SHELL_IDS)), "|".join(SHELL_TAGS)
    return col(body).rlike(rf"(?i:\sid\s*=)\s*[\"']?\s*({ids})|(?i:<({tags}))")


def spa_shell(body: Column | str) -> Column:
    """An application shell: a known mount point with neither text nor elements in it, comments apart. Without a
    parser: the first of several, or one that is never closed, may be taken wrongly; html.extract.is_shell reads
    the tree."""
    ids, tags, empty = "|".join(SHELL_IDS), "|".join(SHELL_TAGS), r">(\s|<!--(?s:.*?)-->)*</"
    b = col(body)
    return b.rlike(rf"<(?i:[a-z][a-z0-9-]*(\s[^>]*)?\sid\s*=\s*)[\"']?({ids})[\"']?(\s[^>]*)?{empty}") | b.rlike(rf"(?i:<({tags}))(\s[^>]*)?{empty}")


def http_reason(status: Column) -> Column:
    return F.when(status == 0, "no response").otherwise(F.concat(F.lit("http "), status.cast("string")))


def validity(status: Column | str, content_type: Column | str, body: Column | str, checker: Checker = Checker(), shell: Column | None = None, missed: Column | None = None, block: Column | None = None, field: str = "") -> Column:
    """struct(valid, reason, escalate, vendor, marker): status, type, size, wall, shell, then required selectors.

    shell and missed (the first required selector that matches nothing) may come from a parsed document; block
    may be a column that holds soft_block's result, so that markers are looked for once."""
    st, ct, b = col(status), col(content_type), F.coalesce(col(body), F.lit(""))
    low = F.lower(F.coalesce(ct, F.lit("")))

    def result(valid: bool, reason: Column | str, escalate: bool, block: Column | None = None) -> Column:
        text = F.lit(reason) if isinstance(reason, str) else reason
        vendor, marker = (block["vendor"], block["marker"]) if block is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))
        fields = {"valid": F.lit(valid), "reason": text, "escalate": F.lit(escalate), "vendor": vendor, "marker": marker}
        return fields[field] if field else F.struct(*[c.alias(n) for n, c in fields.items()])

    ok = (st >= 200) & (st < 300)
    out = F.when(~ok & ((st == 429) | st.between(500, 599)), result(False, http_reason(st), True))
    out = out.when(~ok & (st >= 400), result(False, http_reason(st), False))
    out = out.when(~ok, result(False, http_reason(st), True))
    direct = F.lit(False)
    for kind in DIRECT:
        direct = direct | low.contains(kind)
    out = out.when(~is_html(low) & direct, result(True, "", False))
    out = out.when(~is_html(low), result(False, F.concat(F.lit("unsupported content-type: "), low), False))
    out = out.when(F.octet_length(b) < checker.min_bytes, result(False, "body below threshold", True))
    if checker.detect_soft_blocks:
        block = soft_block(b, checker.soft_block_bytes) if block is None else block
        out = out.when(block.isNotNull(), result(False, F.concat(F.lit("soft block: "), block["vendor"], F.lit("/"), block["marker"]), True, block))
    if checker.detect_shells:
        out = out.when(spa_shell(b) if shell is None else shell, result(False, "spa shell detected", True))
    if missed is not None:
        out = out.when(missed.isNotNull(), result(False, F.concat(F.lit("required selector missed: "), missed), True))
    return out.otherwise(result(True, "", False))


def classify_failure(error: Column | str, reason: Column | str, status: Column | str) -> Column:
    """Failure class; the first rule that holds wins."""
    e, r = F.coalesce(col(error), F.lit("")), F.coalesce(col(reason), F.lit(""))
    msg = F.lower(F.when((e != "") & (r != ""), F.concat(e, F.lit(" | "), r)).otherwise(F.concat(e, r)))
    st = F.coalesce(col(status), F.lit(0))
    found = F.regexp_extract(msg, r"(?:http|status)[: ]+([0-9]{3})", 1)
    code = F.when(st != 0, st).when(found != "", found.cast("int")).otherwise(F.lit(0))
    has = lambda *xs: F.greatest(*[msg.contains(x) for x in xs]) if len(xs) > 1 else msg.contains(xs[0])
    return (
        F.when((msg == "") & (st >= 200) & (st < 300), "success")
        .when(has("blocked by robots.txt"), "robots_blocked")
        .when(has("spa shell"), "spa_shell")
        .when(has("soft block"), "soft_block")
        .when(has("follow:"), "follow_failed")
        .when(has("wpengine.com"), "parked_domain")
        .when(has("no such host", "nxdomain", "err_name_not_resolved"), "dns_failure")
        .when(has("connection refused", "err_connection_refused"), "connection_refused")
        .when(has("tls:", "x509:", "certificate is valid for", "err_cert_"), "tls_error")
        .when(has("context deadline exceeded", "context canceled", "timeout"), "timeout")
        .when(has("cf-chl", "cloudflare") | (code == 1020), "cloudflare_block")
        .when(code.between(400, 499), "http_4xx")
        .when(code.between(500, 599), "http_5xx")
        .when(has("all tiers exhausted"), "all_tiers_exhausted")
        .when(has("extract:"), "extraction_failed")
        .otherwise("other")
    )


def is_reachable(category: Column | str) -> Column:
    return col(category).isin(*REACHABLE)


def should_try_fallback(category: Column | str) -> Column:
    return col(category).isin("http_4xx", "dns_failure")


def is_retryable_status(status: Column | str) -> Column:
    return col(status).isin(429, 502, 503, 504)


def is_retryable_error(error: Column | str) -> Column:
    """Transient trouble of the network. A caller that gave up and a bad certificate are final; time-outs,
    resets, refusals, unreachable networks, early ends and other failures of a dial or a transfer are not."""
    m = F.lower(F.coalesce(col(error), F.lit("")))
    final = m.contains("context canceled") | m.contains("context deadline exceeded") | m.contains("x509:") | m.contains("certificate")
    return ~final & m.rlike("timeout|timed out|connection reset|connection refused|network is unreachable|no route to host|eof|use of closed network connection|^(dial|read|write) (tcp|udp)")


def backoff_bounds(base_ms: Column, attempt: Column, cap_ms: int = 10_000) -> Column:
    """struct(low, high) of the delay before an attempt: base * 2 ** min(attempt, 6), give or take a quarter, at most cap."""
    mid = base_ms * F.pow(F.lit(2.0), F.least(attempt, F.lit(6)))
    return F.struct(F.least(mid * 0.75, F.lit(float(cap_ms))).alias("low"), F.least(mid * 1.25, F.lit(float(cap_ms))).alias("high"))


def backoff_delay(base_ms: Column, attempt: Column, seed: int = 0) -> Column:
    b = backoff_bounds(base_ms, attempt)
    return b["low"] + F.rand(seed) * (b["high"] - b["low"])


def jitter_bound(rate: Column, fraction: Column) -> Column:
    """Largest jitter in seconds for a rate a second; 0 without a limit."""
    return F.when((rate > 0) & (rate < float("inf")), fraction / rate).otherwise(F.lit(0.0))


def rotate_proxy(status: Column, codes: Column) -> Column:
    return F.array_contains(codes, status)
