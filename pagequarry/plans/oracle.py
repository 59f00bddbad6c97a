"""SQL twins of the scalar functions, for DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from pagequarry.functions.quality import REACHABLE, SOFT_BLOCKS
from pagequarry.functions.urls import PARTS, TRACKING


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$', '', 'g')"


def part(u: str, n: int) -> str:
    return f"regexp_extract({u}, '{PARTS}', {n})"


def host_raw(u: str) -> str:
    a = f"regexp_replace({part(trim(u), 2)}, '^.*@', '')"
    return f"CASE WHEN regexp_matches({a}, '^(\\[[^\\]]*\\]|[^:\\[\\]]*):[0-9]*$') THEN regexp_replace({a}, ':[0-9]*$', '') ELSE {a} END"


def host(u: str) -> str:
    return f"nullif(lower({host_raw(u)}), '')"


def canonical(u: str, tracking: Sequence[str] = TRACKING, fragment: bool = False) -> str:
    t = trim(u)
    names = "[" + ", ".join(f"'{x}'" for x in tracking) + "]"
    pairs = f"list_transform(list_filter(string_split({part(t, 4)}, '&'), lambda p: p <> ''), lambda p: {{'k': regexp_extract(p, '^([^=]*)(.*)$', 1), 'v': regexp_extract(p, '^([^=]*)(.*)$', 2)}})"
    query = f"array_to_string(list_transform(list_sort(list_filter({pairs}, lambda p: NOT list_contains({names}, lower(p.k)))), lambda p: concat(p.k, p.v)), '&')"
    at = f"lower(regexp_replace({part(t, 2)}, '^.*@', ''))"
    scheme = f"lower({part(t, 1)})"
    at = f"CASE {scheme} WHEN 'http' THEN regexp_replace({at}, ':80$', '') WHEN 'https' THEN regexp_replace({at}, ':443$', '') ELSE {at} END"
    path = f"CASE WHEN {part(t, 3)} = '' THEN '/' ELSE {part(t, 3)} END"
    end = f", CASE WHEN {part(t, 5)} = '' THEN '' ELSE concat('#', {part(t, 5)}) END" if fragment else ""
    return f"CASE WHEN {host_raw(u)} <> '' THEN concat({scheme}, '://', regexp_extract({part(t, 2)}, '^(.*@)', 1), {at}, {path}, CASE WHEN coalesce({query}, '') = '' THEN '' ELSE concat('?', {query}) END{end}) END"


def soft_block(body: str, what: str) -> str:
    k = 0 if what == "vendor" else 1
    whens = " ".join(f"WHEN contains(lower({body}), '{b[1]}') THEN '{b[k]}'" for b in SOFT_BLOCKS)
    return f"CASE WHEN strlen({body}) <= 51200 THEN CASE {whens} END END"


def shell(body: str) -> str:
    empty = ">(\\s|<!--[\\s\\S]*?-->)*</"
    return f"(regexp_matches({body}, '<(?i:[a-z][a-z0-9-]*(\\s[^>]*)?\\sid\\s*=\\s*)[\"'']?(root|__next|app|__nuxt|svelte)[\"'']?(\\s[^>]*)?{empty}') OR regexp_matches({body}, '(?i:<app-root)(\\s[^>]*)?{empty}'))"


def html(ct: str) -> str:
    return f"({ct} = '' OR contains(lower({ct}), 'text/html') OR contains(lower({ct}), 'application/xhtml'))"


def checked(attempts: str) -> str:
    """attempts with reason, valid, escalate, vendor, marker."""
    plain = "regexp_matches(lower(content_type), 'application/json|application/xml|text/xml|text/plain|application/pdf|application/x-pdf')"
    return f"""SELECT *, verdict = '' AS valid, CASE WHEN failed THEN '' ELSE CASE WHEN verdict = '' THEN '' ELSE substr(verdict, 2) END END AS reason,
  failed OR (verdict <> '' AND verdict[1] = '+') AS escalate
FROM (SELECT *, coalesce(error, '') <> '' AS failed, CASE
  WHEN coalesce(error, '') <> '' THEN '+'
  WHEN status_code = 0 THEN '+no response'
  WHEN NOT (status_code >= 200 AND status_code < 300) THEN concat(CASE WHEN status_code = 429 OR status_code BETWEEN 500 AND 599 OR status_code < 400 THEN '+' ELSE '-' END, 'http ', status_code)
  WHEN NOT {html("content_type")} AND {plain} THEN ''
  WHEN NOT {html("content_type")} THEN concat('-unsupported content-type: ', lower(content_type))
  WHEN strlen(body) < 512 THEN '+body below threshold'
  WHEN {soft_block("body", "vendor")} IS NOT NULL THEN concat('+soft block: ', {soft_block("body", "vendor")}, '/', {soft_block("body", "marker")})
  WHEN {shell("body")} THEN '+spa shell detected' ELSE '' END AS verdict FROM ({attempts}) a0) a1"""


def classify(error: str, reason: str, status: str) -> str:
    msg = f"lower(CASE WHEN coalesce({error}, '') <> '' AND coalesce({reason}, '') <> '' THEN concat({error}, ' | ', {reason}) ELSE concat(coalesce({error}, ''), coalesce({reason}, '')) END)"
    code = f"CASE WHEN coalesce({status}, 0) <> 0 THEN {status} ELSE coalesce(TRY_CAST(nullif(regexp_extract({msg}, '(?:http|status)[: ]+([0-9]{{3}})', 1), '') AS INTEGER), 0) END"
    has = lambda *xs: "(" + " OR ".join(f"contains({msg}, '{x}')" for x in xs) + ")"
    rules = [
        (f"{msg} = '' AND {status} >= 200 AND {status} < 300", "success"), (has("blocked by robots.txt"), "robots_blocked"), (has("spa shell"), "spa_shell"), (has("soft block"), "soft_block"), (has("follow:"), "follow_failed"),
        (has("wpengine.com"), "parked_domain"), (has("no such host", "nxdomain", "err_name_not_resolved"), "dns_failure"), (has("connection refused", "err_connection_refused"), "connection_refused"),
        (has("tls:", "x509:", "certificate is valid for", "err_cert_"), "tls_error"), (has("context deadline exceeded", "context canceled", "timeout"), "timeout"), (f"{has('cf-chl', 'cloudflare')} OR {code} = 1020", "cloudflare_block"),
        (f"{code} BETWEEN 400 AND 499", "http_4xx"), (f"{code} BETWEEN 500 AND 599", "http_5xx"), (has("all tiers exhausted"), "all_tiers_exhausted"), (has("extract:"), "extraction_failed"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, k in rules) + " ELSE 'other' END"


def made(attempts: str) -> str:
    """Checked attempts up to where the ladder stops."""
    return f"SELECT * FROM (SELECT *, min(CASE WHEN valid OR NOT escalate THEN ord END) OVER (PARTITION BY url) AS stop FROM ({checked(attempts)}) c0) c1 WHERE stop IS NULL OR ord <= stop"


def reachable(c: str) -> str:
    return f"{c} IN (" + ", ".join(f"'{x}'" for x in REACHABLE) + ")"


def links(h: str) -> str:
    return f"regexp_extract_all({h}, '<a href=\"([^\"]*)\"', 1)"


def unescape(x: str) -> str:
    return f"replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
