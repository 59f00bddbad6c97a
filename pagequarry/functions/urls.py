"""URL algebra as Column expressions: everything here stays in whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of tracking parameters.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader", "utm_social", "utm_brand",
    "fbclid", "gclid", "dclid", "gbraid", "wbraid", "mc_cid", "mc_eid", "_ga", "_gl", "msclkid", "yclid", "twclid", "igshid", "ref", "ref_src", "ref_url",
)

#: RFC 3986 split: scheme, authority, path, query, fragment. RE2 and Java read it alike.
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$"
WS = r"[\s\p{Z}\x{85}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """Unicode white space off both ends (``trim`` only knows U+0020)."""
    return F.regexp_replace(col(c), rf"^{WS}|{WS}$", "")


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def _authority(url: Column) -> Column:
    return F.regexp_replace(part(url, 2), r"^.*@", "")


def host_port(authority: Column | str) -> Column:
    """struct(host, port) at the last colon; a bracketed or bare IPv6 address is not split."""
    a = col(authority)
    splits = a.rlike(r"^(\[[^\]]*\]|[^:\[\]]*):[0-9]*$")
    return F.when(splits, F.struct(F.regexp_replace(a, r":[0-9]*$", "").alias("host"), F.regexp_extract(a, r":([0-9]*)$", 1).alias("port"))).otherwise(F.struct(a.alias("host"), F.lit("").alias("port")))


def host_of(url: Column | str) -> Column:
    """Host without port, as written; empty where the text is no URL."""
    return host_port(_authority(trim_ws(url)))["host"]


def url_host(url: Column | str) -> Column:
    """Lower-cased host without port; null where the text is no URL."""
    h = F.lower(host_of(url))
    return F.when(h != "", h)


def clean_query(query: Column, tracking: Sequence[str] = TRACKING) -> Column:
    """Parameters less empty ones and tracking ones, sorted by key, then by "=" and value."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.regexp_extract(p, "^([^=]*)(.*)$", 1).alias("k"), F.regexp_extract(p, "^([^=]*)(.*)$", 2).alias("v")))
    names = F.array(*[F.lit(t.lower()) for t in tracking]).cast("array<string>")
    kept = F.filter(pairs, lambda p: ~F.array_contains(names, F.lower(p["k"])))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(p["k"], p["v"])), "&")


def canonicalize_url(url: Column | str, tracking: Sequence[str] = TRACKING, keep_fragment: bool = False) -> Column:
    """Canonical form, or null for what has no scheme or host.

    Scheme and host in lower case, default port off, empty path "/", tracking parameters off, others
    sorted, fragment off unless kept. A path keeps its case and its trailing slash."""
    u = trim_ws(url)
    scheme, authority, query = F.lower(part(u, 1)), part(u, 2), clean_query(part(u, 4), tracking)
    user = F.regexp_extract(authority, r"^(.*@)", 1)
    at = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    at = F.when(scheme == "http", F.regexp_replace(at, ":80$", "")).when(scheme == "https", F.regexp_replace(at, ":443$", "")).otherwise(at)
    path = F.when(part(u, 3) == "", F.lit("/")).otherwise(part(u, 3))
    out = F.concat(scheme, F.lit("://"), user, at, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    if keep_fragment:
        out = F.concat(out, F.when(part(u, 5) == "", F.lit("")).otherwise(F.concat(F.lit("#"), part(u, 5))))
    return F.when((scheme != "") & (host_port(at)["host"] != ""), out)


def resolve_url(base: Column | str, ref: Column | str) -> Column:
    """ref against base, dot segments removed; the reference's fragment stays."""
    b, r = col(base), trim_ws(ref)
    scheme, authority, path = part(b, 1), part(b, 2), part(b, 3)
    root = F.concat(scheme, F.lit("://"), authority)
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), r"[^/]*$", "")
    base_query = F.when(b.rlike(r"^[^?#]*[?]"), F.concat(F.lit("?"), part(b, 4))).otherwise(F.lit(""))
    tail = F.regexp_extract(r, r"^([^?#]*)(.*)$", 2)
    target = F.regexp_extract(r, r"^([^?#]*)(.*)$", 1)
    return (
        F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), r)
        .when(r.startswith("//"), F.concat(scheme, F.lit(":"), r))
        .when(target.startswith("/"), F.concat(root, remove_dots(target), tail))
        .when(target == "", F.when(tail.startswith("?"), F.concat(root, path, tail)).otherwise(F.concat(root, path, base_query, tail)))
        .otherwise(F.concat(root, remove_dots(F.concat(folder, target)), tail))
    )


def remove_dots(path: Column) -> Column:
    """Dot segments of an absolute path, folded over its segments."""
    segments = F.split(F.substr(path, F.lit(2)), "/")
    trailing = path.rlike(r"/\.{1,2}$")
    start = F.array().cast("array<string>")
    fold = F.aggregate(segments, start, lambda acc, s: F.when(s == ".", acc).when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.array_append(acc, s)))
    out = F.concat(F.lit("/"), F.array_join(fold, "/"))
    folded = F.when(trailing & ~out.endswith("/"), F.concat(out, F.lit("/"))).otherwise(out)
    return F.when(path.contains("/."), folded).otherwise(path)


def same_domain(a: Column, b: Column) -> Column:
    """Equal hosts, or one a subdomain of the other."""
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def skip_link(href: Column, tel: bool = True) -> Column:
    """References that never are followed."""
    h = trim_ws(href)
    low = F.lower(h)
    bad = (h == "") | h.startswith("#") | low.startswith("javascript:") | low.startswith("mailto:")
    return bad | low.startswith("tel:") if tel else bad


def is_http(url: Column) -> Column:
    return F.lower(url).rlike("^https?://")


def content_hash(body: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(body).cast("binary"), 256))


def match_host_pattern(host: Column, pattern: Column) -> Column:
    """Exact, or ``*.suffix`` with at least one label before the suffix; case doesn't matter."""
    h, p = F.lower(host), F.lower(pattern)
    suffix = F.substr(p, F.lit(2))
    return F.when(p.startswith("*."), h.endswith(suffix) & (F.length(h) > F.length(suffix))).otherwise(h == p)


def fnv1a_32(text: Column | str) -> Column:
    """FNV-1a hash of the UTF-8 bytes, 0 to 2**32 - 1."""
    digits = F.hex(col(text).cast("binary"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest((F.length(digits) / 2).cast("int") - 1, F.lit(0))), lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    hashed = F.aggregate(pairs, F.lit(2166136261).cast("bigint"), lambda acc, b: (acc.bitwiseXOR(b) * F.lit(16777619).cast("bigint")) % F.lit(1 << 32))
    return F.when(F.length(digits) == 0, F.lit(2166136261).cast("bigint")).otherwise(hashed)


def pool_index(host: Column, size: int) -> Column:
    """Sticky place of a host in a pool."""
    return (fnv1a_32(host) % size).cast("int")
