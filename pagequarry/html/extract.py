"""Extraction from a parsed page: fields, schemas, links, metadata, shells."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from urllib.parse import quote, urldefrag, urljoin, urlsplit, urlunsplit

from pagequarry.functions.quality import SHELL_IDS, SHELL_TAGS
from pagequarry.functions.text import Transform
from pagequarry.html.dom import Node
from pagequarry.html.select import find, find_all
from pagequarry.html.spec import FieldSpec, Schema, SchemaField


def _value(n: Node, attr: str) -> str | None:
    return n.text() if not attr else n.get(attr)


def css(doc: Node, fields: Sequence[FieldSpec]) -> dict[str, object]:
    """First match, or all, of each field; what matches nothing is absent."""
    out: dict[str, object] = {}
    for f in fields:
        found = find_all(doc, f.selector) if f.multiple else [n for n in [find(doc, f.selector)] if n]
        values = [v.strip() if f.trim else v for n in found if (v := _value(n, f.attr)) is not None]
        if values:
            out[f.name] = values if f.multiple else values[0]
    return out


def transform(value: str, steps: Sequence[Transform]) -> object:
    for t in steps:
        match t.type:
            case "trim":
                value = value.strip()
            case "lowercase":
                value = value.lower()
            case "uppercase":
                value = "".join(u if len(u := c.upper()) == 1 else c for c in value)
            case "regex":
                try:
                    m = re.search(t.pattern, value)
                except re.error:
                    continue
                if m:
                    value = (m[1] or "") if m.re.groups else m[0]
            case "split":
                return value.split(t.separator)
    return value


def _one(n: Node, f: SchemaField) -> object | None:
    if f.fields:
        return _object(n, f.fields)
    v = _value(n, f.attr)
    return None if v is None else transform(v.strip(), f.transforms)


def _object(n: Node, fields: Mapping[str, SchemaField]) -> dict[str, object]:
    out = {}
    for name, f in fields.items():
        found: list[Node] = []
        for s in f.selectors or ():
            found = [n] if s == "" else find_all(n, s)
            if found:
                break
        if found:
            values = [v for m in (found if f.multiple else found[:1]) if (v := _one(m, f)) is not None]
            if f.multiple or values:
                out[name] = values if f.multiple else values[0]
    return out


def schema(doc: Node, s: Schema) -> dict[str, object]:
    return _object(doc, s.fields)


def _host(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def _same(a: str, b: str) -> bool:
    return a == b or a.endswith("." + b) or b.endswith("." + a)


def _resolved(href: str | None, base: str, same_domain: bool, tel: bool) -> str | None:
    h = (href or "").strip()
    if not h or h.startswith("#") or h.lower().startswith(("javascript:", "mailto:", "tel:") if tel else ("javascript:", "mailto:")):
        return None
    try:
        url = urljoin(base, h)
    except ValueError:
        return None
    if urlsplit(url).scheme not in ("http", "https") or same_domain and not _same(_host(url), _host(base)):
        return None
    return _escaped(url)


def _escaped(url: str) -> str:
    """url with what a path can't hold as it is in per cent form."""
    u = urlsplit(url)
    return urlunsplit((u.scheme, u.netloc, quote(u.path, safe="/%!$&'()*+,:;=@~"), u.query, u.fragment)) if not url.isascii() or " " in url else url


def first_link(doc: Node, base: str, selector: str, same_domain: bool = False) -> str | None:
    return next((u for n in find_all(doc, selector) if (u := _resolved(n.get("href"), base, same_domain, False))), None)


def all_links(doc: Node, base: str, same_domain: bool = False) -> list[str]:
    """Absolute links without fragments, in the order they are first seen."""
    return list(dict.fromkeys(urldefrag(u)[0] for n in doc.walk() if n.tag == "a" and (u := _resolved(n.get("href"), base, same_domain, True))))


def _jsonld(doc: Node) -> list[str]:
    out = []
    for n in doc.walk():
        if n.tag == "script" and n.get("type") == "application/ld+json":
            try:
                out.append(json.dumps(json.loads(n.text()), sort_keys=True, ensure_ascii=False, separators=(",", ":")))
            except ValueError:
                continue
    return out


def metadata(doc: Node, base: str) -> dict[str, object]:
    """title, description, canonical, language, published (the first candidate text of each source), open_graph,
    twitter, json_ld. Of several tags for one value the first counts, in the two maps the last that isn't empty;
    og: is read from property, twitter: from name, both as written, other names whatever their case."""
    props: dict[str, str] = {}
    names: dict[str, str] = {}
    maps: dict[str, dict[str, str]] = {"og:": {}, "twitter:": {}}
    for n in doc.walk():
        if n.tag != "meta":
            continue
        content = n.get("content")
        value = (content or "").strip()
        for kind, held, prefix in (("property", props, "og:"), ("name", names, "twitter:")):
            key = n.get(kind)
            if key is None:
                continue
            held.setdefault(key if kind == "property" else key.lower(), value)
            if key.startswith(prefix) and value:
                maps[prefix][key.removeprefix(prefix)] = value
    title, page = find(doc, "title"), find(doc, "html")
    link = next((n for n in doc.walk() if n.tag == "link" and n.get("rel") == "canonical"), None)
    href = (link.get("href") or "").strip() if link else ""
    prop, name = (lambda k: props.get(k, "")), (lambda k: names.get(k, ""))
    dates = (prop("article:published_time"), prop("og:published_time"), name("pubdate"), name("date"), name("dc.date"))
    return {
        "title": prop("og:title") or (title.text().strip() if title else ""),
        "description": prop("og:description") or name("twitter:description") or name("description"),
        "canonical": _absolute(base, href) if href else "",
        "language": ((page.get("lang") or "").strip() if page else "") or prop("og:locale"),
        "published": [x for x in dates if x], "open_graph": maps["og:"], "twitter": maps["twitter:"], "json_ld": _jsonld(doc),
    }


def _absolute(base: str, href: str) -> str:
    try:
        return _escaped(urljoin(base, href))
    except ValueError:
        return href


def is_shell(doc: Node) -> bool:
    for selector in (*(f"#{i}" for i in SHELL_IDS), *SHELL_TAGS):
        found = find_all(doc, selector)
        if found and not "".join(n.text() for n in found).strip() and not any(n.elements() for n in found):
            return True
    return False


def missed_selector(doc: Node, selectors: Sequence[str]) -> str | None:
    """The first selector that matches nothing."""
    return next((s for s in selectors if find(doc, s) is None), None)
