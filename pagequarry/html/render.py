"""Markdown of a page, and its main content by text density."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Generator, Iterator
from html import escape
from itertools import accumulate
from urllib.parse import urljoin

from pagequarry.html.dom import BLOCKS, VOID, Node, squeeze, unroll

_SKIP = frozenset("script style noscript template head iframe svg".split())
_ESCAPE = re.compile(r"([\\`*_\[\]])")


def _inline(n: Node, base: str) -> Generator:
    out = []
    for c in n.children:
        if isinstance(c, str):
            out.append(_ESCAPE.sub(r"\\\1", re.sub(r"\s+", " ", c)))
            continue
        t = c.tag
        if t in _SKIP:
            continue
        inner = yield _inline(c, base)
        if t == "br":
            out.append("  \n")
        elif t == "img":
            out.append(f"![{c.get('alt') or ''}]({urljoin(base, c.get('src') or '')})")
        elif t in ("code", "tt", "kbd"):
            out.append(f"`{c.text().strip()}`")
        elif not inner.strip():
            out.append(inner)
        else:
            lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
            core = inner.strip()
            if t in ("b", "strong"):
                core = f"**{core}**"
            elif t in ("i", "em"):
                core = f"*{core}*"
            elif t == "a" and c.get("href"):
                core = f"[{core}]({urljoin(base, c.get('href').strip())})"
            out.append(lead + core + tail)
    return "".join(out)


_BLOCKS = BLOCKS | {"html", "body", "li", "tr", "td", "th", "thead", "tbody", "dt", "dd"}


def _holders(doc: Node) -> set[int]:
    """Ids of the elements that are blocks or hold one."""
    out: set[int] = set()
    for n in doc.walk():
        if n.tag in _BLOCKS:
            up = n
            while up is not None and id(up) not in out:
                out.add(id(up))
                up = up.parent
    return out


def _own_rows(table: Node) -> list[Node]:
    """Rows of a table, without those of tables in its cells."""
    out, todo = [], table.elements()[::-1]
    while todo:
        n = todo.pop()
        if n.tag == "tr":
            out.append(n)
        elif n.tag != "table":
            todo += n.elements()[::-1]
    return out


def _blocks(n: Node, base: str, holders: set[int]) -> Generator:
    out: list[str] = []
    line = Node("span")

    def flush() -> Generator:
        text = (yield _inline(line, base)).strip()
        if text:
            out.append(text)
        line.children = []

    for c in n.children:
        if isinstance(c, Node) and c.tag in _SKIP:
            continue
        if isinstance(c, str) or id(c) not in holders:
            line.children.append(c)
            continue
        yield flush()
        if re.fullmatch("h[1-6]", c.tag):
            if text := squeeze((yield _inline(c, base))):
                out.append("#" * int(c.tag[1]) + " " + text)
        elif c.tag == "pre":
            code = c.text().strip("\n")
            out.append(f"```\n{code}\n```")
        elif c.tag == "blockquote":
            inner = yield _blocks(c, base, holders)
            out.append("\n".join("> " + x if x else ">" for x in "\n\n".join(inner).split("\n")))
        elif c.tag in ("ul", "ol"):
            items = []
            for k, li in enumerate(x for x in c.elements() if x.tag == "li"):
                mark = f"{k + 1}. " if c.tag == "ol" else "- "
                inner = yield _blocks(li, base, holders)
                items.append(mark + "\n\n".join(inner).replace("\n", "\n" + " " * len(mark)))
            out.append("\n".join(items))
        elif c.tag == "hr":
            out.append("* * *")
        elif c.tag == "table":
            rows = []
            for r in _own_rows(c):
                cells = []
                for d in r.elements():
                    if d.tag in ("td", "th"):
                        cells.append(squeeze((yield _inline(d, base))).replace("|", "\\|"))
                if cells:
                    rows.append(cells)
            if rows:
                out.append("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]))
        else:
            out += yield _blocks(c, base, holders)
    yield flush()
    return out


def to_markdown(doc: Node, base: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(b for b in unroll(_blocks(doc, base, _holders(doc))) if b.strip())).strip()


_UNLIKELY = re.compile(r"nav|menu|footer|header|sidebar|comment|\bad\b|\bads\b|advert|banner|breadcrumb|cookie|share|social|promo|related", re.I)
_LIKELY = re.compile(r"article|content|main|post|entry|story|body", re.I)
_DROP = frozenset("nav footer header aside form script style noscript template iframe button".split())


def to_html(n: Node | str) -> str:
    out: list[str] = []
    todo: list[Node | str | tuple[str]] = [n]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(escape(x, quote=False))
        else:
            named = x.tag != "#document"
            if named:
                attrs = "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items())
                out.append(f"<{x.tag}{attrs}>")
            if named and x.tag not in VOID:
                todo.append((f"</{x.tag}>",))
            if x.tag in ("script", "style"):
                out.append(x.text())
            elif x.tag not in VOID:
                todo += reversed(x.children)
    return "".join(out)


def _marks(n: Node) -> str:
    return f"{n.get('class') or ''} {n.get('id') or ''}"


def _unlikely(c: Node) -> bool:
    marks = _marks(c)
    return bool(_UNLIKELY.search(marks)) and not _LIKELY.search(marks) and c.tag not in ("body", "article", "main")


def _pruned(n: Node) -> Node:
    top = Node(n.tag, n.attrs)
    todo = [(n, top)]
    while todo:
        old, new = todo.pop()
        for c in old.children:
            if isinstance(c, str):
                new.children.append(c)
            elif c.tag not in _DROP and not _unlikely(c):
                child = Node(c.tag, c.attrs, new)
                new.children.append(child)
                todo.append((c, child))
    return top


def _paragraphs(top: Node) -> list[tuple[Node, str, int]]:
    """(element, its text squeezed, how much of that is in links) of the elements that hold running text, from one
    walk: an element's text is a part of the whole."""
    parts: list[str] = []
    marks: list[int] = [0]
    at = 0
    found: list[list] = []
    links: list[tuple[int, int]] = []
    todo: list[tuple[Node, Iterator, int]] = [(top, iter(top.children), 0)]
    while todo:
        node, rest, start = todo[-1]
        for c in rest:
            if isinstance(c, str):
                parts.append(c)
                at += len(c)
            else:
                if c.tag in ("p", "pre", "td", "blockquote"):
                    found.append([c, at, at])
                    marks.append(len(found))
                todo.append((c, iter(c.children), at))
                break
        else:
            todo.pop()
            if node.tag == "a":
                links.append((start, at))
            if node.tag in ("p", "pre", "td", "blockquote") and node is not top:
                found[marks.pop() - 1][2] = at
    text = "".join(parts)
    links.sort()
    starts = [a for a, _ in links]
    sums = [0, *accumulate(len(squeeze(text[a:b])) for a, b in links)]
    return [(n, squeeze(text[a:b]), sums[bisect_left(starts, b)] - sums[bisect_left(starts, a)]) for n, a, b in found]


def readable(doc: Node, html: str) -> str:
    """HTML of the part with the most running text; the page as it was if there is none."""
    body = next((n for n in doc.walk() if n.tag == "body"), doc)
    kept = _pruned(body)
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for p, text, links in _paragraphs(kept):
        if len(text) < 25:
            continue
        score = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - links / max(len(text), 1))
        for share, up in ((1.0, p.parent), (0.5, p.parent.parent if p.parent else None)):
            if up is not None:
                bonus = 5.0 if up.tag in ("article", "main") or _LIKELY.search(_marks(up)) else 0.0
                scores[id(up)] = scores.get(id(up), bonus) + score * share
                nodes[id(up)] = up
    if not scores:
        return html
    best = nodes[max(scores, key=scores.get)]
    return to_html(best) if squeeze(best.text()) else html
