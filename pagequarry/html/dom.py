"""A forgiving HTML tree on the standard library's tokenizer.

Void elements, raw text, implied end tags, implied html / head / body, and formatting elements
that an ended block leaves open and that are opened again in the next one."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title base link meta style script noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Start tag -> open elements that it ends, up to the first of the stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "thead": (("tr", "td", "th", "tbody"), ("table",)), "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)), "tfoot": (("tr", "td", "th", "tbody"), ("table",)),
}


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order, however deep."""
        todo = [iter(self.children)]
        while todo:
            for c in todo[-1]:
                if isinstance(c, Node):
                    yield c
                    todo.append(iter(c.children))
                    break
            else:
                todo.pop()

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [iter(self.children)]
        while todo:
            for c in todo[-1]:
                if isinstance(c, str):
                    out.append(c)
                else:
                    todo.append(iter(c.children))
                    break
            else:
                todo.pop()
        return "".join(out)

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)


def unroll(step: Generator) -> object:
    """Result of a recursive generator that yields a generator for each call: the stack is a list, so depth has no limit."""
    stack, value = [step], None
    while stack:
        try:
            call = stack[-1].send(value)
        except StopIteration as e:
            stack.pop()
            value = e.value
        else:
            stack.append(call)
            value = None
    return value


class _Open(list):
    """The open elements, with how many there are of each tag."""

    def __init__(self, nodes: list[Node]):
        super().__init__(nodes)
        self.count = Counter(n.tag for n in nodes)

    def append(self, n: Node) -> None:
        super().append(n)
        self.count[n.tag] += 1

    def cut(self, k: int) -> list[Node]:
        gone = self[k:]
        del self[k:]
        self.count.subtract(n.tag for n in gone)
        return gone


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.html: Node | None = None
        self.head: Node | None = None
        self.body: Node | None = None
        self.open = _Open([self.root])
        self.again: list[Node] = []

    def _into_body(self) -> None:
        if self.html is None:
            self.html = Node("html", parent=self.root)
            self.root.children.append(self.html)
        if self.body is None:
            self.body = Node("body", parent=self.html)
            self.html.children.append(self.body)
            self.open = _Open([self.root, self.html, self.body])

    def _into_head(self) -> None:
        if self.html is None:
            self.html = Node("html", parent=self.root)
            self.root.children.append(self.html)
        if self.head is None:
            self.head = Node("head", parent=self.html)
            self.html.children.append(self.head)
        self.open = _Open([self.root, self.html, self.head])

    def _add(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        return node

    def _reopen(self) -> None:
        for old in self.again:
            self.open.append(self._add(old.tag, dict(old.attrs)))
        self.again = []

    def _pop_to(self, k: int) -> None:
        for n in self.open.cut(k)[1:]:
            if n.tag in FORMATTING and all(n.tag != m.tag for m in self.again):
                self.again.append(n)

    def _end_open(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        k = len(self.open) - 1
        while k > 2 and any(self.open.count[t] > 0 for t in tags):
            if self.open[k].tag in stops:
                return
            if self.open[k].tag in tags:
                self._pop_to(k)
            k -= 1

    def handle_starttag(self, tag, attrs):
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k.lower(), v or "")
        if tag == "html":
            if self.html is None:
                self.html = Node("html", given, self.root)
                self.root.children.append(self.html)
            else:
                self.html.attrs = {**given, **self.html.attrs}
            if self.body is None and self.head is None:
                self.open = _Open([self.root, self.html])
            return
        if tag == "head":
            if self.body is None:
                self._into_head()
                self.head.attrs = {**given, **self.head.attrs}
            return
        if tag == "body":
            self._into_body()
            self.body.attrs = {**given, **self.body.attrs}
            return
        if self.body is None and tag in HEAD:
            if self.head is None or self.head not in self.open:
                self._into_head()
        else:
            self._into_body()
        if tag in BLOCKS:
            self._end_open(("p",), ("button", "table"))
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        if tag not in BLOCKS and tag not in ENDS and self.body is not None:
            self._reopen()
        node = self._add(tag, given)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("path", "circle", "rect", "use", "svg", "line", "polygon"):
            self.open.cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag in ("html", "body") or tag in VOID:
            return
        if tag == "head":
            if self.body is None and self.html is not None:
                self.open = _Open([self.root, self.html])
            return
        for k in range(len(self.open) - 1, 0, -1) if self.open.count[tag] > 0 else ():
            node = self.open[k]
            if node.tag == tag and node is not self.body:
                if tag in FORMATTING:
                    self.open.cut(k)
                else:
                    self._pop_to(k)
                return
        self.again = [n for n in self.again if n.tag != tag]

    def handle_data(self, data):
        if self.body is None and self.open[-1].tag in ("#document", "html", "head"):
            if not data.strip():
                return
            self._into_body()
        if self.again and data.strip():
            self._reopen()
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    b._into_body()
    return b.root


_SPACE = re.compile(r"\s+")


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip()
