"""CSS selectors: tag, #id, .class, [attr] with = *= ^= $= ~= |= and i, the four combinators, lists,
:contains(), :not(), :first-child, :last-child, :only-child, :empty, :nth-child(). Others raise ValueError."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pagequarry.html.dom import Node

Test = Callable[[Node], bool]
_IDENT = re.compile(r"-?[A-Za-z_\u0080-￿][\w\u0080-￿-]*|\*")
_ATTR = re.compile(r"""\[\s*([\w:-]+)\s*(?:([*^$~|]?=)\s*("[^"]*"|'[^']*'|[^\]\s]+)\s*([iI])?\s*)?\]""")


def _attr_test(name: str, op: str | None, value: str, fold: bool) -> Test:
    name = name.lower()
    value = value.lower() if fold else value

    def test(n: Node) -> bool:
        v = n.attrs.get(name)
        if v is None or op is None:
            return v is not None
        v = v.lower() if fold else v
        match op:
            case "=":
                return v == value
            case "*=":
                return bool(value) and value in v
            case "^=":
                return bool(value) and v.startswith(value)
            case "$=":
                return bool(value) and v.endswith(value)
            case "~=":
                return value in v.split()
            case _:
                return v == value or v.startswith(value + "-")

    return test


def _place(n: Node) -> int:
    return next(i for i, c in enumerate(n.parent.elements(), 1) if c is n) if n.parent else 1


def _nth(arg: str) -> Test:
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.strip().lower(), arg.replace(" ", "").lower())
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not m or not arg:
        raise ValueError(f"nth-child({arg})")
    a = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] or 0)
    return lambda n: (d := _place(n) - b) == 0 if a == 0 else (_place(n) - b) % abs(a) == 0 and (_place(n) - b) / a >= 0


def _arg(s: str, i: int) -> tuple[str, int]:
    """Text in the brackets that open at i, and where they end."""
    depth, quote = 0, ""
    for j in range(i, len(s)):
        c = s[j]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return s[i + 1 : j], j + 1
    raise ValueError(f"open bracket in {s!r}")


def _pseudo(name: str, arg: str | None) -> Test:
    if name == "contains" and arg is not None:
        want = arg.strip().strip("\"'")
        return lambda n: want in n.text()
    if name == "not" and arg is not None:
        inner = compile_selector(arg)
        return lambda n: not inner(n)
    if name == "nth-child" and arg is not None:
        return _nth(arg)
    tests: dict[str, Test] = {
        "first-child": lambda n: _place(n) == 1,
        "last-child": lambda n: n.parent is None or n.parent.elements()[-1] is n,
        "only-child": lambda n: n.parent is None or len(n.parent.elements()) == 1,
        "empty": lambda n: not n.children,
    }
    if arg is None and name in tests:
        return tests[name]
    raise ValueError(f"unsupported pseudo-class :{name}")


def _compound(s: str, i: int) -> tuple[Test, int]:
    tests: list[Test] = []
    start = i
    if m := _IDENT.match(s, i):
        tag, i = m[0].lower(), m.end()
        if tag != "*":
            tests.append(lambda n: n.tag == tag)
    while i < len(s):
        c = s[i]
        if c in "#.":
            m = re.compile(r"[\w\u0080-￿-]+").match(s, i + 1)
            if not m:
                raise ValueError(f"name expected in {s!r} at {i}")
            tests.append(_attr_test("id", "=", m[0], False) if c == "#" else _attr_test("class", "~=", m[0], False))
            i = m.end()
        elif c == "[":
            m = _ATTR.match(s, i)
            if not m:
                raise ValueError(f"attribute selector in {s!r} at {i}")
            value = m[3] or ""
            tests.append(_attr_test(m[1], m[2], value[1:-1] if value[:1] in "\"'" and value else value, bool(m[4])))
            i = m.end()
        elif c == ":":
            m = re.compile(r":([a-z-]+)").match(s, i)
            if not m:
                raise ValueError(f"pseudo-class in {s!r} at {i}")
            i = m.end()
            arg = None
            if i < len(s) and s[i] == "(":
                arg, i = _arg(s, i)
            tests.append(_pseudo(m[1], arg))
        else:
            break
    if i == start:
        raise ValueError(f"selector expected in {s!r} at {i}")
    return (lambda n: all(t(n) for t in tests)), i


def _complex(s: str, i: int) -> tuple[Test, int]:
    test, i = _compound(s, i)
    while i < len(s):
        m = re.compile(r"\s*([>+~,])\s*|\s+").match(s, i)
        if not m or m[1] == "," or m.end() == len(s):
            break
        right, i = _compound(s, m.end())
        test = _joined(test, m[1] or " ", right)
    return test, i


def _joined(left: Test, how: str, right: Test) -> Test:
    def before(n: Node) -> list[Node]:
        if n.parent is None:
            return []
        all_ = n.parent.elements()
        return all_[: next(i for i, c in enumerate(all_) if c is n)]

    def test(n: Node) -> bool:
        if not right(n):
            return False
        if how == ">":
            return n.parent is not None and n.parent.tag != "#document" and left(n.parent)
        if how == "+":
            return bool(b := before(n)) and left(b[-1])
        if how == "~":
            return any(left(x) for x in before(n))
        p = n.parent
        while p is not None and p.tag != "#document":
            if left(p):
                return True
            p = p.parent
        return False

    return test


@lru_cache(1024)
def compile_selector(s: str) -> Test:
    s = s.strip()
    tests, i = [], 0
    while True:
        test, i = _complex(s, i)
        tests.append(test)
        if i >= len(s.rstrip()):
            break
        m = re.compile(r"\s*,\s*").match(s, i)
        if not m:
            raise ValueError(f"unsupported selector {s!r} at {i}")
        i = m.end()
    return tests[0] if len(tests) == 1 else lambda n: any(t(n) for t in tests)


def find_all(node: Node, selector: str) -> list[Node]:
    """Matches below node, in document order."""
    test = compile_selector(selector)
    return [n for n in node.walk() if test(n)]


def find(node: Node, selector: str) -> Node | None:
    test = compile_selector(selector)
    return next((n for n in node.walk() if test(n)), None)
