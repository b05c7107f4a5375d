"""XPath 1.0 over markup as it comes: a tolerant tree of a page, and expressions compiled once to functions over its nodes.

Supported: location paths with the axes child, descendant, descendant-or-self, self, parent, ancestor, ancestor-or-self, following-sibling, preceding-sibling and attribute and their short forms; the tests
name, ``*``, ``text()`` and ``node()``; predicates by position and by expression; unions; ``or and = != < <= > >= + - * div mod``; the functions listed in ``FUNCTIONS``, ``last`` and ``position``.
Namespaces, variables and comments are not; an expression that doesn't compile raises ``ValueError``.

Trees are built and walked without recursion, so depth is bounded by memory only. Tags are lower-case. Unclosed elements end where HTML lets them end (a paragraph before a block, an item before the next
item, a cell before the next cell), else with their parent; stray end tags are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape

from .references import Markup

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed values of the HTML standard: what ends an open element of a name, and within what that is looked for.
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]), "head": frozenset(["body"]),
}
WALLS = frozenset("ul ol dl table select article section main div nav body html".split())


class Element:
    __slots__ = ("tag", "attrs", "parent", "children", "order", "place")

    def __init__(self, tag: str, attrs: dict, parent, order: int):
        self.tag, self.attrs, self.parent, self.children, self.order = tag, attrs, parent, [], order
        self.place = len(parent.children) if parent is not None else 0


class Text(str):
    """A text node or, with a name, an attribute."""

    __slots__ = ("parent", "order", "name", "place")

    @classmethod
    def of(cls, value: str, parent: Element, order, name: str | None = None, place: int = -1):
        out = cls(value)
        out.parent, out.order, out.name, out.place = parent, order, name, place
        return out


class Tree(Markup):
    def __init__(self, html: str):
        super().__init__()
        self.root = Element("", {}, None, 0)
        self.stack, self.made = [self.root], 0
        self.open: dict[str, int] = {}
        self.whole(html)

    def _pop(self, to: int) -> None:
        for e in self.stack[to:]:
            self.open[e.tag] -= 1
        del self.stack[to:]

    def handle_starttag(self, tag, attrs):
        # Only what could be ended is searched for, so that many open elements cost nothing.
        for ended, by in ENDED_BY.items():
            if tag in by and self.open.get(ended):
                for k in range(len(self.stack) - 1, 0, -1):
                    at = self.stack[k].tag
                    if at == ended:
                        self._pop(k)
                        break
                    if at in WALLS and not (at in ENDED_BY and tag in ENDED_BY[at]):
                        break
        self.made += 1
        top = self.stack[-1]
        e = Element(tag, {k: self.plain(v) for k, v in reversed(attrs)}, top, self.made)
        top.children.append(e)
        if tag not in VOID:
            self.stack.append(e)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open.get(tag):
            k = len(self.stack) - 1
            while self.stack[k].tag != tag:
                k -= 1
            self._pop(k)

    def handle_data(self, data):
        self.made += 1
        top = self.stack[-1]
        top.children.append(Text.of(self.plain(data), top, self.made, place=len(top.children)))


def descendants(node) -> list:
    """All nodes below, in document order."""
    out, todo = [], list(reversed(node.children)) if isinstance(node, Element) else []
    while todo:
        at = todo.pop()
        out.append(at)
        if isinstance(at, Element):
            todo.extend(reversed(at.children))
    return out


def text_of(node) -> str:
    return str(node) if isinstance(node, str) else "".join(n for n in descendants(node) if isinstance(n, str))


def markup_of(node) -> str:
    """The markup of a node as the tree has it."""
    out, todo = [], [node]
    while todo:
        at = todo.pop()
        if isinstance(at, tuple):
            out.append(at[0])
        elif isinstance(at, str):
            out.append(str(at) if at.parent.tag in ("script", "style") else escape(at, quote=False))
        else:
            out.append(f"<{at.tag}{''.join(f' {k}=\"{escape(v)}\"' for k, v in reversed(at.attrs.items()))}>")
            if at.tag not in VOID:
                todo.append((f"</{at.tag}>",))
                todo.extend(reversed(at.children))
    return "".join(out)


# Values: node lists, strings, numbers, booleans


def string(v) -> str:
    if isinstance(v, list):
        return text_of(v[0]) if v else ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "NaN" if v != v else str(int(v)) if v == v // 1 and abs(v) < 1e15 else repr(v)
    return str(v)


def number(v) -> float:
    if isinstance(v, bool | float):
        return float(v)
    s = string(v).strip()
    return float(s) if re.fullmatch(r"-?(\d+\.?\d*|\.\d+)", s) else float("nan")


def boolean(v) -> bool:
    return v == v and v != 0 if isinstance(v, float) else bool(v)


COMPARE: dict[str, Callable] = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compare(op: str, a, b) -> bool:
    """A node list compares by any of its nodes."""
    if isinstance(a, bool) or isinstance(b, bool):
        return COMPARE[op](boolean(a), boolean(b)) if op in ("=", "!=") else COMPARE[op](number(boolean(a)), number(boolean(b)))
    for x in a if isinstance(a, list) else [a]:
        for y in b if isinstance(b, list) else [b]:
            x, y = (text_of(v) if not isinstance(v, float) else v for v in (x, y))
            numeric = op not in ("=", "!=") or isinstance(x, float) or isinstance(y, float)
            if COMPARE[op](number(x), number(y)) if numeric else COMPARE[op](x, y):
                return True
    return False


def _substring(s, start, size=None):
    s, a = string(s), number(start)
    b = a + number(size) if size is not None else float("inf")
    return "".join(c for k, c in enumerate(s, 1) if a <= k < b)


FUNCTIONS: dict[str, Callable] = {
    "contains": lambda a, b: string(b) in string(a), "starts-with": lambda a, b: string(a).startswith(string(b)), "normalize-space": lambda a: " ".join(string(a).split()), "string": string, "number": number, "boolean": boolean,
    "not": lambda a: not boolean(a), "count": lambda a: float(len(a)), "string-length": lambda a: float(len(string(a))), "concat": lambda *a: "".join(map(string, a)), "true": lambda: True, "false": lambda: False, "substring": _substring,
    "substring-before": lambda a, b: string(a).partition(string(b))[0] if string(b) in string(a) else "", "substring-after": lambda a, b: string(a).partition(string(b))[2],
    "translate": lambda s, a, b: string(s).translate({ord(c): string(b)[k] if k < len(string(b)) else None for k, c in reversed(list(enumerate(string(a))))}), "name": lambda a: (a[0].tag if isinstance(a[0], Element) else a[0].name or "") if a else "",
    "sum": lambda a: float(sum(number(text_of(n)) for n in a)),
}
OF_CONTEXT = frozenset(["string", "number", "normalize-space", "string-length", "name"])


def _ancestors(n) -> list:
    out = []
    while (n := n.parent) is not None and n.tag:
        out.append(n)
    return out


def _siblings(n, after: bool) -> list:
    if n.parent is None or isinstance(n, str) and n.name:
        return []
    every = n.parent.children
    return every[n.place + 1 :] if after else every[: n.place][::-1]


AXES: dict[str, Callable] = {
    "child": lambda n: n.children if isinstance(n, Element) else [], "descendant": descendants, "self": lambda n: [n], "descendant-or-self": lambda n: [n, *descendants(n)],
    "parent": lambda n: [n.parent] if n.parent is not None and n.parent.tag else [], "ancestor": _ancestors, "ancestor-or-self": lambda n: [n, *_ancestors(n)],
    "following-sibling": lambda n: _siblings(n, True), "preceding-sibling": lambda n: _siblings(n, False),
    "attribute": lambda n: [Text.of(v, n, (n.order, k), k) for k, v in reversed(n.attrs.items())] if isinstance(n, Element) else [],
}

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|\"([^\"]*)\"|'([^']*)'|(::|//|\.\.|!=|<=|>=|[/@.\[\]()|,=<>+*-])|([A-Za-z_][\w.-]*))")


class Compiler:
    """Recursive descent over the tokens; each rule returns a function of (node, position, size)."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"XPath {text!r} is not supported")
            kind = next(k for k in range(1, 6) if m[k] is not None)
            self.tokens.append((("number", "text", "text", "sign", "name")[kind - 1], m[kind]))
            at = m.end()
        self.at, self.whole = 0, text

    def peek(self, ahead: int = 0) -> str | None:
        k = self.at + ahead
        return self.tokens[k][1] if k < len(self.tokens) and self.tokens[k][0] in ("sign", "name") else None

    def take(self, *signs: str) -> str | None:
        if (found := self.peek()) in signs:
            self.at += 1
            return found
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ValueError(f"XPath {self.whole!r}: {sign!r} expected")

    def run(self):
        f = self.levels(0)
        if self.at < len(self.tokens):
            raise ValueError(f"XPath {self.whole!r} is not supported")
        return f

    LEVELS = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))

    def levels(self, k: int):
        if k == len(self.LEVELS):
            return self.union()
        f = self.levels(k + 1)
        while op := self.take(*self.LEVELS[k]):
            f = self.binary(op, f, self.levels(k + 1))
        return f

    @staticmethod
    def binary(op: str, f, g):
        if op == "or":
            return lambda *c: boolean(f(*c)) or boolean(g(*c))
        if op == "and":
            return lambda *c: boolean(f(*c)) and boolean(g(*c))
        if op in COMPARE:
            return lambda *c: compare(op, f(*c), g(*c))
        nan = float("nan")
        do = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "div": lambda a, b: a / b if b else nan, "mod": lambda a, b: a - b * int(a / b) if b and a == a and b == b else nan}[op]
        return lambda *c: do(number(f(*c)), number(g(*c)))

    def union(self):
        if self.take("-"):
            f = self.union()
            return lambda *c: -number(f(*c))
        parts = [self.path()]
        while self.take("|"):
            parts.append(self.path())
        return parts[0] if len(parts) == 1 else lambda *c: in_order([n for p in parts for n in p(*c)])

    def path(self):
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind == "number":
            self.at += 1
            return lambda *c: float(value)
        if kind == "text":
            self.at += 1
            return lambda *c: value
        start, steps = None, []
        if self.take("("):
            start = self.levels(0)
            self.need(")")
            steps.append((None, None, self.predicates()))
        elif kind == "name" and self.peek(1) == "(" and value not in ("text", "node"):
            start = self.call(value)
        elif self.peek() in ("/", "//"):
            start = root_of
            if self.take("//"):
                steps.append(("descendant-or-self", lambda n: True, []))
            else:
                self.take("/")
                if self.at == len(self.tokens) or self.tokens[self.at][0] != "name" and self.peek() not in ("*", ".", "..", "@"):
                    return start
            steps.append(self.step())
        else:
            steps.append(self.step())
        while sign := self.take("/", "//"):
            if sign == "//":
                steps.append(("descendant-or-self", lambda n: True, []))
            steps.append(self.step())
        return start if start and not any(a or p for a, _, p in steps) else along(start, steps)

    def call(self, name: str):
        self.at += 2
        arguments = []
        while not self.take(")"):
            if arguments:
                self.need(",")
            arguments.append(self.levels(0))
        if name in ("position", "last"):
            return (lambda n, p, s: float(p)) if name == "position" else (lambda n, p, s: float(s))
        if name not in FUNCTIONS:
            raise ValueError(f"XPath {self.whole!r}: no function {name!r}")
        f = FUNCTIONS[name]
        if not arguments and name in OF_CONTEXT:
            return lambda n, p, s: f([n])
        return lambda *c: f(*[a(*c) for a in arguments])

    def step(self):
        if self.take("."):
            return "self", lambda n: True, self.predicates()
        if self.take(".."):
            return "parent", lambda n: True, self.predicates()
        axis = "child"
        if self.take("@"):
            axis = "attribute"
        elif self.peek(1) == "::":
            axis = self.peek()
            self.at += 2
        if axis not in AXES:
            raise ValueError(f"XPath {self.whole!r}: no axis {axis!r}")
        name = self.peek()
        self.at += 1
        if name in ("text", "node") and self.take("("):
            self.need(")")
            test = (lambda n: isinstance(n, str) and n.name is None) if name == "text" else lambda n: True
        elif name == "*":
            test = (lambda n: True) if axis == "attribute" else lambda n: isinstance(n, Element)
        elif name and re.match(r"[A-Za-z_]", name):
            low = name.lower()
            test = (lambda n: n.name == low) if axis == "attribute" else lambda n: isinstance(n, Element) and n.tag == low
        else:
            raise ValueError(f"XPath {self.whole!r} is not supported")
        return axis, test, self.predicates()

    def predicates(self) -> list:
        out = []
        while self.take("["):
            out.append(self.levels(0))
            self.need("]")
        return out


def root_of(node, position=1, size=1) -> list:
    while node.parent is not None:
        node = node.parent
    return [node]


def in_order(nodes: list) -> list:
    """Distinct nodes in document order."""
    place = lambda n: (n.order, "") if not isinstance(n.order, tuple) else n.order
    found = {place(n): n for n in nodes}
    return [found[k] for k in sorted(found)]


def chosen(nodes: list, predicates: list) -> list:
    for p in predicates:
        size, kept = len(nodes), []
        for k, n in enumerate(nodes, 1):
            v = p(n, k, size)
            if v == k if isinstance(v, float) else boolean(v):
                kept.append(n)
        nodes = kept
    return nodes


def reached(nodes: list, axis: str) -> list:
    """What an axis without predicates reaches from several nodes in document order. Nested nodes share what is below or above them, so no node is visited twice."""
    seen, out = set(), []
    for at in nodes:
        if axis.startswith("ancestor"):
            n = at if axis == "ancestor-or-self" else at.parent
            while n is not None and (not isinstance(n, Element) or n.tag) and id(n) not in seen:
                seen.add(id(n))
                out.append(n)
                n = n.parent
        elif id(at) not in seen:
            for n in AXES[axis](at):
                if id(n) not in seen:
                    seen.add(id(n))
                    out.append(n)
    return out


def along(start, steps: list):
    def run(node, position=1, size=1):
        now = start(node, position, size) if start else [node]
        for axis, test, predicates in steps:
            if not isinstance(now, list):
                raise ValueError("a step from what is no node")
            if axis is None:
                now = chosen(now, predicates)
                continue
            if not predicates and axis.startswith(("ancestor", "descendant")):
                now = in_order([n for n in reached(now, axis) if test(n)])
                continue
            found = [n for at in now for n in chosen([x for x in AXES[axis](at) if test(x)], predicates)]
            now = in_order(found) if len(now) > 1 or axis in ("ancestor", "ancestor-or-self", "preceding-sibling") else found
        return now

    return run


def compiled(text: str):
    return Compiler(text).run()


def evaluate(expression, tree: Tree, kind: str = "text", attribute: str = "", most: int = 5) -> list[str]:
    """Up to ``most`` values, stripped, the empty ones left out: of nodes their text, markup or an attribute, of other results the result."""
    found = expression(tree.root, 1, 1)
    if not isinstance(found, list):
        found = [string(found)]
    values = []
    for n in found[:most]:
        if isinstance(n, str):
            values.append(str(n))
        else:
            values.append(text_of(n) if kind == "text" else markup_of(n) if kind == "html" else n.attrs.get(attribute, ""))
    return [v for v in (x.strip() for x in values) if v]
