"""PromQL text to a syntax tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

AGGREGATIONS = {"sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "quantile", "topk", "bottomk", "count_values"}
#: Binary operators by how tightly they bind.
BINDING = {"or": 1, "and": 2, "unless": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "atan2": 5, "^": 7}
COMPARISONS = {"==", "!=", "<", "<=", ">", ">="}
SETS = {"and", "or", "unless"}
_UNIT = {"ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6, "w": 7 * 86400 * 10**6, "y": 365 * 86400 * 10**6}
_LEX = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)|(?P<duration>(?:\d+(?:ms|[smhdwy]))+(?![\w.]))|(?P<number>0x[0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][\w:.]*)|(?P<op>=~|!~|==|!=|<=|>=|[-+*/%^<>=(){}\[\],:@])""",
    re.S,
)


class PromqlError(ValueError):
    pass


@dataclass
class Number:
    value: float


@dataclass
class String:
    value: str


@dataclass
class Matcher:
    name: str
    op: str
    value: str


@dataclass
class Selector:
    name: str | None
    matchers: list[Matcher] = field(default_factory=list)
    range: int | None = None
    offset: int = 0
    at: int | str | None = None


@dataclass
class Subquery:
    expr: object
    range: int
    step: int | None
    offset: int = 0
    at: int | str | None = None


@dataclass
class Call:
    name: str
    args: list


@dataclass
class Aggregate:
    name: str
    expr: object
    param: object | None = None
    by: list[str] | None = None
    without: list[str] | None = None


@dataclass
class Unary:
    op: str
    expr: object


@dataclass
class Binary:
    op: str
    left: object
    right: object
    bool: bool = False
    on: list[str] | None = None
    ignoring: list[str] | None = None
    side: str | None = None
    include: list[str] = field(default_factory=list)


def duration(text: str) -> int:
    """Microseconds of '1h30m' and the like."""
    parts = re.findall(r"(\d+)(ms|[smhdwy])", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise PromqlError(f"not a duration: {text!r}")
    return sum(int(n) * _UNIT[u] for n, u in parts)


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise PromqlError(f"unexpected character {text[at]!r} at {at}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ("end", "")

    def next(self, *want: str) -> str:
        kind, text = self.peek()
        if want and text not in want and kind not in want:
            raise PromqlError(f"expected {' or '.join(want)}, found {text or 'the end'!r}")
        self.at += 1
        return text

    def parse(self):
        if not self.tokens:
            raise PromqlError("no expression found in input")
        out = self.expr(0)
        if self.peek()[0] != "end":
            raise PromqlError(f"unexpected {self.peek()[1]!r}")
        return out

    def expr(self, least: int):
        left = self.unary()
        while (op := self.peek()[1].lower()) in BINDING and self.peek()[0] in ("op", "name") and BINDING[op] >= least:
            self.at += 1
            node = Binary(op, left, None)
            if self.peek()[1] == "bool":
                self.at += 1
                if op not in COMPARISONS:
                    raise PromqlError("bool modifier can only be used on comparison operators")
                node.bool = True
            if self.peek()[1] in ("on", "ignoring"):
                setattr(node, self.next(), self.names())
                if self.peek()[1] in ("group_left", "group_right"):
                    node.side = self.next()
                    node.include = self.names() if self.peek()[1] == "(" else []
            node.right = self.expr(BINDING[op] + (op != "^"))
            left = node
        return left

    def names(self) -> list[str]:
        self.next("(")
        out = []
        while self.peek()[1] != ")":
            out.append(self.next("name"))
            if self.peek()[1] == ",":
                self.at += 1
        self.next(")")
        return out

    def unary(self):
        if self.peek()[1] in ("-", "+") and self.peek()[0] == "op":
            op = self.next()
            return Unary(op, self.expr(6))
        return self.postfix(self.atom())

    def postfix(self, node):
        while True:
            text = self.peek()[1]
            if text == "[":
                self.at += 1
                wide = duration(self.next("duration"))
                if self.peek()[1] == ":":
                    self.at += 1
                    step = duration(self.next("duration")) if self.peek()[1] != "]" else None
                    node = Subquery(node, wide, step)
                elif isinstance(node, Selector):
                    node.range = wide
                else:
                    raise PromqlError("a range needs a vector selector")
                self.next("]")
            elif text == "offset" and isinstance(node, Selector | Subquery):
                self.at += 1
                sign = -1 if self.peek()[1] == "-" and self.next() else 1
                node.offset = sign * duration(self.next("duration"))
            elif text == "@" and isinstance(node, Selector | Subquery):
                self.at += 1
                word = self.next()
                if word in ("start", "end"):
                    self.next("(")
                    self.next(")")
                    node.at = word
                else:
                    node.at = int(float(word) * 1e6)
            else:
                return node

    def atom(self):
        kind, text = self.peek()
        if kind == "number":
            self.at += 1
            return Number(float(int(text, 16)) if text.startswith("0x") else float(text))
        if kind == "string":
            self.at += 1
            return String(_unquote(text))
        if text == "(":
            self.at += 1
            out = self.expr(0)
            self.next(")")
            return out
        if text == "{":
            return self.selector(None)
        if kind != "name":
            raise PromqlError(f"unexpected {text or 'the end'!r}")
        if text.lower() in ("inf", "nan"):
            self.at += 1
            return Number(float(text))
        follows = self.peek(1)[1]
        if text in AGGREGATIONS and follows in ("(", "by", "without"):
            return self.aggregate()
        self.at += 1
        if follows == "(":
            self.at += 1
            args = []
            while self.peek()[1] != ")":
                args.append(self.expr(0))
                if self.peek()[1] == ",":
                    self.at += 1
            self.next(")")
            return Call(text, args)
        return self.selector(text)

    def selector(self, name: str | None) -> Selector:
        out = Selector(name)
        if self.peek()[1] == "{":
            self.at += 1
            while self.peek()[1] != "}":
                label = self.next("name")
                op = self.next("=", "!=", "=~", "!~")
                value = _unquote(self.next("string"))
                if label == "__name__" and op == "=":
                    out.name = value
                else:
                    out.matchers.append(Matcher(label, op, value))
                if self.peek()[1] == ",":
                    self.at += 1
            self.next("}")
        if not out.name and not out.matchers:
            raise PromqlError("a vector selector needs a name or a matcher")
        return out

    def aggregate(self) -> Aggregate:
        out = Aggregate(self.next(), None)
        if self.peek()[1] in ("by", "without"):
            setattr(out, self.next(), self.names())
        self.next("(")
        args = [self.expr(0)]
        while self.peek()[1] == ",":
            self.at += 1
            args.append(self.expr(0))
        self.next(")")
        if self.peek()[1] in ("by", "without"):
            setattr(out, self.next(), self.names())
        needs = out.name in ("quantile", "topk", "bottomk", "count_values")
        if len(args) != 1 + needs:
            raise PromqlError(f"{out.name} takes {1 + needs} argument(s)")
        out.expr = args[-1]
        out.param = args[0] if needs else None
        return out


def _unquote(text: str) -> str:
    if text[0] == "`":
        return text[1:-1]
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1])


def parse(text: str):
    return Parser(text).parse()


def _span(us: int) -> str:
    out = ""
    for unit, size in (("d", _UNIT["d"]), ("h", _UNIT["h"]), ("m", _UNIT["m"]), ("s", _UNIT["s"]), ("ms", 1000)):
        n, us = divmod(us, size)
        out += f"{n}{unit}" if n else ""
    return out or "0s"


def _string(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def show(node) -> str:
    """A tree as PromQL text, in one spelling."""
    if isinstance(node, Number):
        return "Inf" if node.value == float("inf") else f"{node.value:g}" if node.value == node.value else "NaN"
    if isinstance(node, String):
        return _string(node.value)
    if isinstance(node, Selector | Subquery):
        if isinstance(node, Selector):
            inner = ",".join(f"{m.name}{m.op}{_string(m.value)}" for m in node.matchers)
            text = (node.name or "") + (f"{{{inner}}}" if inner else "") + (f"[{_span(node.range)}]" if node.range else "")
        else:
            text = f"{show(node.expr)}[{_span(node.range)}:{_span(node.step) if node.step else ''}]"
        if node.at is not None:
            text += f" @ {node.at}()" if isinstance(node.at, str) else f" @ {node.at / 1e6:.3f}"
        return text + (f" offset {'-' if node.offset < 0 else ''}{_span(abs(node.offset))}" if node.offset else "")
    if isinstance(node, Call):
        return f"{node.name}({', '.join(map(show, node.args))})"
    if isinstance(node, Aggregate):
        mod = f" by ({', '.join(node.by)}) " if node.by is not None else f" without ({', '.join(node.without)}) " if node.without is not None else ""
        return f"{node.name}{mod}({show(node.param) + ', ' if node.param is not None else ''}{show(node.expr)})"
    if isinstance(node, Unary):
        return node.op + show(node.expr)
    mod = " bool" if node.bool else ""
    if node.on is not None or node.ignoring is not None:
        mod += f" on ({', '.join(node.on)})" if node.on is not None else f" ignoring ({', '.join(node.ignoring)})"
        mod += f" {node.side} ({', '.join(node.include)})" if node.side else ""
    wrap = lambda x: f"({show(x)})" if isinstance(x, Binary) and BINDING[x.op] < BINDING[node.op] else show(x)
    return f"{wrap(node.left)} {node.op}{mod} {wrap(node.right)}"
