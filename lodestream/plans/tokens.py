"""SQL text as tokens, and edits on them that keep everything else as it was written."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from ..functions.patterns import quoted

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_@$][\w@$]*)|(?P<op><=|>=|<>|!=|\|\||::|->>|->|!~\*|!~|~\*|.)""",
    re.S,
)


@dataclass
class Token:
    kind: str
    text: str

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text if self.kind == "op" else ""

    @property
    def value(self) -> str:
        """What a string or a name stands for."""
        if self.kind == "string":
            return self.text[1:-1].replace("''", "'")
        return self.text[1:-1].replace('""', '"') if self.kind == "quoted" else self.text


def tokens(sql: str) -> list[Token]:
    """Tokens without white space and comments. A string that is never closed is an error."""
    out = [Token(m.lastgroup, m.group()) for m in _TOKEN.finditer(sql) if m.lastgroup != "space"]
    if any(t.text in "'\"`" and t.kind == "op" for t in out):
        raise ValueError("unbalanced quotes")
    depth = 0
    for t in out:
        depth += (t.text == "(") - (t.text == ")")
        if depth < 0:
            break
    if depth:
        raise ValueError("unbalanced parentheses")
    return out


def render(parts: list[Token]) -> str:
    """Spark's spelling: backslashes in strings are only themselves, names are quoted by backticks."""
    sql, before = "", ""
    for t in parts:
        text = t.text
        if t.kind == "string":
            text = quoted(t.value)
        elif t.kind == "quoted" and text[0] == '"':
            text = f"`{t.value}`"
        called = text == "(" and before and (before[-1].isalnum() or before[-1] in "_`") and before.upper() not in KEYWORDS
        glue = not sql or called or text in (",", ")", ".", "]", "::") or before in ("(", ".", "[", "::")
        sql += text if glue else " " + text
        before = text
    return sql


KEYWORDS = {"AND", "OR", "NOT", "IN", "FROM", "WHERE", "SELECT", "ON", "AS", "BY", "WHEN", "THEN", "ELSE", "OVER", "UNION", "ALL", "EXISTS", "VALUES", "JOIN", "HAVING", "GROUP", "LIKE", "USING", "DISTINCT", "FILTER", "EXCEPT", "INTERSECT", "BETWEEN", "INTERVAL", "WITH", "CASE", "ANY"}


def close(parts: list[Token], at: int) -> int:
    """The place of the parenthesis (or bracket) that closes the one at this place."""
    depth = 0
    for k in range(at, len(parts)):
        depth += (parts[k].text in "([") - (parts[k].text in ")]") if parts[k].kind == "op" else 0
        if depth == 0:
            return k
    raise ValueError("unbalanced parentheses")


def split(parts: list[Token], sign: str = ",") -> list[list[Token]]:
    """Cut at a sign or keyword outside of all parentheses."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in parts:
        depth += (t.text in "([") - (t.text in ")]") if t.kind == "op" else 0
        if depth == 0 and t.word == sign:
            out.append([])
        else:
            out[-1].append(t)
    return out if out != [[]] else []


def done(sql: str) -> list[Token]:
    """A piece of finished Spark SQL."""
    return [Token("done", sql)]


def rewrite_calls(parts: list[Token], rules: dict[str, Callable[[list[list[Token]]], list[Token] | None]]) -> list[Token]:
    """Each call whose lower-case name has a rule becomes what the rule makes of its arguments
    (which are rewritten first); a rule may return None to leave the call alone."""
    out: list[Token] = []
    k = 0
    while k < len(parts):
        t = parts[k]
        called = k + 1 < len(parts) and parts[k + 1].text == "(" and t.kind in ("name", "quoted")
        if called and not (out and out[-1].text == "."):
            end = close(parts, k + 1)
            inner = rewrite_calls(parts[k + 2 : end], rules)
            made = rules[t.value.lower()](split(inner)) if t.value.lower() in rules else None
            out += made if made is not None else [t, parts[k + 1], *inner, parts[end]]
            k = end + 1
        else:
            out.append(t)
            k += 1
    return out
