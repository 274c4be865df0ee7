"""Two small languages compiled to columns: the findings filter and the value verifier."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    """A filter that cannot be read or whose types do not fit."""


_TOKEN = re.compile(r"""\s*(?:(?P<op>\|\||&&|==|!=|!|\(|\))|"(?P<dq>(?:[^"\\]|\\.)*)"|'(?P<sq>(?:[^'\\]|\\.)*)'|(?P<num>\d+)|(?P<word>[A-Za-z_][A-Za-z_0-9]*))""")
_TEXT = ("rule_id", "severity", "path", "matched", "context", "verification")
_NUMBER = ("line", "column")


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(source.rstrip()):
        m = _TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at}: {source[at:at + 10]!r}")
        kind = m.lastgroup or ""
        value = m.group(kind)
        out.append(("str", re.sub(r"\\(.)", r"\1", value)) if kind in ("dq", "sq") else (kind, value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if (kind and got[0] != kind) or (value and got[1] != value):
            raise ExpressionError(f"expected {value or kind}, found {got[1] or 'the end'}")
        self.at += 1
        return got

    def whole(self) -> Column:
        out = self.either()
        if self.peek()[0] != "end":
            raise ExpressionError(f"unexpected {self.peek()[1]!r}")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.peek() == ("op", "||"):
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.single()
        while self.peek() == ("op", "&&"):
            self.take()
            out = out & self.single()
        return out

    def single(self) -> Column:
        if self.peek() == ("op", "!"):
            self.take()
            return ~self.single()
        if self.peek() == ("op", "("):
            self.take()
            out = self.either()
            self.take("op", ")")
            return out
        return self.comparison()

    def operand(self) -> tuple[str, Column]:
        kind, value = self.take()
        if kind == "str":
            return "text", F.lit(value)
        if kind == "num":
            return "number", F.lit(int(value))
        if kind == "word" and value in _TEXT:
            return "text", F.coalesce(F.col(value), F.lit("none")) if value == "verification" else F.col(value)
        if kind == "word" and value in _NUMBER:
            return "number", F.col(value)
        raise ExpressionError(f"unknown field {value!r}")

    def comparison(self) -> Column:
        kind, left = self.operand()
        op = self.peek()
        if op in (("op", "=="), ("op", "!=")):
            self.take()
            other, right = self.operand()
            same = left == right if kind == other else F.lit(False)
            return same if op[1] == "==" else ~same
        if op in (("word", "contains"), ("word", "matches")):
            self.take()
            other, right = self.take()[0], self.tokens[self.at - 1][1]
            if kind != "text" or other != "str":
                raise ExpressionError(f"{op[1]} needs text on both sides")
            return left.contains(right) if op[1] == "contains" else left.rlike(right)
        return left != "" if kind == "text" else left != 0


def compile_filter(source: str) -> Column:
    """A boolean column from `severity == "high" && !(path contains "test")` and the like."""
    return _Parser(source).whole()


def compile_verifier(source: str, value: str = "matched") -> Column:
    """`length >= 20`, `has_prefix AKIA`, `has_suffix ==`, `matches ^x`, `true`; anything else is false. Lengths are bytes."""
    v, s = F.col(value), source.strip()
    if m := re.fullmatch(r"length\s*(>=|>|<)\s*(\d+)", s):
        size, n = F.octet_length(v), int(m[2])
        return {">=": size >= n, ">": size > n, "<": size < n}[m[1]]
    word, _, rest = s.partition(" ")
    rest = rest.strip().strip("\"'")
    if word in ("has_prefix", "has_suffix", "matches") and rest:
        return {"has_prefix": v.startswith(rest), "has_suffix": v.endswith(rest), "matches": v.rlike(rest)}[word]
    return F.lit(s == "true")
