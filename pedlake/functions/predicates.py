"""Range and expression predicates as columns.

Ranges: ``[a,b] (a,b) [a,b) >a >=a <a <=a a~b a``. Expressions: ``+ - * / ^``, ``and or & |``, comparisons, square
or round brackets, ``true false NA``, numbers with K, M, G, and variables. Precedence from low to high:
or, and, comparison, sum, product, power. A missing operand makes the result null (SQL's three-valued
logic), which drops no row unless asked to.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = {"k": 1e3, "m": 1e6, "g": 1e9}
_RANGE = re.compile(r"^\s*([\[(])\s*([^,\s]*)\s*,\s*([^,\s]*)\s*([\])])\s*$")
_SIGN = re.compile(r"^\s*(>=|<=|=>|=<|>|<|==|=)\s*(\S+)\s*$")


def number(text: str) -> float:
    unit = _UNIT.get(text[-1:].lower())
    return float(text[:-1]) * unit if unit else float(text)


def in_range(col: Column, text: str) -> Column:
    """The predicate of one range; open ends are written as an empty bound."""
    m = _RANGE.match(text)
    if m:
        out = F.lit(True)
        if m[2]:
            out = out & (col >= number(m[2]) if m[1] == "[" else col > number(m[2]))
        if m[3]:
            out = out & (col <= number(m[3]) if m[4] == "]" else col < number(m[3]))
        return out
    m = _SIGN.match(text)
    if m:
        v = number(m[2])
        return {">=": col >= v, "=>": col >= v, "<=": col <= v, "=<": col <= v, ">": col > v, "<": col < v, "=": col == v, "==": col == v}[m[1]]
    if "~" in text:
        a, b = text.split("~", 1)
        return col.between(number(a.strip()), number(b.strip()))
    return col == number(text.strip())


def in_ranges(col: Column, texts: list[str], every: bool = False) -> Column:
    """Any (or every) of several ranges."""
    out = F.lit(every)
    for t in texts:
        out = out & in_range(col, t) if every else out | in_range(col, t)
    return out


_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?[KMGkmg]?\b|\.\d+)|(?P<str>'[^']*')|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>==|!=|<=|>=|=<|=>|&&|\|\||[-+*/^<>=&|\[\]()]))")
_LEVELS = [{"or", "|", "||"}, {"and", "&", "&&"}, {"==", "=", "!=", "<", "<=", "=<", ">", ">=", "=>"}, {"+", "-"}, {"*", "/"}]


class _Parser:
    def __init__(self, text: str, variable: Callable[[str], Column]):
        self.items, self.at, self.variable = [], 0, variable
        i = 0
        while text[i:].strip():
            m = _TOKEN.match(text, i)
            if not m:
                raise ValueError(f"not an expression at {i}: {text[i : i + 20]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            i = m.end()

    def peek(self) -> str:
        return self.items[self.at][1].lower() if self.at < len(self.items) else ""

    def level(self, n: int) -> Column:
        if n == len(_LEVELS):
            return self.power()
        left = self.level(n + 1)
        while self.peek() in _LEVELS[n]:
            op = self.peek()
            self.at += 1
            right = self.level(n + 1)
            left = {
                "or": lambda a, b: a | b, "and": lambda a, b: a & b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
                ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / F.nullif(b, F.lit(0.0)),
            }[{"|": "or", "||": "or", "&": "and", "&&": "and", "=": "==", "=<": "<=", "=>": ">="}.get(op, op)](left, right)
        return left

    def power(self) -> Column:
        base = self.atom()
        if self.peek() == "^":
            self.at += 1
            return F.pow(base, self.power())
        return base

    def atom(self) -> Column:
        if self.at >= len(self.items):
            raise ValueError("the expression ends too early")
        kind, text = self.items[self.at]
        self.at += 1
        if text in "[(":
            inner = self.level(0)
            if self.peek() != {"[": "]", "(": ")"}[text]:
                raise ValueError(f"{text} isn't closed")
            self.at += 1
            return inner
        if kind == "op" and text == "-":
            return -self.atom()
        if kind == "num":
            return F.lit(number(text))
        if kind == "str":
            return F.lit(text[1:-1])
        if kind == "name" and text.lower() in ("true", "false", "na"):
            return F.lit({"true": True, "false": False, "na": None}[text.lower()])
        if kind == "name":
            return self.variable(text)
        raise ValueError(f"unexpected {text!r}")


def expression(text: str, variable: Callable[[str], Column] = F.col) -> Column:
    """The column of an expression; ``variable`` gives the column of a name, e.g. of an INFO entry."""
    p = _Parser(text, variable)
    out = p.level(0)
    if p.at < len(p.items):
        raise ValueError(f"unexpected {p.items[p.at][1]!r}")
    return out


def info(name: str, column: str = "info") -> Column:
    """A number of a map column, null where it isn't one."""
    return F.try_element_at(column, F.lit(name)).try_cast("double")
