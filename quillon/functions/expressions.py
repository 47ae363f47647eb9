"""The expression language of event queries, parsed to Columns.

C precedence; ``=`` and ``==``, ``!=`` and ``<>`` are the same; ``>>`` and ``<<`` on strings test for a substring; ``x IN (..)`` takes
constants; ``@f(x)`` calls a function. Integer division truncates and yields null by zero.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>'[^']*'|"[^"]*")|(?P<fun>@[a-z_]+\d*)|(?P<name>[A-Za-z_]\w*)|(?P<op>\|\||&&|<<|>>|<=|>=|!=|<>|==|[-!~+*/%<>=|^&(),\[\]*]))""")
_LEVELS = [("||",), ("&&",), ("|",), ("^",), ("&",), ("=", "==", "!=", "<>"), ("<", "<=", ">", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%")]
_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


class Typed(NamedTuple):
    """A Column and its kind: int, float, str or bool."""

    column: Column
    kind: str


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:at + 10]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


def truth(x: Typed) -> Column:
    return x.column if x.kind == "bool" else x.column != 0


def number(x: Typed) -> Typed:
    if x.kind == "str":
        raise ValueError("a number is needed")
    return Typed(x.column.cast("int"), "int") if x.kind == "bool" else x


def simplify(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def full_simplify(c: Column) -> Column:
    return F.translate(simplify(c), *_ACCENTS)


FUNCTIONS: dict[str, Callable[[Typed], Typed]] = {
    "@int": lambda x: Typed(x.column.cast("int"), "int"),
    "@long": lambda x: Typed(x.column.cast("bigint"), "int"),
    "@double": lambda x: Typed(x.column.cast("double"), "float"),
    "@string": lambda x: Typed(x.column.cast("string"), "str"),
    "@length": lambda x: Typed(F.length(x.column), "int"),
    "@tolower": lambda x: Typed(F.lower(x.column), "str"),
    "@toupper": lambda x: Typed(F.upper(x.column), "str"),
    "@deunicode": lambda x: Typed(F.translate(x.column, *_ACCENTS), "str"),
    "@simplify": lambda x: Typed(simplify(x.column), "str"),
    "@full_simplify": lambda x: Typed(full_simplify(x.column), "str"),
    "@sort": lambda x: Typed(F.array_join(F.array_sort(F.split(x.column, "")), ""), "str"),
    "@bit_count": lambda x: Typed(F.bit_count(x.column), "int"),
}


class Parser:
    def __init__(self, text: str | list[str], fields: Mapping[str, Typed], functions: Mapping[str, Callable[[Typed], Typed]] | None = None):
        self.t = tokens(text) if isinstance(text, str) else text
        self.i, self.fields, self.functions = 0, fields, FUNCTIONS | dict(functions or {})
        self.used: list[str] = []

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or want and got != want:
            raise ValueError(f"{want or 'more'} is needed before {got!r}")
        self.i += 1
        return got

    def expression(self, level: int = 0) -> Typed:
        if level == len(_LEVELS):
            return self.unary()
        left = self.expression(level + 1)
        while self.peek() in _LEVELS[level] or level == 6 and self.peek().upper() == "IN":
            op = self.take()
            if op.upper() == "IN":
                self.take("(")
                values = []
                while self.peek() != ")":
                    sign = -1 if self.peek() == "-" and self.take() else 1
                    v = self.take()
                    values.append(v[1:-1] if v[0] in "'\"" else sign * (float(v) if "." in v else int(v)))
                    if self.peek() == ",":
                        self.take()
                self.take(")")
                left = Typed(left.column.isin(values), "bool")
            else:
                left = self.binary(op, left, self.expression(level + 1))
        return left

    def binary(self, op: str, a: Typed, b: Typed) -> Typed:
        if op in ("||", "&&"):
            x, y = truth(a), truth(b)
            return Typed(x | y if op == "||" else x & y, "bool")
        if op in ("<<", ">>") and a.kind == b.kind == "str":
            return Typed(F.contains(a.column, b.column) if op == ">>" else F.contains(b.column, a.column), "bool")
        if op in ("=", "==", "!=", "<>", "<", "<=", ">", ">="):
            if (a.kind == "str") != (b.kind == "str"):
                raise ValueError("a string isn't compared with a number")
            if a.kind != "str":
                a, b = number(a), number(b)
            x, y = a.column, b.column
            return Typed({"=": x == y, "==": x == y, "!=": x != y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")
        a, b = number(a), number(b)
        whole = a.kind == b.kind == "int"
        x, y = a.column, b.column
        if op in ("%", "|", "&", "^", "<<", ">>") and not whole:
            raise ValueError(f"{op} takes integers")
        if op == "/":
            return Typed(F.when(y != 0, F.call_function("div", x, y) if whole else x / y), "int" if whole else "float")
        if op == "%":
            return Typed(F.when(y != 0, x % y), "int")
        if op in ("<<", ">>"):
            return Typed(F.call_function("shiftleft" if op == "<<" else "shiftright", x.cast("bigint"), y.cast("int")), "int")
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "|": lambda: x.bitwiseOR(y), "&": lambda: x.bitwiseAND(y), "^": lambda: x.bitwiseXOR(y)}[op]()
        return Typed(out, "int" if whole else "float")

    def unary(self) -> Typed:
        t = self.take()
        if t == "!":
            return Typed(~truth(self.unary()), "bool")
        if t == "~":
            return Typed(F.bitwise_not(number(self.unary()).column), "int")
        if t == "-":
            x = number(self.unary())
            return Typed(-x.column, x.kind)
        if t == "(":
            x = self.expression()
            self.take(")")
            return x
        if t[0] == "@":
            if t == "@now":
                if self.peek() == "(":
                    self.take("(")
                    self.take(")")
                return Typed(F.unix_timestamp(), "int")
            if t not in self.functions:
                raise ValueError(f"no function {t}")
            self.take("(")
            x = self.expression()
            self.take(")")
            return self.functions[t](x)
        if t[0] in "'\"":
            return Typed(F.lit(t[1:-1]), "str")
        if t[0].isdigit():
            return Typed(F.lit(float(t)), "float") if "." in t else Typed(F.lit(int(t)), "int")
        if t not in self.fields:
            raise ValueError(f"no field {t}")
        self.used.append(t)
        return self.fields[t]


def fields_of(df) -> dict[str, Typed]:
    kinds = {"string": "str", "double": "float", "float": "float", "int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "boolean": "bool"}
    return {c: Typed(F.col(c), kinds[k]) for c, k in df.dtypes if k in kinds}


def compiled(df, text: str) -> Typed:
    """The whole text as one expression over the columns of df."""
    p = Parser(text, fields_of(df))
    x = p.expression()
    if p.peek():
        raise ValueError(f"unexpected {p.peek()!r}")
    return x
