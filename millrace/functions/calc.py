"""Arithmetic written as text -> Column.

Grammar, low to high: ``+ -``, ``* / %``, unary sign, ``^`` or ``**`` (right associative; ``-2^2`` is -4).
Names are columns, ``pi`` or ``e``. Numbers are doubles; ``7/2`` is 3.5. A zero divisor is an error at
run time under ANSI, or null with ``on_error='null'``. ``log(x)`` is base 10, ``log(x, b)`` any base.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError
from .cells import round_half_away
from .names import resolve

_TOKEN = re.compile(r"\s+|(?P<num>(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>\*\*|[-+*/%^(),×÷])|(?P<skip>[$€£¥])|(?P<bad>.)", re.S)
_ONE = {
    "sqrt": F.sqrt, "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "ln": F.ln, "log2": F.log2, "log10": F.log10, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan,
}
FUNCTIONS = [*_ONE, "log", "round", "pow", "min", "max", "sum", "avg"]


def _fail(message: str, hint: str = "Use numbers, columns, + - * / % ^, parentheses and functions") -> EngineError:
    return EngineError("calc_error", message, hint)


class _Reader:
    def __init__(self, text: str, columns: list[str], on_error: str):
        self.columns, self.null = columns, on_error == "null"
        self.items: list[tuple[str, str]] = []
        for m in _TOKEN.finditer(text):
            if m.lastgroup == "bad":
                raise _fail(f"unexpected character `{m[0]}`")
            if m.lastgroup in ("num", "name", "op"):
                op = {"**": "^", "×": "*", "÷": "/"}.get(m[0], m[0])
                self.items.append((m.lastgroup, op))
        if not self.items:
            raise _fail("empty expression")
        self.items.append(("end", ""))
        self.at = 0

    def take(self, *ops: str) -> str | None:
        kind, text = self.items[self.at]
        if kind == "op" and text in ops:
            self.at += 1
            return text
        return None

    def whole(self) -> Column:
        value = self.sum()
        kind, text = self.items[self.at]
        if kind != "end":
            raise _fail(f"unexpected `{text}`", "Remove group commas" if text == "," else "Check for a missing operator or parenthesis")
        return value

    def sum(self) -> Column:
        value = self.product()
        while op := self.take("+", "-"):
            right = self.product()
            value = value + right if op == "+" else value - right
        return value

    def product(self) -> Column:
        value = self.signed()
        while op := self.take("*", "/", "%"):
            right = self.signed()
            if op == "*":
                value = value * right
            elif op == "/":
                value = F.try_divide(value, right) if self.null else value / right
            else:
                value = F.try_mod(value, right) if self.null else value % right
        return value

    def signed(self) -> Column:
        if self.take("-"):
            return -self.signed()
        if self.take("+"):
            return self.signed()
        base = self.atom()
        return F.power(base, self.signed()) if self.take("^") else base

    def atom(self) -> Column:
        kind, text = self.items[self.at]
        self.at += 1
        if kind == "num":
            return F.lit(float(text.replace("_", "")))
        if (kind, text) == ("op", "("):
            value = self.sum()
            if not self.take(")"):
                raise _fail("missing `)`")
            return value
        if kind == "name":
            if self.take("("):
                return self.call(text.lower())
            if text.lower() in ("pi", "e") and text not in self.columns:
                return F.lit(math.pi if text.lower() == "pi" else math.e)
            return F.col(f"`{resolve(self.columns, text)}`").cast("double")
        raise _fail(f"unexpected `{text}`" if text else "expression ends too early")

    def call(self, name: str) -> Column:
        args: list[Column] = []
        if not self.take(")"):
            while True:
                args.append(self.sum())
                if self.take(")"):
                    break
                if not self.take(","):
                    raise _fail(f"bad arguments to {name}()")
        n = len(args)
        if name in _ONE and n == 1:
            return _ONE[name](args[0]).cast("double")
        if name == "log" and n in (1, 2):
            return F.log10(args[0]) if n == 1 else F.ln(args[0]) / F.ln(args[1])
        if name == "round" and n == 1:
            return round_half_away(args[0])
        if name == "round" and n == 2:
            p = F.power(F.lit(10.0), args[1])
            return round_half_away(args[0] * p) / p
        if name == "pow" and n == 2:
            return F.power(*args)
        if name in ("min", "max", "sum", "avg") and n:
            if name in ("min", "max"):
                return args[0] if n == 1 else (F.least if name == "min" else F.greatest)(*args)
            total = reduce(lambda a, b: a + b, args)
            return total if name == "sum" else total / n
        raise _fail(f"{name}() with {n} argument(s) is not known", "Functions: " + " ".join(FUNCTIONS))


def calc(text: str, columns: list[str] | None = None, on_error: str = "raise") -> Column:
    """The Column of an arithmetic text over ``columns``."""
    return _Reader(text, columns or [], on_error).whole()


def shown(x: Column) -> Column:
    """A result as text: whole numbers plain, else 12 decimals without trailing zeros; null for null."""
    fine = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", x), r"0+$", ""), r"\.$", "")
    return F.when((x == F.floor(x)) & (F.abs(x) < 9e15), x.cast("bigint").cast("string")).when(x.isNotNull(), fine)
