"""Queries over loosely typed tables: where -> group and aggregate -> sort -> select -> limit.

Texts are compared as numbers, else as dates, else as lower-case text, decided by the literal, which is
typed once on the driver. The whole query is one DataFrame; sorting by a text column takes one
aggregate pass that decides how its cells compare. Blank cells: ``!=`` is true for them,
aggregates skip them, sorting puts cells that do not fit last in both directions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions import cells
from ..functions.names import clean_headers, resolve

#: The row number in a file, as sources give it; rows that are shown if no limit is asked for.
ORD, SHOWN = "_ord", 20
_WORDS = (" not contains ", " contains ", " startswith ", " starts with ")
_SYMBOL = re.compile(r"<=|>=|!=|<>|==|<|>|=|!")
_SAME = {"<>": "!=", "==": "="}


def parse_where(text: str) -> tuple[str, str, str]:
    """(column, operator, literal) of ``COLUMN OP VALUE``."""
    e = text.strip()
    for word in _WORDS:
        m = re.search(re.escape(word), e, re.I)
        if m:
            if "not" in word:
                raise EngineError("bad_where", f"`{e}`: `not contains` is not supported")
            op, left, right = word.replace(" ", ""), e[: m.start()], e[m.end() :]
            break
    else:
        m = _SYMBOL.search(e)
        if not m:
            raise EngineError("bad_where", f"`{e}` has no operator", "e.g. Price <= 20 or Name contains pro")
        if m[0] == "!":
            raise EngineError("bad_where", f"`{e}`: `!` must be followed by `=`")
        op, left, right = _SAME.get(m[0], m[0]), e[: m.start()], e[m.end() :]
    name, value = left.strip().strip("\"'`"), right.strip()
    quoted = len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'"
    value = value[1:-1] if quoted else value
    if not name:
        raise EngineError("bad_where", f"`{e}` is missing the column name")
    if not value and not quoted:
        raise EngineError("bad_where", f"`{e}` is missing a value")
    return name, op, value


def _compare(op: str, a: Column, b) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def predicate(df: DataFrame, text: str) -> Column:
    """The filter of one ``COLUMN OP VALUE``; never null."""
    name, op, value = parse_where(text)
    column = resolve(df.columns, name)
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    words = F.coalesce(cells.text_of(c, kind), F.lit(""))
    if op == "contains":
        return F.lower(words).contains(value.lower())
    if op == "startswith":
        return F.lower(words).startswith(value.lower())
    plain = _compare(op, F.lower(F.trim(words)), value.strip().lower())
    ordering = op in ("<", "<=", ">", ">=")
    day = cells.literal_date(value)
    if day is not None:
        d = cells.cell_date(c, kind)
        plain = F.when(d.isNotNull(), _compare(op, d, day)).otherwise(F.lit(False) if ordering else plain)
    number = cells.literal_number(value)
    if number is not None:
        if isinstance(kind, T.NumericType):  # a plain comparison reaches the scan
            return F.coalesce(_compare(op, c, F.lit(number)), F.lit(op == "!="))
        n = cells.cell_num(c, kind)
        plain = F.when(n.isNotNull(), _compare(op, n, number)).otherwise(F.lit(False) if ordering else plain)
    return F.coalesce(plain, F.lit(False))


def parse_aggregate(text: str) -> tuple[str, str | None]:
    """(function, column or None) of ``func:Column`` or ``count``."""
    func, _, name = text.strip().partition(":")
    func = func.strip().lower()
    if func not in ("count", "sum", "avg", "min", "max") or (func != "count" and not name.strip()):
        raise EngineError("bad_agg", f"`{text}` is no aggregate", "use count, count:C, sum:C, avg:C, min:C or max:C")
    return func, name.strip() or None


def aggregate(df: DataFrame, text: str) -> tuple[str, Column]:
    """(name, Column) of an aggregate over the numeric or non-blank cells of a column."""
    func, name = parse_aggregate(text)
    if name is None:
        return "count", F.count(F.lit(1))
    column = resolve(df.columns, name)
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    n = cells.cell_num(c, kind)
    made = {
        "count": lambda: F.count(F.when(~cells.is_blank(cells.text_of(c, kind)), 1)), "sum": lambda: F.coalesce(F.sum(n), F.lit(0.0)),
        "avg": lambda: F.avg(n), "min": lambda: F.min(n), "max": lambda: F.max(n),
    }[func]()
    return f"{func}_{column}", made


def parse_sort(text: str) -> list[tuple[str, bool]]:
    """(column, descending) of each key of ``-A, B desc, +C``."""
    keys = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.match(r"^(.*?)\s+(asc|desc)$", part, re.I)
        name, down = (m[1], m[2].lower() == "desc") if m else (part, False)
        if name[:1] in "+-":
            name, down = name[1:], name[0] == "-"
        keys.append((name.strip(), down))
    return keys


def sort_keys(df: DataFrame, keys: list[tuple[str, bool]], tie: list[str] | None = None) -> list[Column]:
    """orderBy keys. A text column sorts by number if half of its non-blank cells are numbers, else by
    date if half are dates, else by lower-case text; one pass over the data decides for all keys."""
    found = [(resolve(df.columns, name), down) for name, down in keys]
    texts = [c for c, _ in found if isinstance(df.schema[c].dataType, T.StringType)]
    stats = {}
    if texts:
        counts = []
        for c in dict.fromkeys(texts):
            x = F.col(f"`{c}`")
            counts += [F.count(F.when(~cells.is_blank(x), 1)).alias(f"s {c}"), F.count(cells.cell_num(x)).alias(f"n {c}"), F.count(F.when(~cells.is_blank(x), cells.cell_date(x))).alias(f"d {c}")]
        stats = df.agg(*counts).first().asDict()
    out = []
    for name, down in found:
        kind, c = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, T.StringType):
            seen, nums, days = stats[f"s {name}"], stats[f"n {name}"], stats[f"d {name}"]
            key = cells.cell_num(c) if seen and nums * 2 >= seen else cells.cell_date(c) if seen and days * 2 >= seen else F.when(~cells.is_blank(c), F.lower(c))
        else:
            key = c
        out += [key.isNull().asc(), key.desc() if down else key.asc()]
    return out + [F.col(f"`{t}`").asc_nulls_last() for t in tie or []]


@dataclass
class TableQuery:
    """where: conditions that must all hold; group_by: one column; agg, sort, select: as texts; limit."""

    where: list[str] = field(default_factory=list)
    group_by: str | None = None
    agg: list[str] = field(default_factory=list)
    sort: str | None = None
    select: str | None = None
    limit: int | None = None
    #: columns that break ties of the sort, as rows of a DataFrame have no order of their own
    tie: list[str] = field(default_factory=list)

    def run(self, df: DataFrame) -> DataFrame:
        if self.where:
            df = df.where(reduce(lambda a, b: a & b, [predicate(df, w) for w in self.where]))
        if self.group_by or self.agg:
            made = [aggregate(df, a) for a in self.agg] or [aggregate(df, "count")]
            if self.group_by:
                key = resolve(df.columns, self.group_by)
                named = clean_headers([key, *[n for n, _ in made]])
                keyed = F.trim(F.coalesce(cells.text_of(F.col(f"`{key}`"), df.schema[key].dataType), F.lit("")))
                first = [F.min(ORD).alias("__first")] if ORD in df.columns and not self.sort else []
                df = df.groupBy(keyed.alias(named[0])).agg(*[c.alias(n) for n, (_, c) in zip(named[1:], made)], *first)
                if first:  # rows that are numbered in their file give groups in order of first appearance
                    df = df.orderBy("__first").drop("__first")
            else:
                df = df.agg(*[c.alias(n) for n, (_, c) in zip(clean_headers([n for n, _ in made]), made)])
        if self.sort:
            df = df.orderBy(*sort_keys(df, parse_sort(self.sort), [t for t in self.tie if t in df.columns]))
        if self.select:
            picked = [resolve(df.columns, n) for n in self.select.split(",") if n.strip()]
            df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(picked, clean_headers(picked))])
        return df.limit(self.limit) if self.limit is not None else df

    def counts(self, df: DataFrame, shown: int = SHOWN) -> DataFrame:
        """One row (total, returned, truncated): rows of the result, rows that are shown, and whether some are not."""
        most = self.limit if self.limit is not None else shown
        total = replace(self, limit=None, sort=None).run(df).agg(F.count(F.lit(1)).alias("total"))
        return total.select("total", F.least("total", F.lit(most)).cast("bigint").alias("returned"), (F.col("total") > most).alias("truncated"))
