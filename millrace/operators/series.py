"""Price series: bars, quotes, summaries. Dates are ISO texts; the first date wins ties of high and low."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import round_half_away


def symbols(text: Column) -> Column:
    """Distinct upper-case symbols of a text parted by commas, semicolons or spaces, in their order."""
    return F.array_distinct(F.filter(F.split(F.upper(text), r"[,;\s]+"), lambda x: x != ""))


#: Names of indices and endings of exchanges in the other notation.
INDICES = {"gspc": "spx", "ixic": "ndq", "n225": "nkx", "ftse": "ukx", "gdaxi": "dax"}
EXCHANGES = {"t": "jp", "l": "uk", "de": "de", "f": "de", "us": "us"}


def exchange_symbol(symbol: Column) -> Column:
    """The symbol in the notation with lower-case exchange endings; null for Taiwan, which has none there.
    Indices and endings are mapped, leading zeros of Hong Kong codes dropped, currency pairs joined; a
    one-letter ending is a share class of a US listing, and no ending is the US."""
    s = F.lower(F.trim(symbol))
    lookup = lambda d, k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), k), k)
    pair = r"^([^.-]{1,5})-(usd|eur|usdt)$"
    code, end = F.regexp_extract(s, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(s, r"^(.*)\.([^.]*)$", 2)
    return (
        F.when(s.rlike(r"\.(tw|two)$"), None).when(s.startswith("^"), F.concat(F.lit("^"), lookup(INDICES, F.substring(s, 2, 99)))).when(s.endswith("=x"), F.regexp_replace(s, "=x$", ""))
        .when(s.rlike(pair), F.regexp_replace(s, "-", "")).when(end == "", F.concat(s, F.lit(".us"))).when(end == "hk", F.concat(F.regexp_replace(code, "^0+", ""), F.lit(".hk")))
        .when(end.isin(list(EXCHANGES)), F.concat(code, F.lit("."), lookup(EXCHANGES, end))).when(F.length(end) == 1, F.concat(s, F.lit(".us"))).otherwise(s))


def change(price: Column, before: Column) -> Column:
    """struct<change, change_pct> to 2 decimals; null without a former price other than 0."""
    ok = before.isNotNull() & (before != 0)
    return F.struct(F.when(ok, round_half_away(price - before, 4)).alias("change"), F.when(ok, round_half_away((price / before - 1) * 100, 2)).alias("change_pct"))


def market_state(now: Column, regular: tuple[Column, Column], pre: tuple[Column, Column], post: tuple[Column, Column]) -> Column:
    """regular, pre, post or closed: the first range [start, end) that holds ``now``."""
    inside = lambda r: (now >= r[0]) & (now < r[1])
    return F.when(inside(regular), "regular").when(inside(pre), "pre").when(inside(post), "post").otherwise("closed")


def quote(df: DataFrame, price: str = "price", before: str = "previous_close", volume: str = "volume", hint: str | None = None) -> DataFrame:
    """Adds change, change_pct; no volume of zero; prices to the hinted decimals, 2 to 6."""
    d = F.least(F.greatest(F.coalesce(F.col(hint), F.lit(2)), F.lit(2)), F.lit(6)) if hint else F.lit(2)
    p = F.power(F.lit(10.0), d)
    c = change(F.col(price), F.col(before))
    return df.withColumns({"change": c["change"], "change_pct": c["change_pct"], volume: F.nullif(F.col(volume), F.lit(0)), price: F.signum(price) * F.floor(F.abs(F.col(price)) * p + 0.5) / p})


def bars(df: DataFrame, key: str, ts: str, offset_seconds: int = 0) -> DataFrame:
    """Rows with a close, with the local ``date``; the last of each date is kept. A hot key is spread over its dates, and
    only one row of a date leaves a task."""
    dated = df.where(F.col("close").isNotNull()).withColumn("date", F.date_format(F.timestamp_seconds(F.col(ts).cast("bigint") + offset_seconds), "yyyy-MM-dd"))
    latest = Window.partitionBy(key, "date").orderBy(F.desc(ts), *[F.desc(c) for c in df.columns if c not in (key, ts)])
    return dated.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


def summary(df: DataFrame, key: str = "symbol", date: str = "date", close: str = "close", high: str | None = "high", low: str | None = "low") -> DataFrame:
    """One row for each key: first and last date and close, change, high and low with their first dates.

    One aggregation with a map-side combine: a series with a third of all rows is no task of its own.
    """
    h = F.coalesce(F.col(high), F.col(close)) if high else F.col(close)
    lo = F.coalesce(F.col(low), F.col(close)) if low else F.col(close)
    out = df.where(F.col(close).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct(F.col(date).alias("d"), F.col(close).alias("v"))).alias("a"), F.max(F.struct(F.col(date).alias("d"), F.col(close).alias("v"))).alias("b"),
        F.min(F.struct((-h).alias("v"), F.col(date).alias("d"))).alias("h"), F.min(F.struct(lo.alias("v"), F.col(date).alias("d"))).alias("l"))
    c = change(F.col("b.v"), F.col("a.v"))
    return out.select(
        key, "rows", F.col("a.d").alias("first_date"), F.col("a.v").alias("first_close"), F.col("b.d").alias("last_date"), F.col("b.v").alias("last_close"),
        c["change"].alias("change"), c["change_pct"].alias("change_pct"), (-F.col("h.v")).alias("high"), F.col("h.d").alias("high_date"), F.col("l.v").alias("low"), F.col("l.d").alias("low_date"))


def last_n(df: DataFrame, n: int, key: str, date: str) -> DataFrame:
    """The last ``n`` rows of each key; Spark drops the others before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(date))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def range_start(today: Column, name: str) -> Column:
    """The first day of a named range: 5d (seven days), 1mo, 3mo, 6mo, 1y, 5y, ytd; 1970-01-01 for others."""
    if name == "5d":
        return F.date_sub(today, 7)
    if name == "ytd":
        return F.trunc(today, "year")
    months = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "5y": 60}.get(name)
    return F.add_months(today, -months) if months else F.lit("1970-01-01").cast("date")


def default_interval(name: str) -> str:
    """The interval that a named range is shown in."""
    return {"max": "1mo", "5y": "1wk"}.get(name, "1d")


def named(aliases: DataFrame, query: str) -> DataFrame:
    """Rows of (alias, symbol, name) whose alias is the query, or a Han alias that the query holds; first of a symbol."""
    q = query.strip().lower()
    hit = (F.lower("alias") == q) | (F.col("alias").rlike(r"\p{IsHan}") & F.lit(q).contains(F.lower("alias")))
    w = Window.partitionBy("symbol").orderBy((F.lower("alias") == q).desc(), F.length("alias").desc(), "alias")
    return aliases.where(hit).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_of(parts: list[DataFrame], key: str, limit: int = 25) -> DataFrame:
    """The union of hit lists, the first list first, one row for each key, ``limit`` (1..25) rows."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(i))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__part")
    return every.withColumn("__n", F.row_number().over(w)).where("__n = 1").orderBy("__part", key).drop("__n", "__part").limit(min(25, max(1, limit)))
