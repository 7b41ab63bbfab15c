"""Prediction markets and events: outcomes, headlines, views, matching, flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import round_half_away
from ..sources.feeds import text_array
from .series import summary


def outcomes(names: Column, prices: Column) -> Column:
    """array<struct<outcome, pct>> of two arrays written as JSON texts; percent to 1 decimal."""
    zipped = F.arrays_zip(text_array(names).alias("n"), text_array(prices).alias("p"))
    return F.transform(zipped, lambda z: F.struct(z["n"].alias("outcome"), round_half_away(z["p"].try_cast("double") * 100, 1).alias("pct")))


def headline(pairs: Column) -> Column:
    """The Yes outcome of a Yes/No market, else the likeliest, the last of equals; null without prices."""
    priced = F.filter(pairs, lambda o: o["pct"].isNotNull())
    yes = F.filter(priced, lambda o: F.lower(o["outcome"]) == "yes")
    binary = (F.size(pairs) == 2) & (F.size(yes) == 1)
    placed = F.transform(priced, lambda o, i: F.struct(o["pct"].alias("pct"), i.alias("i"), o["outcome"].alias("outcome")))
    best = F.array_max(placed)
    return F.when(binary, F.get(yes, 0)).when(F.size(priced) > 0, F.struct(best["outcome"].alias("outcome"), best["pct"].alias("pct")))


def market_rows(events: DataFrame, event: str = "event") -> DataFrame:
    """The flat table, one row for each market with prices; closed markets of live events are left out."""
    e = F.col(event)
    m = events.select(e.alias("e"), F.posexplode(e["markets"]).alias("pos", "m"))
    m = m.withColumn("outcomes", outcomes(F.col("m.outcomes"), F.col("m.outcomePrices"))).withColumn("head", headline(F.col("outcomes")))
    live = ~F.coalesce(F.col("e.closed"), F.lit(False))
    shut = F.coalesce(F.col("m.closed"), F.lit(False))
    return m.where(F.col("head").isNotNull() & ~(live & shut)).select(
        F.col("e.id").alias("event_id"), F.col("e.title").alias("event"), F.col("m.id").alias("market_id"), F.coalesce(F.nullif(F.col("m.groupItemTitle"), F.lit("")), F.col("m.question")).alias("market"),
        F.col("head.outcome").alias("outcome"), F.col("head.pct").alias("pct"), F.col("m.volumeNum").try_cast("double").alias("volume"), F.col("m.volume24hr").try_cast("double").alias("volume_24h"),
        F.col("m.liquidityNum").try_cast("double").alias("liquidity"), F.substring("m.endDate", 1, 10).alias("end_date"), shut.alias("closed"), "pos")


def event_view(rows: DataFrame, top: int = 3) -> DataFrame:
    """One row for each event: markets, open ones, ones not shown, and the top markets (open first,
    likeliest first, in their own order on ties). The top is merged from bounded partial lists."""
    w = Window.partitionBy("event_id").orderBy("closed", F.desc("pct"), "pos")
    best = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top).groupBy("event_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__n", "market", "outcome", "pct"))), lambda x: F.struct(x["market"].alias("market"), x["outcome"].alias("outcome"), x["pct"].alias("pct"))).alias("top"))
    counts = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("markets"), F.sum((~F.col("closed")).cast("bigint")).alias("open"))
    return counts.join(best, "event_id").select("event_id", "markets", "open", F.greatest(F.col("markets") - top, F.lit(0)).alias("omitted"), "top")


def all_words(events: DataFrame, query: str, event: str = "event") -> DataFrame:
    """Events in whose texts (title, description, slug, ticker, questions, tags) every word of the query stands."""
    e = F.col(event)
    text = F.lower(F.concat_ws(" ", e["title"], e["description"], e["slug"], e["ticker"], F.concat_ws(" ", e["markets"]["question"]), F.concat_ws(" ", e["tags"]["label"])))
    cond = F.lit(True)
    for word in query.lower().split():
        cond = cond & text.contains(word)
    return events.where(F.coalesce(cond, F.lit(False)))


def strict_else_all(pool: DataFrame, query: str, event: str = "event") -> DataFrame:
    """The strict matches, or the whole pool if there is none."""
    strict = all_words(pool, query, event)
    return pool if strict.isEmpty() else strict


def sort_events(events: DataFrame, by: str = "volume", event: str = "event") -> DataFrame:
    """By volume or liquidity (largest first), ending (soonest first) or newest; missing values last."""
    e = F.col(event)
    key = {"volume": e["volume"].try_cast("double").desc_nulls_last(), "liquidity": e["liquidity"].try_cast("double").desc_nulls_last(),
           "ending": e["endDate"].asc_nulls_last(), "newest": e["startDate"].desc_nulls_last()}[by]
    return events.orderBy(key, e["id"].asc_nulls_last())


def one_of_each(events: DataFrame, order: str, event: str = "event") -> DataFrame:
    """The first event of each id, or of each slug where there is no id."""
    e = F.col(event)
    w = Window.partitionBy(F.coalesce(e["id"], e["slug"])).orderBy(order)
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def probability_summary(points: DataFrame, key: str = "market_id", ts: str = "date", p: str = "p") -> DataFrame:
    """As the summary of prices, on percent points (p is 0..1)."""
    pct = points.withColumn("close", round_half_away(F.col(p) * 100, 1))
    out = summary(pct, key, ts, "close", None, None)
    return out.withColumn("change", round_half_away(F.col("last_close") - F.col("first_close"), 1)).drop("change_pct")


def target(text: str) -> tuple[str, str]:
    """('id', n) or ('slug', s) of an id, a slug or a URL of an event or market."""
    t = text.strip()
    if "://" in t:
        parts = [x for x in t.split("://", 1)[1].split("?")[0].split("#")[0].split("/")[1:] if x]
        t = parts[-1] if parts else ""
    return ("id", t) if t.isdigit() else ("slug", t.lower())


def targets(text: Column) -> Column:
    """struct<kind, target> as ``target`` gives them, as an expression; an address without a path names the empty slug."""
    t = F.trim(text)
    path = F.regexp_replace(F.regexp_replace(t, r"^.*?://", ""), r"[?#].*$", "")
    last = F.when(t.contains("://"), F.regexp_extract(path, r"/([^/]+)/*$", 1)).otherwise(t)
    return F.struct(F.when(last.rlike("^[0-9]+$"), "id").otherwise("slug").alias("kind"), F.lower(last).alias("target"))
