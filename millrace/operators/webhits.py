"""Search hits and notes: finalising lists of hits, filtering notes, counts by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..functions.urls import host, normalize_url, on_site


def finalize(hits: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, limit: int = 20, order: str = "pos", per: str | None = None) -> DataFrame:
    """Hits with an address, on the wanted sites, the first of each normalised address, title or else
    host, at most ``limit`` (for each ``per``, if given) in their order."""
    df = hits.where(F.coalesce(F.trim("url"), F.lit("")) != "")
    for sites, keep in ((include, True), (exclude, False)):
        if sites:
            test = F.lit(False)
            for s in sites:
                test = test | on_site(F.col("url"), s)
            df = df.where(test if keep else ~test)
    keys = [per] if per else []
    same = Window.partitionBy(*keys, normalize_url(F.col("url"))).orderBy(order)
    df = df.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    df = df.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), host(F.col("url")), F.col("url")))
    if "snippet" in df.columns:
        df = df.withColumn("snippet", snippet(F.col("snippet")))
    if per:
        w = Window.partitionBy(per).orderBy(order)
        return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")
    return df.orderBy(order).limit(limit)


def notes(df: DataFrame, tag: str | None = None, keyword: str | None = None, latest: int | None = None) -> DataFrame:
    """Notes with a tag (without case) and a keyword in text or source; the latest ``n`` if asked."""
    if tag:
        df = df.where(F.lower("tag") == tag.lower())
    if keyword:
        k = keyword.lower()
        df = df.where(F.coalesce(F.lower("text").contains(k), F.lit(False)) | F.coalesce(F.lower("source").contains(k), F.lit(False)))
    return df.orderBy(F.desc("id")).limit(latest) if latest else df


def by_source(df: DataFrame, id_col: str = "id", source: str = "source") -> DataFrame:
    """(source, notes, first_id) in order of first appearance; no source is ''."""
    return df.groupBy(F.coalesce(source, F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("notes"), F.min(id_col).alias("first_id")).orderBy("first_id")


def allowed_anti(urls: DataFrame, allowed: DataFrame) -> DataFrame:
    """Addresses (url) that are not among the allowed ones (url), compared in one form."""
    a = allowed.select(normalize_url(F.col("url")).alias("__u")).where("__u is not null").distinct()
    return urls.withColumn("__u", normalize_url(F.col("url"))).join(a, "__u", "left_anti").drop("__u")
