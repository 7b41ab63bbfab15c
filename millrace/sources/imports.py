"""Imports of records and hits: service lists with alternative keys, curated TOML, packed seeds, result pages
of search engines, sources of notes, the clock."""

from __future__ import annotations

import base64
import tomllib
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse, snippet
from ..functions.urls import host, normalize_url
from ..operators.joins import numbered
from .html import _Node, _Tree

#: Letters of a description that are kept, and links of a service.
DESCRIPTION, LINKS = 400, 4
#: Texts that stand for no value in service lists.
NO_VALUE = ["無", "無資料", "-", "N/A", "null", "同上"]


def first_filled(row: Column, keys: list[str]) -> Column:
    """The first real text among several keys of a map."""
    each = [F.nullif(collapse(F.try_element_at(row, F.lit(k))), F.lit("")) for k in keys]
    return F.coalesce(*[F.when(~c.isin(NO_VALUE), c) for c in each], F.lit(None).cast("string"))


def channel_of(path: Column) -> Column:
    """counter, other, online or gov by the file name."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    return F.when(name.contains("counter"), "counter").when(name.contains("other"), "other").when(name.contains("online"), "online").otherwise("gov")


def services(rows: DataFrame, fields: dict[str, list[str]], links: list[tuple[str, str, list[str]]], raw: str = "raw") -> DataFrame:
    """Records of a column of JSON arrays of flat objects: (code, title, description, service_urls).

    ``fields`` gives the alternative keys of code, title and description; ``links`` (rel, label, keys) in
    order. Rows without a code, a title or any link are left out; at most ``LINKS`` distinct links are kept.
    """
    o = rows.select(F.explode(F.from_json(raw, "array<map<string,string>>")).alias("o"))
    made = [F.struct(F.lit(rel).alias("rel"), F.lit(label).alias("label"), first_filled(F.col("o"), keys).alias("url")) for rel, label, keys in links]
    urls = F.filter(F.array(*made), lambda x: F.coalesce(x["url"].rlike("^https?://"), F.lit(False)))
    once = F.filter(urls, lambda x, i: F.array_position(F.transform(urls, lambda y: y["url"]), x["url"]) == i + 1)
    out = o.select(
        first_filled(F.col("o"), fields["code"]).alias("code"), first_filled(F.col("o"), fields["title"]).alias("title"),
        snippet(first_filled(F.col("o"), fields["description"]), DESCRIPTION).alias("description"), F.slice(once, 1, LINKS).alias("service_urls"))
    return out.where("code is not null and title is not null and size(service_urls) > 0")


def curated(spark: SparkSession, path: str, table: str = "record") -> DataFrame:
    """Records of a TOML file, an array of tables of texts and lists of texts."""
    with open(path, "rb") as f:
        rows = tomllib.load(f).get(table, [])
    names = list(dict.fromkeys(k for r in rows for k in r))
    lists = {n for r in rows for n, v in r.items() if isinstance(v, list)}
    schema = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n in lists else T.StringType()) for n in names])
    text = lambda v: v if v is None or isinstance(v, list) else str(v)
    return spark.createDataFrame([[text(r.get(n)) for n in names] for r in rows], schema)


def seed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a (gzip) JSON seed: {"source": …, "rows": […]}; the source goes to every row."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.col("source").alias("seed_source"), F.explode("rows").alias("r")).select("r.*", "seed_source")


# ---------------------------------------------------------------- result pages

def unwrapped(href: str, parameter: str, prefix: str = "") -> str | None:
    """The address behind a redirect that carries it in a query field, plain or as base64url after ``prefix``."""
    u = urlsplit("https:" + href if href.startswith("//") else href)
    if u.scheme not in ("http", "https"):
        return None
    value = parse_qs(u.query).get(parameter, [None])[0]
    if value is None:
        return u.geturl()
    if value.startswith("http"):
        return value
    try:
        code = value.removeprefix(prefix)
        text = base64.urlsafe_b64decode(code + "=" * (-len(code) % 4)).decode()
    except (ValueError, UnicodeDecodeError):
        return None
    return text if text.startswith("http") else None


def _classes(n: _Node) -> list[str]:
    return n.attrs.get("class", "").split()


def _nodes(n: _Node):
    for k in n.kids:
        if not isinstance(k, str):
            yield k
            yield from _nodes(k)


def _text(n: _Node) -> str:
    return " ".join("".join(k if isinstance(k, str) else _text(k) + " " for k in n.kids).split())


def page_hits(page: str, block: str, link: str, note: str, skip: str = "", parameter: str = "u", prefix: str = "") -> list[tuple[str, str, str]]:
    """(title, url, snippet) of the blocks with a class; ``link`` is the class or tag that holds the address,
    ``note`` the class (or its start) of the snippet, ``skip`` the class of blocks to leave out."""
    tree = _Tree()
    tree.feed(page)
    out = []
    for b in (n for n in _nodes(tree.root) if block in _classes(n) and (not skip or skip not in _classes(n))):
        inner = list(_nodes(b))
        at = next((n for n in inner if link in _classes(n) or n.tag == link), None)
        a = at if at is None or at.tag == "a" else next((n for n in _nodes(at) if n.tag == "a"), None)
        url = unwrapped(a.attrs.get("href", ""), parameter, prefix) if a else None
        if url:
            s = next((n for n in inner if any(c.startswith(note) for c in _classes(n))), None)
            out.append((_text(a), url, _text(s) if s else ""))
    return out


def result_hits(pages: Column, **how) -> Column:
    """array<struct<title, url, snippet>> of a column of result pages; ``how`` as for ``page_hits``."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "url", "snippet")])))
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(n, pa.string()) for n in ("title", "url", "snippet")]))
        rows = [None if p is None else [dict(zip(("title", "url", "snippet"), h)) for h in page_hits(p, **how)] for p in texts.to_pylist()]
        return pa.array(rows, kind)

    return run(pages)


# ---------------------------------------------------------------- sources and clock

def numbered_sources(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """(number, url, title, notes): the distinct sources of notes (id, source) in order of first appearance,
    with the title of the document of the same address, else its host. ``doc:N`` stands for a document.
    """
    d = docs.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("__h"), F.col("url").alias("__u"))
    n = notes.where("trim(source) <> ''").join(d, F.lower(F.trim("source")) == F.col("__h"), "left").withColumn("url", F.coalesce("__u", F.trim("source")))
    each = n.groupBy(normalize_url(F.col("url")).alias("key")).agg(F.min(F.struct("id", "url"))["url"].alias("url"), F.min("id").alias("first"), F.count(F.lit(1)).alias("notes"))
    titles = docs.where("trim(title) <> ''").groupBy(normalize_url(F.col("url")).alias("key")).agg(F.min(F.struct("doc_id", "title"))["title"].alias("__t"))
    return numbered(each.join(titles, "key", "left"), "first", "key").select(F.col("number").cast("int").alias("number"), "url", F.coalesce("__t", host(F.col("url")), "url").alias("title"), "notes")


def clock(zone: str = "UTC", at: Column | None = None) -> list[Column]:
    """The time now (or ``at``) in a zone: iso, date, weekday, unix seconds."""
    now = at if at is not None else F.current_timestamp()
    there = F.from_utc_timestamp(F.to_utc_timestamp(now, F.current_timezone()), zone)
    return [F.date_format(there, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(there, "yyyy-MM-dd").alias("date"), F.date_format(there, "EEEE").alias("weekday"), F.unix_timestamp(now).alias("unix")]
