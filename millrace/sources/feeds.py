"""Raw responses as rows: price series (JSON, CSV), markets and events (JSON), encyclopedia pages, notes,
ranked origins. A response is a row of text; shaping is done by Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHART = "struct<chart:struct<result:array<struct<meta:map<string,string>,timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>>>>>>>"
MARKET = ("id string, question string, slug string, groupItemTitle string, outcomes string, outcomePrices string, volumeNum string, volume24hr string, liquidityNum string, endDate string, "
          "closed boolean, oneDayPriceChange string")
EVENT = ("struct<id:string,slug:string,title:string,description:string,ticker:string,volume:string,volume24hr:string,liquidity:string,startDate:string,endDate:string,closed:boolean,"
         "tags:array<struct<label:string,slug:string>>,markets:array<struct<" + ",".join(f"{a}:{b}" for a, b in (x.split() for x in MARKET.split(", "))) + ">>>")


def price_json(raw: Column) -> Column:
    """array<struct<ts, open, high, low, close, volume>> and meta of a chart response: struct<meta, bars>."""
    r = F.get(F.from_json(raw, CHART)["chart"]["result"], 0)
    q = F.get(r["indicators"]["quote"], 0)
    bars = F.arrays_zip(r["timestamp"].alias("ts"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"), q["close"].alias("close"), q["volume"].alias("volume"))
    return F.struct(r["meta"].alias("meta"), bars.alias("bars"))


def price_csv(spark: SparkSession, path: str) -> DataFrame:
    """(symbol?, date, open, high, low, close, volume) of price CSV files; headers in any case, N/D is null."""
    df = spark.read.csv(path, header=True, nullValue="N/D", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = df.toDF(*[c.lower() for c in df.columns])
    number = [F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close") if c in df.columns]
    return df.select(*[c for c in ("symbol", "date") if c in df.columns], *number, *([F.col("volume").try_cast("bigint").alias("volume")] if "volume" in df.columns else []))


def event_json(raw: Column) -> Column:
    """An event response; numbers may be written as texts."""
    return F.from_json(raw, EVENT)


def text_array(raw: Column) -> Column:
    """An array that is itself written as a JSON text."""
    return F.from_json(raw, "array<string>")


def encyclopedia_hits(raw: Column) -> Column:
    """array<struct<title, pageid, snippet>> of a search response."""
    return F.from_json(raw, "struct<query:struct<search:array<struct<title:string,pageid:bigint,snippet:string>>>>")["query"]["search"]


def encyclopedia_markdown(extract: Column) -> Column:
    """``== Heading ==`` lines as Markdown headings."""
    t = extract
    for level in range(6, 0, -1):
        t = F.regexp_replace(t, rf"(?m)^={{{level}}}\s*([^=\n].*?)\s*={{{level}}}\s*$", "#" * level + " $1")
    return t


def disambiguation(markdown: Column, most: int = 8) -> Column:
    """The first distinct titles that a disambiguation page lists."""
    titles = F.regexp_extract_all(markdown, F.lit(r"(?m)^\s*[*-]\s+\[?([^\],，、(（\n]{1,80})"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.transform(titles, F.trim), lambda x: x != "")), 1, most)


def notes_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, source, tag, created) of JSON lines; broken lines are skipped."""
    return spark.read.schema("id bigint, text string, source string, tag string, created string").option("mode", "DROPMALFORMED").json(path).where("id is not null")


def origins_csv(spark: SparkSession, path: str) -> DataFrame:
    """(origin, rank) of a ranked list; gzip is read as it is."""
    return spark.read.csv(path, header=True).select(F.trim("origin").alias("origin"), F.trim("rank").try_cast("bigint").alias("rank"))
