"""Queries that write files and read them back through the sources and sinks, with their SQL. Files go to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extraction
from ..session import shared_folder
from ..sources import catalog, feeds, html, imports, sinks
from ..sources import pipes as pipe_text
from ..sources import tables as table_source
from .tables import t

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _new(s, ending: str) -> str:
    return f"{shared_folder(s)}/files-{uuid.uuid4().hex}{ending}"


def _lines(s, df, ending: str) -> str:
    """A folder with the one text column of ``df`` as lines."""
    path = _new(s, ending)
    df.write.text(path)
    return path


def _labelled(s, d):
    p = t(s, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("Key"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("Label; long"), F.concat(F.lit("$"), F.col("p_size").cast("string")).alias("Price"))


_LABELLED = "select p_partkey::varchar as \"Key\", p_name || ', \"' || p_brand || '\"' as \"Label; long\", '$' || p_size as \"Price\" from part"


@query(_LABELLED)
def csv_scan(s, d):
    path = _new(s, ".csv")
    sinks.write_csv(_labelled(s, d), path)
    return table_source.read_table(s, f"{path}/*.csv", driver_bytes=0).drop("_ord")


@query(_LABELLED)
def csv_scan_on_driver(s, d):
    path = _new(s, ".csv")
    sinks.write_csv(_labelled(s, d), path)
    return table_source.read_table(s, f"{path}/*.csv").drop("_ord")


@query(_LABELLED)
def tsv_scan(s, d):
    path = _new(s, ".tsv")
    _labelled(s, d).write.option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').csv(path)
    return table_source.read_table(s, f"{path}/*.csv", driver_bytes=0).drop("_ord")


@query("select s_suppkey::varchar as \"A\", s_name as \"B\" from supplier")
def delimiter_sniff(s, d):
    """Semicolons in a file called .csv, beside commas inside cells."""
    rows = t(s, d, "supplier").select(F.concat(F.lit("A;B\n"), F.col("s_suppkey").cast("string"), F.lit(";"), F.col("s_name")).alias("value"))
    return table_source.read_table(s, _lines(s, rows.repartition(F.col("value")), ".csv") + "/part-*", driver_bytes=0).where("`A` <> 'A'").drop("_ord")


@query("select '1' as id, s_name as name, case when s_suppkey % 5 = 0 then '[1, {\"k\": \"v\"}]' end as extra from supplier")
def json_scan(s, d):
    """Rows nested in an object, in a file without a telling name."""
    row = F.concat(F.lit('{"id": 1, "name": "'), F.col("s_name"), F.lit('"'), F.when(F.col("s_suppkey") % 5 == 0, F.lit(', "extra": [1, {"k": "v"}]')).otherwise(""), F.lit("}"))
    one = t(s, d, "supplier").agg(F.concat(F.lit('{"meta": {"n": 1}, "data": {"rows": ['), F.array_join(F.collect_list(row), ", "), F.lit("]}}")).alias("value"))
    return table_source.read_table(s, _lines(s, one, "") + "/part-*", driver_bytes=0).select("id", "name", "extra")


@query("select 'x' || n_nationkey as \"A\", case when n_nationkey % 3 > 0 then 'y' else '' end as \"A_2\", case when n_nationkey % 3 > 1 then 'z' else '' end as column3 from nation")
def ragged_rows(s, d):
    """Short and long rows, a repeated and a missing header."""
    k = F.col("n_nationkey")
    row = F.concat(F.lit("﻿A,a\n"), F.lit("x"), k.cast("string"), F.when(k % 3 > 0, ",y").otherwise(""), F.when(k % 3 > 1, ",z").otherwise(""), F.lit("\n\n"))
    got = table_source.read_table(s, _lines(s, t(s, d, "nation").select(row.alias("value")).repartition(25, "value"), ".csv") + "/part-*", driver_bytes=0)
    return got.where("`A` like 'x%'").select("A", F.coalesce("a_2", F.lit("")).alias("A_2"), F.coalesce("column3", F.lit("")).alias("column3")) if "column3" in got.columns else got


@query("select doc_id as id, text, source from documents")
def notes_scan(s, d):
    rows = t(s, d, "documents").select(F.to_json(F.struct(F.col("doc_id").alias("id"), "text", "source")).alias("value"))
    return feeds.notes_jsonl(s, _lines(s, rows.union(rows.limit(1).select(F.lit("{broken"))), ".jsonl")).select("id", "text", "source")


@query("select 'S' || (l_orderkey % 50) as symbol, strftime(l_shipdate, '%Y-%m-%d') as date, l_extendedprice as close, case when l_linenumber = 1 then null else l_quantity::bigint end as volume from lineitem")
def price_csv_scan(s, d):
    path = _new(s, ".csv")
    li = t(s, d, "lineitem")
    li.select(F.concat(F.lit("S"), (F.col("l_orderkey") % 50).cast("string")).alias("Symbol"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"), F.col("l_extendedprice").alias("Close"),
              F.when(F.col("l_linenumber") == 1, "N/D").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("Volume")).write.option("header", True).csv(path)
    return feeds.price_csv(s, path).select("symbol", "date", "close", "volume")


@query("select p_partkey, p_name as title, p_partkey as pageid, p_name || ' is a ' || p_type as snippet, '## ' || p_name as heading, p_name as first from part")
def encyclopedia_scan(s, d):
    k, n = F.col("p_partkey").cast("string"), F.col("p_name")
    raw = F.concat(F.lit('{"query":{"searchinfo":{"totalhits":1},"search":[{"title":"'), n, F.lit('","pageid":'), k, F.lit(',"snippet":"<span class=\\"m\\">'), n, F.lit("</span> is&nbsp;a  &#"), F.lit("32;"), F.col("p_type"), F.lit('"}]}}'))
    hit = F.get(feeds.encyclopedia_hits(raw), 0)
    page = feeds.encyclopedia_markdown(F.concat(F.lit("== "), n, F.lit(" ==")))
    list_ = F.get(feeds.disambiguation(F.concat(F.lit("x may be:\n* ["), n, F.lit("](a), one\n* "), n, F.lit(", two"))), 0)
    return t(s, d, "part").select("p_partkey", hit["title"].alias("title"), hit["pageid"].alias("pageid"), tx.strip_tags(hit["snippet"]).alias("snippet"), page.alias("heading"), list_.alias("first"))


@query("select n_name, r_name, true as same_handle, true as other_handle from nation join region on n_regionkey = r_regionkey")
def catalog_round_trip(s, d):
    """Saving the same rows twice gives one handle, in any order; another table gets its own."""
    c = catalog.Catalog(s, _new(s, ""))
    df = t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    one, two, three = c.save(df, "nations", "a"), c.save(df.orderBy(F.desc("n_name")), "again", "a"), c.save(df.limit(3), "few", "a")
    return c.load(one.upper()).withColumns({"same_handle": F.lit(one == two), "other_handle": F.lit(three != one)})


@query("select s_suppkey::varchar as s_suppkey, replace(s_name, '#', ' | ') as s_name from supplier")
def markdown_sink(s, d):
    text = sinks.markdown_text(t(s, d, "supplier").select("s_suppkey", F.replace("s_name", F.lit("#"), F.lit(" | ")).alias("s_name")))
    columns, rows, _ = pipe_text.find_tables(text)[0]
    return table_source.frame(s, columns, rows).drop("_ord")


@query("select s_suppkey::varchar as s_suppkey, s_name, case when s_suppkey % 2 = 0 then null else 'x' end as note from supplier")
def json_sink(s, d):
    text = sinks.render(t(s, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 1, "x").alias("note")), "json")
    return table_source.frame(s, *table_source.parse(text)).drop("_ord")


@query("select s_suppkey::varchar as s_suppkey, s_name || chr(10) || '\"q\"' as s_name from supplier")
def csv_text_sink(s, d):
    text = sinks.render(t(s, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit('\n"q"')).alias("s_name")), "csv")
    return table_source.frame(s, *table_source.parse(text, "x.csv")).drop("_ord")


@query("select n_nationkey::bigint as id, 'Bücher ' || n_nationkey as title from nation")
def charset_pages(s, d):
    """Pages in three encodings, told by the header, by the page or not at all."""
    k = F.col("n_nationkey")
    page = F.concat(F.when(k % 3 == 1, '<meta charset="iso-8859-1">').otherwise(""), F.lit("<title>Bücher "), k.cast("string"), F.lit("</title>"))
    raw = F.when(k % 3 < 2, F.encode(page, "ISO-8859-1")).otherwise(F.encode(page, "UTF-8"))
    kind = F.when(k % 3 == 0, "text/html; charset=ISO-8859-1").otherwise("text/html")
    return t(s, d, "nation").select(k.cast("bigint").alias("id"), tx.page_title(html.decoded(raw, kind)).alias("title"))


@query("select s_name as name, s_suppkey::bigint as rank, 'suppliers' as seed_source from supplier")
def seed_scan(s, d):
    rows = t(s, d, "supplier").agg(F.collect_list(F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").cast("bigint").alias("rank"))).alias("rows"))
    made = rows.select(F.to_json(F.struct(F.lit("suppliers").alias("source"), "rows")).alias("value"))
    return imports.seed(s, _lines(s, made, ".json")).select("name", "rank", "seed_source")


@query("select p_partkey, case when p_partkey % 2 = 0 then p_type || p_partkey else '''' || p_name || ' it''\\''''s''' end as word from part")
def shell_words(s, d):
    p = t(s, d, "part")
    return p.select("p_partkey", tx.shell_quote(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.col("p_partkey").cast("string"))).otherwise(F.concat("p_name", F.lit(" it's")))).alias("word"))


@query("select p_partkey as doc_id, p_size::double as value, 'USD' as currency from part")
def extract_saved(s, d):
    """All facts of a kind saved as a table and read by their handle."""
    docs = t(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("It costs $"), F.col("p_size").cast("string")).alias("body"), F.lit(None).cast("string").alias("url"))
    c = catalog.Catalog(s, _new(s, ""))
    handle = c.save(extraction.extract(docs, "prices"), "prices from documents", "doc:0")
    return c.load(handle).select(F.substring("doc", 5, 20).cast("bigint").alias("doc_id"), "value", "currency")


@query("select n_nationkey::bigint as id, n_nationkey % 2 = 0 as added, true as kept from nation")
def preview_and_apply(s, d):
    """A change is shown as a diff first; the file changes when it is applied."""
    base = shared_folder(s).removeprefix("file://").removeprefix("file:")
    path, names = f"{base}/put-{uuid.uuid4().hex}.txt", [r.n_nationkey for r in t(s, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # 25 nations
    sinks.put(path, "".join(f"line {n}\n" for n in names if n % 2), apply=True)
    whole = "".join(f"line {n}\n" for n in names)
    shown = sinks.put(path, whole)
    before = open(path).read()
    sinks.put(path, whole, apply=True)
    rows = [(n, f"+line {n}\n" in shown, f"line {n}\n" in open(path).read() and (f"line {n}\n" in before) == bool(n % 2)) for n in names]
    return s.createDataFrame(rows, "id bigint, added boolean, kept boolean")


@query("select distinct source as source, 'https://' || source || '.test' as url from kb_records where source is not null")
def attribution_file(s, d):
    """Sources with their addresses, one line each however often they come."""
    base = shared_folder(s).removeprefix("file://").removeprefix("file:")
    path = f"{base}/attribution-{uuid.uuid4().hex}.tsv"
    rows = [(r.source, "CC0", f"https://{r.source}.test") for r in t(s, d, "kb_records").where("source is not null").select("source").distinct().collect()]  # kb_sources names six
    sinks.attribution(path, rows + rows)
    return s.read.csv(f"file://{path}", sep="\t").toDF("source", "licence", "url").select("source", "url")


@query("select 'error' as severity, 'rule ' || n_nationkey as rule, n_nationkey::int as line from nation where n_nationkey % 2 = 1 union all select 'warning', 'rule ' || n_nationkey, null from nation where n_nationkey % 2 = 0")
def checklist_sink(s, d):
    """Issues as a list to tick off, read back by a pattern."""
    n = F.col("n_nationkey")
    issues = t(s, d, "nation").select(F.when(n % 2 == 1, "error").otherwise("warning").alias("severity"), F.concat(F.lit("rule "), n.cast("string")).alias("rule"), F.when(n % 2 == 1, n.cast("int")).alias("line"), F.lit("mend it").alias("message"))
    lines = s.createDataFrame([(x,) for x in sinks.checklist_text(issues).splitlines()], "x string")
    part = lambda i: F.regexp_extract("x", r"^- \[ \] \*\*(\w+)\*\* (rule \d+)(?: \(line (\d+)\))?: mend it$", i)
    return lines.select(part(1).alias("severity"), part(2).alias("rule"), part(3).try_cast("int").alias("line"))


@query("select p_partkey, case p_partkey % 5 when 0 then '# ' || p_name || chr(10) when 1 then '{' || chr(10) || '  \"size\": ' || p_size || chr(10) || '}' when 2 then 'just ' || p_name when 3 then '# ' || p_brand || chr(10) end as body from part")
def response_bodies(s, d):
    """Responses by their content type: a page, JSON, text, a page without a type, an image."""
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    text = (F.when(k == 0, F.concat(F.lit("<body><h1>"), n, F.lit("</h1></body>"))).when(k == 1, F.concat(F.lit('{"size":'), F.col("p_size").cast("string"), F.lit("}"))).when(k == 2, F.concat(F.lit("just "), n))
            .when(k == 3, F.concat(F.lit("<!DOCTYPE html><html><h1>"), F.col("p_brand"), F.lit("</h1></html>"))).otherwise("GIF89a"))
    kind = F.when(k == 0, "text/html; charset=utf-8").when(k == 1, "application/json").when(k == 2, "text/plain").when(k == 4, "image/gif")
    return t(s, d, "part").select("p_partkey", html.readable_body(F.encode(text, "UTF-8"), kind).alias("body"))


@query("select doc_id, title from fetched_docs where doc_id = (select max(doc_id) from fetched_docs)")
def document_handle(s, d):
    """A stored document by its handle."""
    docs = t(s, d, "fetched_docs").select("doc_id", "title")
    return catalog.document(docs, f"DOC:{docs.agg(F.max('doc_id')).first()[0]}")
