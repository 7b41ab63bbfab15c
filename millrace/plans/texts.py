"""Queries over documents, facts in text, URLs and stored pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.urls import host, normalize_url, registrable
from ..operators import documents, extraction, knowledge, reports, webhits
from ..session import spread
from ..sources import html as page_html
from ..sources import imports
from ..sources import tables as table_source
from .tables import dated_orders, t

Q: dict = {}
SQL: dict[str, str] = {}

_CJK = "\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{AC00}-\\x{D7AF}"
#: Lines of stored pages with their number and whether they lie outside code fences.
_LINES = ("with l as (select doc_id, unnest(string_split(body, chr(10))) as raw, generate_subscripts(string_split(body, chr(10)), 1) as line from fetched_docs), "
          "m as (select *, regexp_matches(ltrim(raw), '^(```|~~~)') as mark from l), "
          "f as (select *, sum(mark::int) over (partition by doc_id order by line) % 2 = 0 and not mark as open from m) ")


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(_LINES + "select doc_id, line::int as line from f where open and regexp_matches(raw, '\\S')")
def doc_lines(s, d):
    return documents.lines(t(s, d, "fetched_docs")).select("doc_id", "line")


@query(_LINES + ", h as (select doc_id, line, raw, open and regexp_matches(raw, '^\\s*#{1,6} ') as head from f), "
       "p as (select *, sum(head::int) over (partition by doc_id order by line) as n from h) "
       "select doc_id, count(*) filter (where head) + max((n = 0 and regexp_matches(raw, '\\S'))::int) as sections from p group by doc_id having sections > 0")
def doc_sections(s, d):
    return documents.sections(t(s, d, "fetched_docs")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))


@query(_LINES + "select doc_id, trim(rtrim(trim(regexp_replace(raw, '^\\s*#{1,6} ', '')), '#')) as heading, line::int as line from f where open and regexp_matches(raw, '^\\s*#{1,6} .*[^#\\s]')")
def outline_headings(s, d):
    """The headings of all pages with their lines, from the outline."""
    docs = t(s, d, "fetched_docs")
    rows = documents.sections(docs).where("level > 0").select("doc_id", F.regexp_replace("heading", r" \(part \d+/\d+\)$", "").alias("heading"), "start", "text", F.regexp_extract("heading", r"\(part (\d+)/\d+\)$", 1).alias("part"))
    heads = rows.where("part in ('', '1')").join(docs.select("doc_id", "body"), "doc_id")
    return heads.select("doc_id", "heading", (F.length(F.substring("body", F.lit(1), F.col("start").cast("int"))) - F.length(F.replace(F.substring("body", F.lit(1), F.col("start").cast("int")), F.lit("\n"), F.lit(""))) + 1).cast("int").alias("line"))


@query("select doc_id, length(body)::bigint as chars from fetched_docs where length(body) > 0")
def sections_lossless(s, d):
    return documents.sections(t(s, d, "fetched_docs"), most=400).groupBy("doc_id").agg(F.max(F.col("start") + F.col("chars")).alias("chars"))


@query("select doc_id, ((length(lower(body)) - length(replace(lower(body), 'cookie', ''))) // 6)::int as total_matches from fetched_docs where contains(lower(body), 'cookie')")
def grep_matches(s, d):
    return documents.grep(t(s, d, "fetched_docs"), "Cookie").select("doc_id", "total_matches").distinct()


@query("select doc_id, substr(body, 51, 200) as text, case when length(body) > 250 then 250::bigint end as next_offset from fetched_docs")
def windowed_read(s, d):
    w = documents.window(F.col("body"), 50, 200)
    return t(s, d, "fetched_docs").select("doc_id", w["text"].alias("text"), w["next_offset"].alias("next_offset"))


@query(f"with a as (select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\]\\((<[^)]*|[^)\\s]*)\\)', ']', 'g'), '(^|\\s)https?://\\S*', ' ', 'g') as x from documents) "
       f"select doc_id, len(regexp_extract_all(regexp_replace(x, '([{_CJK}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}](?:[''’.,-]*[\\p{{L}}\\p{{N}}])*'))::bigint as words from a")
def doc_word_count(s, d):
    return t(s, d, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query("select doc_id, len(regexp_extract_all(body, '\\]\\(<?http'))::bigint as inline, len(regexp_extract_all(body, 'https?://[^\\s)>\"<\\]|]*'))::bigint as urls from fetched_docs where body is not null")
def citation_counts(s, d):
    return t(s, d, "fetched_docs").where("body is not null").select("doc_id", tx.citations(F.col("body"))["inline"].alias("inline"), F.size(tx.urls(F.col("body"))).cast("bigint").alias("urls"))


_SPACE = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


@query(f"with x as (select doc_id, trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')) as x from documents where text is not null), "
       "h as (select doc_id, x, substr(x, 1, 80) as h, 80 - instr(reverse(substr(x, 1, 80)), ' ') as cut from x) "
       "select doc_id, case when length(x) <= 80 then x else regexp_replace(case when contains(h, ' ') and cut > 53 then substr(h, 1, cut) else h end, '[,.;: ]+$', '') || '…' end as short, length(x)::bigint as n from h")
def collapsed_text(s, d):
    """White space collapsed, and cut at a space in the last third."""
    return t(s, d, "documents").where("text is not null").select("doc_id", tx.snippet(F.col("text"), 80).alias("short"), F.length(tx.collapse(F.col("text"))).cast("bigint").alias("n"))


@query("select doc_id, case when regexp_matches(url, '^https?://') then regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') "
       "|| case when regexp_extract(url, '\\?([^#]*)', 1) <> '' and not regexp_matches(regexp_extract(url, '\\?([^#]*)', 1), '^utm_[^&]*$') then '?' || array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' and not starts_with(p, 'utm_')), '&') else '' end "
       "else lower(trim(url)) end as u from fetched_docs")
def url_normalize(s, d):
    return t(s, d, "fetched_docs").select("doc_id", normalize_url(F.col("url")).alias("u"))


@query("with u as (select doc_id, site, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') as u from fetched_docs where trim(url) <> ''), "
       "k as (select doc_id, site, row_number() over (partition by site, u order by doc_id) as n from u), r as (select doc_id, site, row_number() over (partition by site order by doc_id) as r from k where n = 1) select doc_id, site from r where r <= 20")
def web_hits(s, d):
    hits = t(s, d, "fetched_docs").select("doc_id", "site", "title", F.regexp_replace("url", r"[?#].*$", "").alias("url"))
    return webhits.finalize(hits, order="doc_id", per="site", limit=20).select("doc_id", "site")


@query("select doc_id from (select doc_id, row_number() over (partition by text order by doc_id) as n from documents where text is not null) where n = 1")
def dedupe_first_wins(s, d):
    return t(s, d, "documents").where("text is not null").groupBy(F.xxhash64("text"), F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(_LINES + ", k as (select doc_id, line, unnest(regexp_extract_all(raw, '\\[([^\\]]*)\\]\\((https?://[^)\\s]+)\\)', 2)) as url from f where open) select doc_id, url, min(line)::int as line from k group by doc_id, url")
def extract_links(s, d):
    """Every link of every page with the line where it first stands."""
    return extraction.extract(t(s, d, "fetched_docs"), "links").select(F.substring("doc", 5, 20).cast("bigint").alias("doc_id"), "url", "line")


def _of_part(s, d, body):
    return t(s, d, "part").select(F.col("p_partkey").alias("doc_id"), body.alias("body"), F.lit("https://shop.example.ca/p").alias("url"))


def _doc():
    return F.substring("doc", 5, 20).cast("bigint").alias("doc_id")


@query("select p_partkey as doc_id, p_retailprice as value, 'CAD' as currency, 'month' as period, 'user' as per, 1 as line from part union all select p_partkey, p_size * 10000.0::double, 'TWD', 'year', null, 3 from part")
def extract_prices(s, d):
    body = F.concat(F.lit("The **plan** costs $"), F.col("p_retailprice").cast("string"), F.lit(" per user/month.\n\nOr NT$"), F.col("p_size").cast("string"), F.lit("萬/年. Again $"), F.col("p_retailprice").cast("string"), F.lit(" per user/month.\n```\n$5\n```\n"))
    return extraction.extract(_of_part(s, d, body), "prices").select(_doc(), "value", "currency", "period", "per", "line")


@query("select o_orderkey as doc_id, strftime(o_orderdate, '%Y-%m-%d') as date, 'day' as precision from orders union all select o_orderkey, '2030-05', 'month' from orders")
def extract_dates(s, d):
    docs = dated_orders(s, d).select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("# May 2030\n> Sent on "), F.col("day"), F.lit(" by mail")).alias("body"), F.lit(None).cast("string").alias("url"))
    return extraction.extract(docs, "dates").select(_doc(), "date", "precision")


_SWAPPED = "day(o_orderdate) <= 12 and day(o_orderdate) <> month(o_orderdate)"


@query(f"select o_orderkey as doc_id, strftime(o_orderdate, '%Y-%m-%d') as date, {_SWAPPED} as ambiguous, month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) as raw from orders union all "
       "select o_orderkey, case when day(o_orderdate) > 12 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y-%d-%m') end, "
       f"{_SWAPPED}, day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) from orders where day(o_orderdate) <> month(o_orderdate)")
def extract_dates_in_digits(s, d):
    """Month first, unless that is no month; dates that could be read both ways are marked."""
    m, day, y = (f(F.col("o_orderdate")).cast("string") for f in (F.month, F.dayofmonth, F.year))
    body = F.concat(F.lit("Due "), m, F.lit("/"), day, F.lit("/"), y, F.lit(", paid "), day, F.lit("/"), m, F.lit("/"), y, F.lit(" (version 1.2.3, 31/02/2026)"))
    docs = t(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), body.alias("body"), F.lit(None).cast("string").alias("url"))
    return extraction.extract(docs, "dates").select(_doc(), "date", "ambiguous", "raw")


_FIRST, _LAST = "['Ana','Ben','Carla','Dirk','Elsa','Finn','Gita']", "['Moser','Novak','Ortega','Peters','Quist','Rossi','Sato','Tamm','Ueda','Vogel','Weber']"
_WHO = f"{_FIRST}[c_custkey % 7 + 1] || ' ' || {_LAST}[c_custkey % 11 + 1]"


@query(f"with c as (select c_custkey as doc_id, c_custkey % 5 as k, {_WHO} as who, 'Unit' || chr(65 + (c_custkey % 26)::int) || ' Corp' as org from customer) "
       "select doc_id, who as name, ['CEO','founder and CEO','Chair','director of Research','Chief Data Officer'][k + 1] as role, case when k in (0, 1, 3) then org end as org, [0.8,0.9,0.6,0.8,0.7][k + 1]::double as confidence from c "
       "union all select doc_id, '王小明', '董事長', null, 0.5 from c")
def extract_people(s, d):
    """One shape of five for each customer, and a Chinese one."""
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("c_custkey") % n + 1).cast("int"))
    who = F.concat(pick(["Ana", "Ben", "Carla", "Dirk", "Elsa", "Finn", "Gita"], 7), F.lit(" "), pick(["Moser", "Novak", "Ortega", "Peters", "Quist", "Rossi", "Sato", "Tamm", "Ueda", "Vogel", "Weber"], 11))
    org, k = F.concat(F.lit("Unit"), F.char(F.col("c_custkey") % 26 + 65), F.lit(" Corp")), F.col("c_custkey") % 5
    line = (F.when(k == 0, F.concat(F.lit("Yesterday "), who, F.lit(", CEO of "), org, F.lit(", spoke."))).when(k == 1, F.concat(who, F.lit(" is the founder and CEO of "), org, F.lit(".")))
            .when(k == 2, F.concat(who, F.lit(" | Chair"))).when(k == 3, F.concat(who, F.lit(", director of Research at "), org)).otherwise(F.concat(F.lit("we met former Chief Data Officer "), who, F.lit(" there"))))
    docs = t(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(line, F.lit("\n董事長王小明表示同意\nOur products ship in March.")).alias("body"), F.lit(None).cast("string").alias("url"))
    return extraction.extract(docs, "people").select(_doc(), "name", "role", "org", "confidence")


_LONG = "repeat('word ', 30) || '$' || p_size || ' each ' || repeat('more ', 30)"


@query(f"with x as (select p_partkey, {_LONG} as x, 150 as s, 150 + length('$' || p_size) as e from part) "
       "select p_partkey as doc_id, '…' || trim(substr(x, s - (120 - (e - s)) // 2 + 1, 120)) || '…' as context, 1 as section from x")
def extract_context(s, d):
    """About 120 letters around a price in the middle of a long line."""
    body = F.concat(F.repeat(F.lit("word "), 30), F.lit("$"), F.col("p_size").cast("string"), F.lit(" each "), F.repeat(F.lit("more "), 30))
    return extraction.extract(_of_part(s, d, body), "prices").select(_doc(), "context", "section")


@query("select p_partkey as doc_id, p_size::double as value, 2 as line from part where contains(lower(p_name), 'blue') union all select p_partkey, 7.0, 3 from part where contains(lower(p_name), 'blue') and p_size <> 7")
def extract_keyword(s, d):
    """Facts whose texts hold a keyword, after first-wins deduplication."""
    body = F.concat(F.lit("€7 for all\nThe "), F.col("p_name"), F.lit(" costs $"), F.col("p_size").cast("string"), F.lit("\nAll "), F.col("p_name"), F.lit(" at $7"))
    return extraction.extract(_of_part(s, d, body), "prices", keyword="BLUE").select(_doc(), "value", "line")


@query("select p_partkey as doc_id, case p_partkey when 7 then 1 when 3 then 2 else 3 end as source_no, p_size::double as value from part where p_partkey in (3, 7, 11)")
def extract_sources(s, d):
    """Facts of named documents, in the order of naming; names that differ in case only count once."""
    body = F.concat(F.lit("$"), F.col("p_size").cast("string"))
    return extraction.extract_from(_of_part(s, d, body), ["doc:7, DOC:3", "Doc:7,doc:11,doc:-5"], "prices").select(_doc(), "source_no", "value")


@query("select p_partkey as doc_id, 'Sizes' as title, p_size::varchar as cell, 3 as line from part union all select p_partkey, p_name, p_brand, 1 from part")
def extract_html_tables(s, d):
    """HTML tables left in a body; the document's title heads a table above the first heading; equal tables count once."""
    html = lambda a, b: F.concat(F.lit("<table><tr><th>Key<th>Value<tr><td>"), a, F.lit("<td>"), b, F.lit("</table>"))
    body = F.concat(html(F.lit("brand"), F.col("p_brand")), F.lit("\n## Sizes\n"), html(F.lit("size"), F.col("p_size").cast("string")), F.lit("\n"), html(F.lit("size"), F.col("p_size").cast("string")), F.lit("\n```\n"), html(F.lit("no"), F.lit("no")), F.lit("\n```\n<table><tr><td>"))
    docs = _of_part(s, d, body).join(t(s, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name"), "doc_id")
    return extraction.extract(docs, "tables", title="p_name").select(_doc(), "title", F.col("rows")[0][1].alias("cell"), "line")


@query("select p_partkey as doc_id, unnest(['prices', 'dates', 'emails', 'numbers']) as kind, unnest([1, 1, 1, 2])::bigint as facts from part")
def extract_all_kinds(s, d):
    """All kinds in one pass over the documents."""
    body = F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit(" on 2024-05-06 to a@b.test, 5 GB, "), F.col("p_partkey").cast("string"), F.lit(" users"))
    return extraction.extract_all(_of_part(s, d, body)).groupBy(_doc(), "kind").agg(F.count(F.lit(1)).alias("facts"))


@query("select p_partkey as doc_id, p_size::double as value, '%' as unit from part union all select p_partkey, p_partkey * 1e6, 'users' from part union all select p_partkey, p_size::double, 'hours' from part")
def extract_numbers(s, d):
    body = F.concat(F.lit("Usage rose "), F.col("p_size").cast("string"), F.lit("% to "), F.col("p_partkey").cast("string"), F.lit(" million users (model H100) in "), F.col("p_size").cast("string"), F.lit(" hrs, 7 of them late"))
    return extraction.extract(_of_part(s, d, body), "numbers").select(_doc(), "value", "unit")


@query("select c_custkey as doc_id, 'user' || c_custkey || '@mail.example' as email from customer")
def extract_emails(s, d):
    body = F.concat(F.lit("Write to user"), F.col("c_custkey").cast("string"), F.lit("@mail.example or USER"), F.col("c_custkey").cast("string"), F.lit("@MAIL.EXAMPLE, see logo@2x.png"))
    docs = t(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), body.alias("body"), F.lit(None).cast("string").alias("url"))
    return extraction.extract(docs, "emails").select(_doc(), "email")


@query(_LINES + ", g as (select doc_id, line, raw, open and regexp_matches(raw, '^\\s*\\|\\s*#\\s*\\|') as head, lead(raw) over (partition by doc_id order by line) as nxt, open and regexp_matches(raw, '^\\s*\\|\\s*-') as rule, contains(raw, '|') and regexp_matches(raw, '\\S') as bar from f), "
       "b as (select *, sum((not bar)::int) over (partition by doc_id order by line) as run from g), "
       "c as (select *, sum(head::int) over (partition by doc_id, run order by line) as inside from b) "
       "select doc_id, count(*)::bigint as rows from c where inside > 0 and not head and not rule and bar group by doc_id")
def pipe_table_scan(s, d):
    rows = table_source.read_pipe_tables(t(s, d, "fetched_docs")).where(F.get("columns", 0) == "#")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))


@query("select n_nationkey::bigint as doc_id, 'Prices' as title, 2 as row_count, n_name as cell from nation")
def extract_tables(s, d):
    body = F.concat(F.lit("# Prices\ntext\n\n| Plan | Note |\n|---|:-:|\n| "), F.col("n_name"), F.lit(" | a \\| b |\n| x |\n\n```\n| no | no |\n|---|---|\n| 1 | 2 |\n```\n"))
    docs = t(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("doc_id"), body.alias("body"), F.lit(None).cast("string").alias("url"))
    return extraction.extract(docs, "tables").select(_doc(), "title", "row_count", F.col("rows")[0][0].alias("cell"))


def _of_pages(kind):
    """All facts of a kind in all stored pages; SQL cannot follow."""
    def facts(s, d):
        return extraction.extract(t(s, d, "fetched_docs"), kind)

    facts.__name__ = f"pages_{kind}"
    return facts


for _kind in ("prices", "dates", "people", "numbers", "emails", "tables"):
    query()(_of_pages(_kind))


@query("select p_partkey, '# ' || p_name || chr(10) || chr(10) || 'Go [here](https://site.example/d/p%20' || p_partkey || ') now.' || chr(10) || chr(10) || '* one' || chr(10) || '* two' || chr(10) || chr(10) "
       "|| '| A | B |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | x\\|y |' || chr(10) as md, p_name || ' & Co' as title from part")
def html_markdown(s, d):
    page = F.concat(
        F.lit("<html><head><title>"), F.col("p_name"), F.lit(" &amp; Co</title><style>p{}</style></head><body><nav><a href='/n'>Menu</a></nav><h1>"), F.col("p_name"),
        F.lit("</h1><p>Go <a href='p "), F.col("p_partkey").cast("string"), F.lit("'>here</a> now.<ul><li>one<li>two</ul><table><tr><th>A<th>B<tr><td>"), F.col("p_name"),
        F.lit("<td>x|y</table><img src=i.png><script>var a = '</p>'</script><footer>end</footer>"))
    n = spread(t(s, d, "part"))
    return n.select("p_partkey", page_html.markdown(page, F.lit("https://site.example/d/")).alias("md"), tx.page_title(page).alias("title"))


@query("select p_partkey, p_name || ' is <b> & ' || p_type as plain from part")
def stripped_tags(s, d):
    x = F.concat(F.lit("<p class='a'>"), F.col("p_name"), F.lit("</p>\n<script>var x = '<b>';</script> is &lt;b&gt; &amp; <i>"), F.col("p_type"), F.lit("</i><style>p{}</style>"))
    return t(s, d, "part").select("p_partkey", tx.strip_tags(x).alias("plain"))


@query("select p_partkey, 'a%20' || replace(p_brand, '#', '%23') || '%2F%C3%A7~-_.%2A%2B' as coded, 'a ' || p_brand || '/ç+%zz' as plain from part")
def percent_texts(s, d):
    x = F.concat(F.lit("a "), F.col("p_brand"), F.lit("/ç~-_.*+"))
    back = F.concat(tx.percent_decode(F.concat(F.lit("a%20"), F.replace("p_brand", F.lit("#"), F.lit("%23")), F.lit("%2F%C3%A7+"))), tx.percent_decode(F.lit("%zz")))
    return t(s, d, "part").select("p_partkey", tx.percent_encode(x).alias("coded"), back.alias("plain"))


@query("select site, regexp_extract(site, '([^.]+\\.[^.]+)$', 1) as domain from sites")
def registrable_domain(s, d):
    return t(s, d, "sites").select("site", registrable(F.col("site")).alias("domain"))


@query("select site, replace(replace(site, '-', '%2D'), '.', ' ') as plain from sites")
def percent_codes(s, d):
    x = F.replace(F.replace("site", F.lit("-"), F.lit("%2D")), F.lit("."), F.lit(" "))
    return t(s, d, "sites").select("site", F.when(tx.percent_decode(tx.percent_encode(x)) == x, x).alias("plain"))


@query("with a as (select regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') as h, doc_id from fetched_docs) select doc_id from a where h not in (select regexp_replace(site, '^www\\.', '') from sites where country = 'tw')")
def anti_join_allowed_urls(s, d):
    docs = t(s, d, "fetched_docs").select("doc_id", F.concat(F.lit("https://"), host(F.col("url"))).alias("url"))
    allowed = t(s, d, "sites").where("country = 'tw'").select(F.concat(F.lit("http://"), "site", F.lit("/")).alias("url"))
    return webhits.allowed_anti(docs, allowed).select("doc_id")


@query("select coalesce(source, '') as source, count(*) as notes, min(doc_id) as first_id from documents group by 1")
def notes_by_source(s, d):
    return webhits.by_source(t(s, d, "documents"), "doc_id")


@query("select doc_id from documents where lower(source) = 'wiki' and (contains(lower(text), 'schalter') or contains(lower(source), 'schalter')) order by doc_id desc limit 15")
def notes_filter(s, d):
    n = t(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.col("source").alias("tag"))
    return webhits.notes(n, tag="WIKI", keyword="Schalter", latest=15).select(F.col("id").alias("doc_id"))


TEMPLATE = reports.template({
    "name": "page", "title_level": 1, "min_words": 40, "require_sources_section": True, "min_sources": 1, "forbid": ["lorem ipsum"],
    "section": [{"heading": "Prices", "aliases": ["價格", "料金", "Preise", "Tarifs", "Precios"], "required": False, "min_words": 3}, {"heading": "{n}. {title}", "level": 2, "repeat_min": 1}]})


@query()
def report_grades(s, d):
    return reports.grades(t(s, d, "fetched_docs"), TEMPLATE)


@query()
def report_issues(s, d):
    return reports.issues(t(s, d, "fetched_docs"), TEMPLATE)


@query("select p_partkey as doc_id, case when p_size % 2 = 0 then 100 else 100 - 12 - 4 end as score, p_size % 2 = 0 as pass, case when p_size % 2 = 0 then 0 else 1 end as errors, case when p_size % 2 = 0 then 0 else 1 end as warnings, len(string_split(p_name, ' '))::int + 4 + (p_size % 2)::int as words from part")
def report_rules(s, d):
    end = F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.lit("\n<!-- TODO: more -->\n## Other\n"))
    docs = _of_part(s, d, F.concat(F.lit("# T\n\n## Summary\n"), F.col("p_name"), F.lit(" and [more](https://a.test/x) text"), end))
    plain = reports.template({"section": [{"heading": "Summary", "require_citation": True}]})
    return reports.grades(docs, plain).select("doc_id", "score", "pass", "errors", "warnings", "words")


@query("with n as (select doc_id, case doc_id % 5 when 0 then 'item-' || (doc_id % 7) when 1 then 'Prices of plans' when 2 then 'costs' when 3 then '12' else 'other' end as tag from documents) "
       "select doc_id as id, case when regexp_matches(lower(tag), '^(item[-_ ]?)?[0-9]+$') then 2 else 1 end as place, case when regexp_matches(lower(tag), '^(item[-_ ]?)?[0-9]+$') then '{n}. {title}' else 'Prices' end as heading from n where tag <> 'other'")
def note_sections(s, d):
    """The section that each note belongs to, by numbers and by the start of its tag."""
    k = F.col("doc_id")
    tag = F.when(k % 5 == 0, F.concat(F.lit("item-"), (k % 7).cast("string"))).when(k % 5 == 1, "Prices of plans").when(k % 5 == 2, "costs").when(k % 5 == 3, "12").otherwise("other")
    plan = reports.template({"section": [{"heading": "Prices", "keywords": ["cost"]}, {"heading": "{n}. {title}", "repeat_min": 1}]})
    return reports.place_notes(t(s, d, "documents").select("doc_id", tag.alias("tag")), plan, "doc_id")


#: Reports that break one rule each: (body before and after the name of a part, the rules they break).
_SHAPES = [
    ("# T\n\n## Summary\nAll of ", " is [here](https://a.test/x).\n\n## Sources\n- <https://a.test/x>\n", []),
    ("# T\n\n# T2\n\n## Summary\nAll of ", " is [here](https://a.test/x).\n\n## Sources\n- <https://a.test/x>\n", ["multiple_h1"]),
    ("# T\n\n## Summary\nlorem ipsum ", " is [here](https://a.test/x).\n\n## Sources\n- <https://a.test/x>\n", ["forbidden"]),
    ("# T\n\n## Summary\nAll of ", " <!-- TODO: more --> is [here](https://a.test/x).\n\n## Sources\n- <https://a.test/x>\n", ["todo"]),
    ("# T\n\n## Summary\nAll of ", " is here.\n\n## Sources\n- <https://a.test/x>\n", ["citation"]),
    ("# T\n\n## Summary\nAll of ", " is [here](https://a.test/x).\n", ["sources_section"]),
    ("# T\n\n## Other\nAll of ", " is [here](https://a.test/x).\n\n## Sources\n- <https://a.test/x>\n", ["missing_section", "extra_section"]),
]
_SHAPE_SQL = " union all ".join(f"select p_partkey as doc_id, '{r}' as rule from part where p_partkey % {len(_SHAPES)} = {i}" for i, x in enumerate(_SHAPES) for r in x[2])


@query(_SHAPE_SQL)
def report_issue_rules(s, d):
    """The rules that reports break: each part's report breaks one or none."""
    made = F.lit("")
    for i, (before, after, _) in enumerate(_SHAPES):
        made = F.when(F.col("p_partkey") % len(_SHAPES) == i, F.concat(F.lit(before), F.col("p_name"), F.lit(after))).otherwise(made)
    plain = reports.template({"title_level": 1, "require_sources_section": True, "forbid": ["lorem ipsum"], "section": [{"heading": "Summary", "require_citation": True}]})
    return reports.issues(_of_part(s, d, made), plain).select("doc_id", "rule")


@query("select doc_id, regexp_matches(coalesce(text, ''), '[\\x{3040}-\\x{30FF}]') as kana from documents")
def script_predicates(s, d):
    return t(s, d, "documents").select("doc_id", tx.has_kana(F.col("text")).alias("kana"))


@query("select distinct n as name, regexp_replace(translate(lower(n), '份証台裡', '分證臺裏'), '[^\\p{L}\\p{N}]', '', 'g') as norm from (select name_en as n from kb_records where regexp_full_match(name_en, '[ -~]*'))")
def kb_normalize(s, d):
    k = t(s, d, "kb_records").where(F.col("name_en").rlike("^[ -~]*$")).select(F.col("name_en").alias("name")).distinct()
    return k.select("name", knowledge.normalize(F.col("name")).alias("norm"))


@query("select 'c' || p_partkey as code, p_name as title, 'About ' || p_name as description, 2 as links from part where p_partkey % 5 <> 0")
def service_import(s, d):
    k = F.col("p_partkey").cast("string")
    one = F.concat(F.lit('{"code":"c'), k, F.lit('","name":"-","title":"'), F.col("p_name"), F.lit('","text":" About  '), F.col("p_name"), F.lit('","page":"https://a.test/'), k, F.lit('","form":"'), F.when(F.col("p_partkey") % 5 == 0, "").otherwise("https://a.test/f"),
                   F.lit('","mail":"https://a.test/f"}'))
    rows = t(s, d, "part").select(F.concat(F.lit("["), F.when(F.col("p_partkey") % 5 == 0, F.lit('{"title":"no code","page":"https://a.test"}')).otherwise(one), F.lit("]")).alias("raw"))
    made = imports.services(rows, {"code": ["code"], "title": ["name", "title"], "description": ["none", "text"]}, [("page", "Page", ["page"]), ("form", "Form", ["form"]), ("email", "Mail", ["mail"])])
    return made.select("code", "title", "description", F.size("service_urls").alias("links"))


@query("select p_partkey, p_name as title, 'https://site.test/' || p_partkey as url, 'text' as snippet from part")
def result_page_hits(s, d):
    k = F.col("p_partkey").cast("string")
    page = F.concat(F.lit("<div class='hit ad'><h2><a href='https://ad.test'>ad</a></h2></div><div class='hit'><h2><a href='//r.test/l?u=https%3A%2F%2Fsite.test%2F"), k, F.lit("'>"), F.col("p_name"), F.lit("</a></h2><p class='note-2'>text</p></div><div class='hit'>none</div>"))
    hits = imports.result_hits(page, block="hit", link="h2", note="note", skip="ad")
    return t(s, d, "part").select("p_partkey", F.inline(hits))


@query("select row_number() over (order by min(doc_id))::int as number, 'https://' || site || '/' as url, site as title, count(*) as notes from documents where trim(site) <> '' group by site")
def source_numbers(s, d):
    notes = t(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("https://"), F.col("site"), F.lit("/")).alias("source")).where("source is not null")
    docs = t(s, d, "fetched_docs").select("doc_id", F.concat(F.lit("https://none.test/"), F.col("doc_id").cast("string")).alias("url"), "title")
    return imports.numbered_sources(notes, docs)


@query("select event_id, strftime(ts + interval 8 hour, '%Y-%m-%dT%H:%M:%S') as iso, dayname(ts + interval 8 hour) as weekday from events")
def clock_in_zone(s, d):
    c = imports.clock("Asia/Taipei", F.col("ts").cast("timestamp"))
    return t(s, d, "events").select("event_id", c[0], c[2])
