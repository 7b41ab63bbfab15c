"""Queries over the knowledge base, origins, series, markets and events, with their SQL."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.cells import round_half_away
from ..functions.names import nearest
from ..operators import knowledge, markets, series
from ..sources import feeds
from ..streaming import events as stream
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


# ---------------------------------------------------------------- knowledge base

@query("with n as (select rec_no, regexp_replace(translate(lower(name_zh), '份証台裡', '分證臺裏'), '[^\\p{L}\\p{N}]', '', 'g') as x from kb_records where not regexp_matches(name_zh, '[^\\x{4e00}-\\x{9fff} a-zA-Z0-9]')) "
       "select rec_no, round((case when x = '診所' then 1.0 when contains(x, '診所') then least(0.99, 0.84 + 0.24 / length(x) + case when starts_with(x, '診所') then 0.03 else 0 end) else 0 end)::double * 1000) / 1000 as score from n")
def kb_substring_score(s, d):
    k = t(s, d, "kb_records").where(~F.col("name_zh").rlike(r"[^\x{4e00}-\x{9fff} a-zA-Z0-9]"))
    return k.select("rec_no", round_half_away(knowledge.substring_score(F.col("name_zh"), "診所"), 3).alias("score"))


@query("select distinct category from kb_records where category is not null and kind = 'org'")
def kb_categories(s, d):
    return knowledge.categories_of(t(s, d, "kb_records").where("kind = 'org'"))


@query("select rec_no, list_extract(list_filter(service_urls, lambda x: lower(x.rel) = 'form'), 1).url as url from kb_records")
def service_link(s, d):
    return t(s, d, "kb_records").select("rec_no", knowledge.service_link(F.col("service_urls"), "FORM").alias("url"))


@query("select rec_no, case when rec_no % 3 = 0 then 'new' else category end as category, case when rec_no % 3 = 0 and rec_no % 2 = 0 then 'moved' else official_url end as official_url, "
       "case when rec_no % 3 = 0 and (rec_no % 2 = 0 and official_url is distinct from 'moved') then 'fresh' when rec_no % 3 = 0 then coalesce(description, 'fresh') else description end as description from kb_records where rec_no % 4 <> 0 "
       "union all select rec_no, 'new', case when rec_no % 2 = 0 then 'moved' else official_url end, 'fresh' from kb_records where rec_no % 3 = 0 and rec_no % 4 = 0")
def kb_upsert(s, d):
    k = t(s, d, "kb_records").select("rec_no", "category", "official_url", "description")
    new = k.where("rec_no % 3 = 0").select("rec_no", F.lit("new").alias("category"), F.when(F.col("rec_no") % 2 == 0, "moved").otherwise(F.col("official_url")).alias("official_url"), F.lit("fresh").alias("description"))
    out = knowledge.upsert(k.where("rec_no % 4 <> 0"), new, key="rec_no", keep="description", same="official_url")
    return out


@query("select rec_no from kb_records where source is distinct from 'curated' union all select -rec_no from kb_records where source = 'partner-feed'")
def kb_replace_source(s, d):
    k = t(s, d, "kb_records").select("rec_no", "source")
    return knowledge.replace_source(k, k.where("source = 'partner-feed'").withColumn("rec_no", -F.col("rec_no")), "curated").select("rec_no")


@query("select id, min(popularity_bucket) filter (where popularity_bucket > 0) as popularity_bucket, arg_min(name_en, rec_no) filter (where trim(coalesce(name_en, '')) <> '') as name_en, "
       "coalesce(max(popularity_scope) filter (where popularity_scope = 'tw'), max(popularity_scope)) as popularity_scope from kb_records group by id")
def kb_fold_same_id(s, d):
    return knowledge.fold_same_id(t(s, d, "kb_records")).select("id", "popularity_bucket", "name_en", "popularity_scope")


def _origins(s, d):
    x = t(s, d, "sites").select("site", F.row_number().over(_by_site()).cast("bigint").alias("n"))
    each = F.array(F.struct(F.concat(F.lit("https://"), "site").alias("origin"), (F.col("n") * 10).alias("rank")), F.struct(F.concat(F.lit("http://www."), F.regexp_replace("site", r"^(www|m|shop)\.", "")).alias("origin"), (F.col("n") * 10 + 5).alias("rank")),
                   F.struct(F.concat(F.lit("https://cdn."), "site").alias("origin"), F.col("n").alias("rank")), F.struct(F.lit("https://10.0.0.1").alias("origin"), F.col("n").alias("rank")), F.struct(F.lit("broken").alias("origin"), F.col("n").alias("rank")))
    return x.select(F.inline(each))


def _by_site():
    from pyspark.sql import Window

    return Window.orderBy("site")  # the table of sites has one row a site, the same at every scale


_ORIGINS = ("with x as (select site, row_number() over (order by site) as n, regexp_extract(site, '([^.]+\\.[^.]+)$', 1) as domain from sites), o as (select domain, 'https://' || site as origin, n * 10 as rank, site as h from x "
            "union all select domain, 'http://www.' || domain, n * 10 + 5, 'www.' || domain from x) ")


@query(_ORIGINS + "select domain, min(rank)::bigint as bucket, arg_min(origin, (case when h = domain or h = 'www.' || domain then 0 else 1000000 end) + rank) as homepage from o group by domain")
def domain_min_rank(s, d):
    return knowledge.fold_origins(_origins(s, d)).select("domain", "bucket", "homepage")


@query("select unnest(['kept','backend','ip','malformed']) as reason, unnest([2 * count(*), count(*), count(*), count(*)])::bigint as origins from sites")
def origin_drop_reasons(s, d):
    return knowledge.reason_counts(_origins(s, d))


@query("select 'n' || p_partkey as domain, coalesce(case when p_partkey % 5 = 0 then 'Curated ' || p_partkey end, p_name) as name from part")
def overlay_names(s, d):
    n = t(s, d, "part")
    rows = n.select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("domain"), F.col("p_name").alias("name"), F.array("p_name").alias("aliases"))
    cur = n.where("p_partkey % 5 = 0").select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("domain"), F.concat(F.lit("Curated "), F.col("p_partkey").cast("string")).alias("name"), F.array(F.lit("c")).alias("aliases"))
    return knowledge.overlay(rows, cur).select("domain", "name")


@query("select 'd' || p_partkey as domain, least(100, p_partkey * 10) as popularity_bucket from part where p_partkey < 20 union all select 'd' || p_partkey, p_partkey * 10 from part where p_partkey >= 20")
def merge_by_domain(s, d):
    n = t(s, d, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("domain"), F.array("p_name").alias("aliases"), F.array().cast("array<string>").alias("alt_urls"), "p_partkey")
    base = n.where("p_partkey < 20").select("domain", "aliases", "alt_urls", F.lit(100).cast("bigint").alias("popularity_bucket"))
    return knowledge.merge_by_domain(base, n.select("domain", "aliases", "alt_urls", (F.col("p_partkey") * 10).alias("popularity_bucket"))).select("domain", "popularity_bucket")


@query("select rec_no, 'no https address' as error from kb_records where not coalesce(starts_with(official_url, 'https://'), false) union all select rec_no, 'unknown category' from kb_records where coalesce(category, '') not in ('food', 'tax')")
def curated_errors(s, d):
    k = t(s, d, "kb_records").select(F.col("rec_no").cast("string").alias("id"), "category", "official_url")
    return knowledge.check_curated(k, ["food", "tax"]).select(F.col("id").cast("bigint").alias("rec_no"), "error")


@query("select rec_no, case when contains(lower(name_en), 'bank') or contains(lower(name_en), 'payment') then 'money' when contains(lower(name_en), 'water') then 'water' else coalesce(kind, 'none') end as class from kb_records")
def classify_records(s, d):
    rules = [(["bank", "payment"], "money"), (["water"], "water")]
    return t(s, d, "kb_records").select("rec_no", knowledge.classify(F.coalesce("name_en", F.lit("")), rules, F.coalesce("kind", F.lit("none"))).alias("class"))


@query("select doc_id from fetched_docs where fetched_at::timestamptz > timestamptz '2024-06-01 00:00:00+00' - interval 30 day")
def ttl_fresh(s, d):
    return knowledge.fresh(t(s, d, "fetched_docs"), F.lit("2024-06-01T00:00:00Z").cast("timestamp"), 30).select("doc_id")


# ---------------------------------------------------------------- search

def _norm_sql(c: str) -> str:
    """SQL: the normalised text of a column."""
    wide, narrow = (x.replace("'", "''") for x in (knowledge._WIDE, knowledge._NARROW))
    return f"regexp_replace(translate(lower(translate({c}, '{wide}', '{narrow}')), '份証台裡', '分證臺裏'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _score_sql(q: str, texts: str) -> str:
    """SQL: (t, edit, score) of the distinct normalised ``texts`` (a query with the columns t, edit) against the normalised term ``q``."""
    n = len(q)
    budget = 0 if n < 3 else 1 if n <= 6 else 2
    pairs = [q[i : i + 2] for i in range(n - 1)]
    need = {c: q.count(c) for c in q}
    holds = " and ".join(f"length(w) - length(replace(w, '{c}', '')) >= {k}" for c, k in need.items())
    share = "(" + " + ".join(f"contains(t, '{p}')::int" for p in pairs) + f")::double / {len(pairs)}" if pairs else "0.0"
    return (
        f"(with d as (select distinct t, edit from ({texts}) where t <> ''), "
        f"s as (select t, edit, i, k, substr(t, i, k) as w from d, range(1, length(t) + 1) as a(i), range({max(1, n - budget)}, {5 * n + 3}) as b(k) where not contains(t, '{q}') and i + k - 1 <= length(t)), "
        f"e as (select t, edit, min(case when k <= {n + budget} then levenshtein('{q}', w) end) as edits, min(case when {holds} then k end) as win from s group by t, edit) "
        f"select d.t, d.edit, case when d.t = '{q}' then 1.0::double when contains(d.t, '{q}') then least(0.99, 0.84 + 0.12 * {n} / length(d.t) + case when starts_with(d.t, '{q}') then 0.03 else 0 end)::double else greatest("
        f"case when d.edit and {budget} > 0 and length(d.t) <= 80 and {n} <= 24 and length(d.t) >= {max(1, n - budget)} and edits between 1 and {budget} then 0.78 * (1 - edits::double / {n}) else 0 end, "
        f"case when {n} >= 4 and {share.replace('contains(t,', 'contains(d.t,')} >= 0.67 then 0.40 + 0.28 * {share.replace('contains(t,', 'contains(d.t,')} else 0 end, "
        f"case when {n} >= 2 and win <= {3 * n + 1} then least(0.74, 0.36 + 0.42 * {n}::double / win) when {n} >= 2 and win <= {5 * n + 2} then 0.30 * {n}::double / win else 0 end)::double end as score "
        "from d left join e on d.t = e.t and d.edit = e.edit)")


def _verdict_sql(q: str) -> str:
    """SQL: (rec_no, score, exact, partial) of each record against the normalised term ``q``."""
    f = {x: _norm_sql(f"coalesce({x}, '')") for x in ("name_zh", "name_en", "category", "description", "official_url")}
    url = f" union all select rec_no, {f['official_url']} as t, false as edit, 0.45 as weight, 0 as name from kb_records" if len(q.encode()) >= 12 else ""
    texts = (f"select rec_no, {f['name_zh']} as t, true as edit, 1.0 as weight, 1 as name from kb_records union all select rec_no, {f['name_en']}, true, 0.96, 1 from kb_records "
             f"union all select rec_no, {_norm_sql('a')}, true, 1.0, 1 from (select rec_no, unnest(aliases) as a from kb_records) where a is not null union all select rec_no, {f['category']}, false, 0.6, 0 from kb_records "
             f"union all select rec_no, {f['description']}, false, 0.7, 2 from kb_records{url}")
    return (f"(select f.rec_no, least(1.0, max(f.weight::double * coalesce(s.score, 0))) as score, coalesce(bool_or(f.name = 1 and f.t = '{q}'), false) as exact, coalesce(bool_or(f.name > 0 and contains(f.t, '{q}')), false) as partial "
            f"from ({texts}) f left join {_score_sql(q, 'select t, edit from (' + texts + ')')} s on s.t = f.t and s.edit = f.edit group by f.rec_no)")


def _search_sql(terms: list[tuple[str, bool]], keep: str = "true", where: str = "true", limit: int = 10) -> str:
    """SQL of a search by normalised terms, each with whether it is a stop word."""
    joins = " ".join(f"join {_verdict_sql(q)} v{i} on v{i}.rec_no = k.rec_no" for i, (q, _) in enumerate(terms))
    content = [i for i, x in enumerate(terms) if not x[1]] or list(range(len(terms)))
    stops = [i for i, x in enumerate(terms) if x[1]] if len(content) != len(terms) else []
    hit = lambda i: f"(v{i}.score >= {knowledge.HIT})"
    hits = " + ".join(f"{hit(i)}::int" for i in content)
    top = f"greatest({', '.join(f'v{i}.score' for i in content)})" if len(content) > 1 else f"v{content[0]}.score"
    total = top if len(content) == 1 else f"case when ({hits}) = 0 then {top} else greatest({knowledge.HIT}, 0.62 * ({hits}) / {len(content)}.0::double + 0.38 * {top}) end"
    if stops:
        bonus = "(" + " + ".join(f"{hit(i)}::int" for i in stops) + f") * (0.02 / {len(stops)})"
        total = f"case when ({hits}) > 0 then least(1.0, {total} + {bonus}) else {total} end"
    some = lambda test: "(" + " or ".join(f"({hit(i)} and {test.replace('V', f'v{i}')})" for i in content) + ")"
    ex, part, fz = some("V.exact"), some("not V.exact and V.partial"), some("not V.exact and not V.partial")
    match = f"case when {ex} and not {part} and not {fz} then 'exact' when {ex} or {part} then 'partial' when {fz} then 'fuzzy' else 'none' end"
    popular = "case when popularity_bucket between 1 and 1000 then 3 when popularity_bucket <= 5000 then 2 when popularity_bucket <= 10000 then 1 else 0 end"
    return (f"select rec_no, id, name_zh, score, match from (select k.*, round(least(1.0, {total}) * 1000) / 1000 as score, {match} as match from kb_records k {joins} where {keep}) "
            f"where score >= {knowledge.HIT} and {where} order by score desc, {popular} desc, length(name_zh) nulls last, id, rec_no limit {limit}")


@query(_search_sql([("儲蓄銀行", False), ("savings", False), ("官網", True)], limit=50))
def kb_search(s, d):
    found = knowledge.search(t(s, d, "kb_records"), "儲蓄銀行 Savings 官網", limit=50)
    return found.select("rec_no", "id", "name_zh", "score", "match")


@query(_search_sql([("water", False), ("company", False)], keep="k.kind = 'org'", where="category = 'utilities'", limit=20))
def kb_search_kind(s, d):
    return knowledge.search(t(s, d, "kb_records"), "water company", kind="org", category="utilities", limit=20).select("rec_no", "id", "name_zh", "score", "match")


@query(_search_sql([("圖館", False)], limit=30))
def kb_search_window(s, d):
    """A short term that stands in names with other letters between."""
    return knowledge.search(t(s, d, "kb_records"), "圖館", limit=30).select("rec_no", "id", "name_zh", "score", "match")


@query(_search_sql([("hospitla", False)], limit=30))
def kb_search_typo(s, d):
    """A term with an edit, with substring candidates first: there are none, so all rows are scored."""
    return knowledge.search(t(s, d, "kb_records"), "hospitla", limit=30, narrow=True).select("rec_no", "id", "name_zh", "score", "match")


@query(f"select id, greatest(p.score, v.score) as score from {_verdict_sql('postel')} p join {_verdict_sql('savice')} v using (rec_no) join kb_records k using (rec_no) where greatest(p.score, v.score) >= {knowledge.CLOSE} and greatest(p.score, v.score) < {knowledge.HIT} order by score desc, id, rec_no limit 3")
def kb_near_misses(s, d):
    return knowledge.near_misses(t(s, d, "kb_records"), "postel savice").select("id", "score")


@query("select term_id, string_split(trim(lower(raw)), ' ') as terms from query_terms where regexp_full_match(raw, '[A-Za-z]+( [A-Za-z]+)*') and len(list_distinct(string_split(lower(raw), ' '))) = len(string_split(raw, ' ')) and not regexp_matches(lower(raw), 'website|homepage|official|url')")
def kb_query_terms(s, d):
    """The terms of logged plain queries."""
    q = t(s, d, "query_terms").where(F.col("raw").rlike("^[A-Za-z]+( [A-Za-z]+)*$") & ~F.lower("raw").rlike("website|homepage|official|url"))
    got = q.select("term_id", knowledge.terms_of(F.col("raw")).alias("terms"), F.size(F.split("raw", " ")).alias("n"))
    return got.where(F.size("terms") == F.col("n")).select("term_id", "terms")


@query("with a as (select id, name_en, right(name_zh, 2) as alias from kb_records where length(name_zh) > 2), h as (select id as symbol, alias, name_en as name, row_number() over (partition by id order by lower(alias) = '哪家銀行有診所' desc, length(alias) desc, alias) as n "
       "from a where lower(alias) = '哪家銀行有診所' or (regexp_matches(alias, '\\p{Han}') and contains('哪家銀行有診所', lower(alias)))) select symbol, alias from h where n = 1")
def alias_lookup(s, d):
    """Han aliases that a query holds, one for each symbol."""
    k = t(s, d, "kb_records").where(F.length("name_zh") > 2).select(F.col("id").alias("symbol"), F.col("name_en").alias("name"), F.right("name_zh", F.lit(2)).alias("alias"))
    return series.named(k, "哪家銀行有診所").select("symbol", "alias")


@query("select p_partkey as symbol, 'local' as origin from part where p_size > 48 union all select p_partkey, 'remote' from part where p_size <= 48 order by origin, symbol limit 25")
def alias_union_remote(s, d):
    """Local hits first, then remote ones that are not local."""
    p = t(s, d, "part").select(F.col("p_partkey").alias("symbol"), "p_size")
    return series.first_of([p.where("p_size > 48").withColumn("origin", F.lit("local")), p.withColumn("origin", F.lit("remote"))], "symbol").select("symbol", "origin")


@query("select p_partkey, case p_partkey % 9 when 0 then 'n' || p_size || '.us' when 1 then '^spx' when 2 then 'x' || p_size || '.jp' when 3 then p_size || '.hk' when 4 then 'btcusd' when 5 then 'eurusd' when 6 then null when 7 then 'brk.b.us' else 'sap.de' end as symbol from part")
def exchange_symbols(s, d):
    z = F.col("p_size").cast("string")
    shapes = [F.concat(F.lit("N"), z), F.lit("^GSPC"), F.concat(F.lit("X"), z, F.lit(".T")), F.concat(F.lit("00"), z, F.lit(".HK")), F.lit("BTC-USD"), F.lit("EURUSD=X"), F.concat(z, F.lit(".TW")), F.lit("BRK.B"), F.lit("SAP.F")]
    return t(s, d, "part").select("p_partkey", series.exchange_symbol(F.element_at(F.array(*shapes), (F.col("p_partkey") % 9 + 1).cast("int"))).alias("symbol"))


@query("select o_orderkey, (o_orderdate::date - 7) as d5, (o_orderdate::date - interval 3 month)::date as m3, (o_orderdate::date - interval 5 year)::date as y5, date_trunc('year', o_orderdate)::date as ytd, date '1970-01-01' as whole from orders")
def range_starts(s, d):
    day = F.to_date("o_orderdate")
    return t(s, d, "orders").select("o_orderkey", *[series.range_start(day, n).alias(c) for n, c in (("5d", "d5"), ("3mo", "m3"), ("5y", "y5"), ("ytd", "ytd"), ("max", "whole"))])


@query("select rec_no, translate(name_zh, '国图书馆电视银体会龙门', '國圖書館電視銀體會龍門') as name from kb_records")
def traditional_names(s, d):
    """Simplified letters by the caller's table."""
    return t(s, d, "kb_records").select("rec_no", knowledge.to_traditional(F.col("name_zh"), "国图书馆电视银体会龙门", "國圖書館電視銀體會龍門").alias("name"))


@query("select p_partkey, case p_partkey % 3 when 0 then 'A & ' || p_name when 1 then 'Shop' || p_size else 'Shop' || p_size end as name from part")
def polished_names(s, d):
    """Entities decoded; names that say nothing, or in kana, replaced by the brand of the domain."""
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" A &amp;  "), F.col("p_name"), F.lit("\n"))).when(F.col("p_partkey") % 3 == 1, F.lit("ホーム")).otherwise(F.lit("Home"))
    return t(s, d, "part").select("p_partkey", knowledge.polish_name(raw, F.concat(F.lit("shop"), F.col("p_size").cast("string"), F.lit(".example"))).alias("name"))


@query("select rec_no, id, name_en from kb_records where id = (select max(id) from kb_records)")
def kb_point_lookup(s, d):
    """All deliveries of one id; the id reaches the scan as a filter."""
    k = t(s, d, "kb_records")
    return k.where(F.col("id") == k.agg(F.max("id")).first()[0]).select("rec_no", "id", "name_en")


@query("select doc_id, case when regexp_matches(x, '^[0-9]+$') then 'id' else 'slug' end as kind, lower(x) as target from (select doc_id, case when contains(url, '://') then regexp_extract(regexp_replace(url, '[?#].*$', ''), '://[^/]*/(?:.*/)?([^/]+)/*$', 1) else trim(url) end as x from fetched_docs where url is not null)")
def market_targets(s, d):
    """What an id, a slug or a page address names."""
    made = markets.targets(F.col("url"))
    return t(s, d, "fetched_docs").where("url is not null").select("doc_id", made["kind"].alias("kind"), made["target"].alias("target"))


@query("with o as (select distinct p_type as o from part), t as (select p_partkey, substr(p_type, 1, 2) || substr(p_type, 4) as typed from part), c as (select p_partkey, o, case when contains(lower(o), lower(typed)) or contains(lower(typed), lower(o)) then 0 else levenshtein(lower(typed), lower(o)) end as far, greatest(2, greatest(length(typed), 3) // 2) as most from t, o) "
       "select p_partkey, arg_min(o, (far, o)) as meant from c where far <= most group by p_partkey")
def did_you_mean(s, d):
    """The nearest of the known names for names with a letter left out."""
    p = t(s, d, "part")
    names = sorted(r.p_type for r in p.select("p_type").distinct().collect())  # types of parts, a fixed list

    @F.arrow_udf("string")
    def near(typed: pa.Array) -> pa.Array:
        return pa.array([nearest(x, names) for x in typed.to_pylist()], pa.string())

    return p.select("p_partkey", near(F.concat(F.substring("p_type", 1, 2), F.substring("p_type", 4, 99))).alias("meant")).where("meant is not null")


@query("select p_partkey, levenshtein(p_name, p_type) as edits from part")
def edit_distances(s, d):
    from ..functions.register import register

    register(s)
    return t(s, d, "part").select("p_partkey", F.call_function("edit_distance", F.col("p_name"), F.col("p_type")).cast("bigint").alias("edits"))


# ---------------------------------------------------------------- series

def _bars(s, d):
    e = t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    daily = e.groupBy(F.col("event_type").alias("symbol"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return daily.agg(F.max("value").alias("high"), F.min("value").alias("low"), round_half_away(F.avg("value"), 4).alias("close"), F.count(F.lit(1)).alias("volume"))


_BARS = "with b as (select event_type as symbol, strftime(ts, '%Y-%m-%d') as date, max(value) as high, min(value) as low, round(avg(value) * 10000) / 10000 as close, count(*) as volume from events group by 1, 2) "


@query(_BARS + "select symbol, count(*) as rows, arg_min(close, date) as first_close, max(date) as last_date, max(high) as high, min(date) filter (where high = mh) as high_date, min(low) as low, min(date) filter (where low = ml) as low_date, "
       "round((arg_max(close, date) / arg_min(close, date) - 1) * 100 * 100) / 100 as change_pct from (select *, max(high) over (partition by symbol) as mh, min(low) over (partition by symbol) as ml from b) group by symbol")
def series_summary(s, d):
    return series.summary(_bars(s, d)).select("symbol", "rows", "first_close", "last_date", "high", "high_date", "low", "low_date", "change_pct")


@query(_BARS + "select symbol, date, close from (select *, row_number() over (partition by symbol order by date desc) as n from b) where n <= 3")
def last_n(s, d):
    return series.last_n(_bars(s, d), 3, "symbol", "date").select("symbol", "date", "close")


@query("with e as (select event_type, event_id, value, strftime(ts, '%Y-%m-%d') as date, epoch(ts)::bigint as sec, ts from events where value > 1), n as (select *, lead(date) over (partition by event_type order by ts, event_id) as nd from e) "
       "select event_type, date, count(*)::bigint as kept from n where nd is null or nd <> date group by event_type, date")
def consecutive_dedupe(s, d):
    e = t(s, d, "events").where("value > 1").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("close"))
    b = series.bars(e.withColumn("sec", F.col("us") / 1e6), "event_type", "sec")
    return b.groupBy("event_type", "date").agg(F.count(F.lit(1)).alias("kept"))


@query("select event_id, round((value - 10) * 10000) / 10000 as change, round((value / 10 - 1) * 100 * 100) / 100 as change_pct, nullif(user_id % 3, 0) as volume from events")
def quote_shaping(s, d):
    e = t(s, d, "events").select("event_id", F.col("value").alias("price"), F.lit(10.0).alias("previous_close"), (F.col("user_id") % 3).alias("volume"))
    return series.quote(e).select("event_id", "change", "change_pct", "volume")


@query("select event_id, case when k < 40 then 'regular' when k < 60 then 'pre' when k < 80 then 'post' else 'closed' end as state from (select event_id, json_extract_string(props, '$.k')::int as k from events)")
def market_state(s, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    r = lambda a, b: (F.lit(a), F.lit(b))
    return t(s, d, "events").select("event_id", series.market_state(k, r(0, 40), r(30, 60), r(50, 80)).alias("state"))


@query("select p_partkey, ['TSM', 'N' || p_partkey] as symbols from part")
def symbol_split(s, d):
    return t(s, d, "part").select("p_partkey", series.symbols(F.concat(F.lit("tsm, n"), F.col("p_partkey").cast("string"), F.lit(" ;TSM"))).alias("symbols"))


@query("select p_partkey, (p_partkey % 3 + 1)::int as bars, 1.5::double as close, 'SYM' || p_partkey as symbol from part")
def price_json_scan(s, d):
    bar = F.concat(F.lit('{"chart":{"result":[{"meta":{"symbol":"SYM'), F.col("p_partkey").cast("string"), F.lit('"},"timestamp":['), F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_partkey") % 3), lambda i: (i * 86400).cast("string")), ","),
                   F.lit('],"indicators":{"quote":[{"open":[1.0],"high":[2.0],"low":[0.5],"close":[1.5],"volume":[7]}]}}]}}'))
    p = feeds.price_json(bar)
    return t(s, d, "part").select("p_partkey", F.size(p["bars"]).alias("bars"), F.get(p["bars"], 0)["close"].alias("close"), p["meta"]["symbol"].alias("symbol"))


# ---------------------------------------------------------------- markets

def _events(s, d):
    k, z = F.col("p_partkey").cast("string"), F.col("p_size")
    price = (z / 100.0).cast("decimal(4,2)").cast("string")
    one = lambda i, title, p, closed: F.concat(F.lit(f'{{"id":"{i}-'), k, F.lit(f'","question":"{title}","outcomes":"[\\"Yes\\",\\"No\\"]","outcomePrices":"[\\"'), p, F.lit(f'\\",\\"0.5\\"]","volumeNum":"12.5","closed":{closed}}}'))
    raw = F.concat(F.lit('{"id":"'), k, F.lit('","slug":"s-'), k, F.lit('","title":"'), F.col("p_name"), F.lit('","volume":'), F.col("p_retailprice").cast("string"), F.lit(',"closed":false,"markets":['),
                   one("a", "First", price, "false"), F.lit(","), one("b", "Second", F.lit("0.25"), "true"), F.lit(","), one("c", "Third", F.lit("0.40"), "false"), F.lit("]}"))
    return t(s, d, "part").select(feeds.event_json(raw).alias("event"))


@query("select p_partkey::varchar as event_id, 'First' as market, 'Yes' as outcome, round(p_size / 100.0 * 100 * 10) / 10 as pct, 12.5::double as volume from part union all select p_partkey::varchar, 'Third', 'Yes', 40.0, 12.5 from part")
def zip_outcomes(s, d):
    return markets.market_rows(_events(s, d)).select("event_id", "market", "outcome", "pct", "volume")


@query("select p_partkey::varchar as event_id, 2::bigint as markets, 2::bigint as open, case when p_size >= 40 then 'First' else 'Third' end as best from part")
def event_view(s, d):
    return markets.event_view(markets.market_rows(_events(s, d))).select("event_id", "markets", "open", F.col("top")[0]["market"].alias("best"))


@query("select p_partkey::varchar as id from part where contains(lower(p_name), 'blue') order by p_retailprice desc, p_partkey::varchar limit 20")
def market_search(s, d):
    return markets.sort_events(markets.strict_else_all(_events(s, d), "blue third"), "volume").limit(20).select(F.col("event.id").alias("id"))


@query("select p_partkey::varchar as event_id, p_name as event, 'a-' || p_partkey as market_id, 'First' as market, 'Yes' as outcome, round(p_size / 100.0 * 100 * 10) / 10 as pct, 12.5::double as volume, null::double as volume_24h, null::double as liquidity, null::varchar as end_date, false as closed from part "
       "union all select p_partkey::varchar, p_name, 'c-' || p_partkey, 'Third', 'Yes', 40.0, 12.5, null, null, null, false from part")
def market_table(s, d):
    """The flat table of markets with all its columns."""
    return markets.market_rows(_events(s, d)).drop("pos")


@query("select p_partkey::varchar as id, p_name as title from part")
def one_of_each_event(s, d):
    """Events that came twice, once with a later title."""
    e = _events(s, d)
    later = e.select(F.col("event").withField("title", F.lit("~ later")).alias("event"))
    return markets.one_of_each(e.union(later), "event.title").select(F.col("event.id").alias("id"), F.col("event.title").alias("title"))


@query("select event_type, round(arg_max(p, date) * 1000) / 10 as last_close, max(round(p * 1000) / 10) as high from (select event_type, strftime(ts, '%Y-%m-%d') as date, round(avg(json_extract_string(props, '$.k')::int) * 10) / 1000 as p from events group by 1, 2) group by event_type")
def probability_series(s, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    p = t(s, d, "events").groupBy("event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("date")).agg((round_half_away(F.avg(k), 1) / 100).alias("p"))
    return markets.probability_summary(p, "event_type").select("event_type", "last_close", "high")


# ---------------------------------------------------------------- events

@query("select event_type, time_bucket(interval 1 hour, ts) as start, count(*) as events, round(sum(value) * 100) / 100 as total from events group by 1, 2")
def windowed_events(s, d):
    e = t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.windowed(e, "1 hour").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "events", round_half_away(F.col("total"), 2).alias("total"))


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), i as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as n from g) "
       "select user_id, min(ts) as start, count(*) as events from i group by user_id, n")
def session_events(s, d):
    e = t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.sessions(e, "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "events")


@query("select event_type, date_trunc('day', ts) as start, count(*) as events from events group by 1, 2")
def stream_windows(s, d):
    """The same windows from a stream that reads the folder once; its result is one row a day and type."""
    src = stream.event_stream(s, f"{d}/events.parquet")
    name = f"w{uuid.uuid4().hex}"
    q = stream.windowed(src, "1 day", late="1 day").select("event_type", "start", "events").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(name).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "events")
