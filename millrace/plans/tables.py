"""Queries over loosely typed tables, with their SQL. Texts with currencies, sizes and dates are written from typed columns, so SQL can check what is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calc as calc_fn
from ..functions import cells
from ..operators.profile import profile
from ..operators.tablequery import TableQuery

Q: dict = {}
SQL: dict[str, str] = {}


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def two(c: str):
    return cells.round_half_away(F.col(c), 2).alias(c)


FLAGSHIP = TableQuery(where=["l_quantity >= 30", "L Discount < 0.05"], group_by="l_returnflag", agg=["count", "sum:l_quantity", "avg:l_extendedprice"], sort="-sum_l_quantity")


@query("select l_returnflag, count(*) as count, sum(l_quantity) as sum_l_quantity, round(avg(l_extendedprice) * 100) / 100 as avg_l_extendedprice "
       "from lineitem where l_quantity >= 30 and l_discount < 0.05 group by l_returnflag")
def where_numeric_and(s, d):
    return FLAGSHIP.run(t(s, d, "lineitem")).select("l_returnflag", "count", "sum_l_quantity", two("avg_l_extendedprice"))


@query("select p_partkey, p_name from part where contains(lower(p_name), 'blue') or false")
def where_contains_ci(s, d):
    return TableQuery(where=["p_name contains BLUE"], select="p_partkey,p_name").run(t(s, d, "part"))


@query("select c_custkey, c_name, c_mktsegment from customer where starts_with(lower(c_name), 'customer#00000') and lower(c_mktsegment) <> 'building'")
def where_startswith_ne(s, d):
    return TableQuery(where=["c_name startswith CUSTOMER#00000", "c_mktsegment != Building"], select="c_custkey,c_name,c_mktsegment").run(t(s, d, "customer"))


def messy_part(s, d) -> DataFrame:
    n = F.col("p_partkey")
    return t(s, d, "part").select(
        "p_partkey", F.when(n % 7 == 0, "n/a").when(n % 11 == 0, "").otherwise(F.concat(F.lit("$"), F.col("p_retailprice").cast("string"), F.lit("/mo"))).alias("Price"),
        F.concat(F.col("p_size").cast("string"), F.lit(" MiB")).alias("Memory"), F.concat(F.lit("NT$"), F.col("p_size").cast("string"), F.lit("萬")).alias("Fee"),
        F.concat(F.col("p_size").cast("string"), F.lit("%")).alias("Share"), F.col("p_brand").alias("Brand"))


@query("select p_partkey from part where p_partkey % 7 <> 0 and p_partkey % 11 <> 0 and p_retailprice < 1200")
def where_currency_cell(s, d):
    return TableQuery(where=["price < $1,200"], select="p_partkey").run(messy_part(s, d))


@query("select p_partkey from part where p_size / 1024.0 >= 0.02")
def where_size_cell(s, d):
    return TableQuery(where=["Memory >= 0.02"], select="p_partkey").run(messy_part(s, d))


@query("select p_partkey from part where p_size * 10000 > 200000 and p_size <= 40")
def where_magnitude_cell(s, d):
    return TableQuery(where=["Fee > NT$20萬", "share <= 40"], select="p_partkey").run(messy_part(s, d))


@query("select o_orderkey from orders where o_orderdate >= timestamp '1995-06-01' and o_orderdate < timestamp '1996-03-01'")
def where_date_iso(s, d):
    return TableQuery(where=["o_orderdate >= 1995-06-01", "o_orderdate < 1 March 1996"], select="o_orderkey").run(t(s, d, "orders"))


def dated_orders(s, d) -> DataFrame:
    k, day = F.col("o_orderkey") % 6, F.col("o_orderdate")
    roc = F.concat(F.lit("民國"), (F.year(day) - 1911).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"))
    return t(s, d, "orders").select("o_orderkey", "o_totalprice", F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy/M/d")).when(k == 2, F.date_format(day, "MMM d, yyyy"))
                                    .when(k == 3, F.date_format(day, "d MMMM yyyy")).when(k == 4, F.date_format(day, "yyyy年M月d日")).otherwise(roc).alias("day"))


@query("select o_orderkey from orders where o_orderdate::date >= date '1996-01-01'")
def where_date_mixed(s, d):
    return TableQuery(where=["day >= January 1, 1996"], select="o_orderkey").run(dated_orders(s, d))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso from orders")
def date_cells(s, d):
    return dated_orders(s, d).select("o_orderkey", cells.cell_date(F.col("day")).alias("iso"))


@query("select p_partkey, case when p_partkey % 7 <> 0 and p_partkey % 11 <> 0 then p_retailprice end as price, case when p_partkey % 7 <> 0 and p_partkey % 11 <> 0 then 'USD' end as currency, "
       "p_size * 10000.0::double as fee, 'TWD' as fee_currency, true as percent from part")
def number_cells(s, d):
    p, f, sh = cells.cell(F.col("Price")), cells.cell(F.col("Fee")), cells.cell(F.col("Share"))
    return messy_part(s, d).select("p_partkey", p["value"].alias("price"), p["currency"].alias("currency"), f["value"].alias("fee"), f["currency"].alias("fee_currency"), sh["percent"].alias("percent"))


@query("select o_orderpriority, count(*) as count from orders group by o_orderpriority")
def group_count(s, d):
    return TableQuery(group_by="o_orderpriority").run(t(s, d, "orders"))


@query("select p_brand as \"Brand\", round(coalesce(sum(case when p_partkey % 7 <> 0 and p_partkey % 11 <> 0 then p_retailprice end), 0) * 100) / 100 as sum_Price, "
       "round(avg(case when p_partkey % 7 <> 0 and p_partkey % 11 <> 0 then p_retailprice end) * 100) / 100 as avg_Price, min(case when p_partkey % 7 <> 0 and p_partkey % 11 <> 0 then p_retailprice end) as min_Price, "
       "max(case when p_partkey % 7 <> 0 and p_partkey % 11 <> 0 then p_retailprice end) as max_Price, count(case when p_partkey % 7 <> 0 and p_partkey % 11 <> 0 then 1 end) as count_Price, count(*) as count from part group by p_brand")
def group_sum_avg_min_max(s, d):
    out = TableQuery(group_by="brand", agg=["sum:price", "avg:price", "min:price", "max:price", "count:price", "count"]).run(messy_part(s, d))
    return out.select("Brand", two("sum_Price"), two("avg_Price"), "min_Price", "max_Price", "count_Price", "count")


@query("select count(*) as count, sum(l_quantity) as sum_l_quantity, max(l_discount) as max_l_discount from lineitem")
def global_agg(s, d):
    return TableQuery(agg=["count", "sum:l_quantity", "max:l_discount"]).run(t(s, d, "lineitem"))


@query("select 0::bigint as count, 0.0::double as sum_l_quantity, null::double as avg_l_quantity")
def global_agg_empty(s, d):
    return TableQuery(where=["l_quantity > 100000"], agg=["count", "sum:l_quantity", "avg:l_quantity"]).run(t(s, d, "lineitem"))


@query("with v as (select p_partkey, p_retailprice, case when p_partkey % 7 <> 0 and p_partkey % 11 <> 0 then p_retailprice end as v from part) select p_partkey from v order by v desc nulls last, p_partkey limit 25")
def sort_numeric_blanks_last(s, d):
    return TableQuery(sort="-Price", select="p_partkey", limit=25, tie=["p_partkey"]).run(messy_part(s, d))


@query("select c_custkey, c_name from customer order by lower(c_mktsegment), c_acctbal desc, c_custkey limit 40")
def sort_multi_key(s, d):
    return TableQuery(sort="c_mktsegment, c_acctbal desc", select="c_custkey,c_name", limit=40, tie=["c_custkey"]).run(t(s, d, "customer"))


@query("with v as (select o_orderkey, o_orderdate from orders) select o_orderkey from v order by o_orderdate::date desc, o_orderkey limit 30")
def sort_dates(s, d):
    return TableQuery(sort="day desc", select="o_orderkey", limit=30, tie=["o_orderkey"]).run(dated_orders(s, d))


@query("select p_name as p_name, p_brand as p_brand, p_name as p_name_2 from part")
def select_repeated(s, d):
    return TableQuery(select="P Name, p_brand, p_name").run(t(s, d, "part"))


_PROFILE = ("select {o}::int as ordinal, '{c}' as \"column\", '{k}' as type, {f}::bigint as filled, {n}::bigint as numbers, {dt}::bigint as dates, count(*) as row_count from part")
_FILLED = "count(case when p_partkey % 7 <> 0 and p_partkey % 11 <> 0 then 1 end)"


@query(" union all ".join(_PROFILE.format(o=o, c=c, k=k, f=f, n=n, dt=0) for o, c, k, f, n in (
    (0, "p_partkey", "number", "count(*)", "count(*)"), (1, "Price", "currency", _FILLED, _FILLED), (2, "Memory", "number", "count(*)", "count(*)"), (3, "Fee", "currency", "count(*)", "count(*)"),
    (4, "Share", "number", "count(*)", "count(*)"), (5, "Brand", "text", "count(*)", "0"))))
def profile_types(s, d):
    return profile(messy_part(s, d))


@query("select l_orderkey, l_linenumber, printf('%.12g', l_extendedprice / 7) as shown from lineitem where l_quantity < 3")
def render_numbers(s, d):
    return t(s, d, "lineitem").where("l_quantity < 3").select("l_orderkey", "l_linenumber", cells.render_num(F.col("l_extendedprice") / 7).alias("shown"))


@query("select l_orderkey, l_linenumber, round((l_extendedprice * (1 - l_discount)) * 100) / 100 as net, -(l_quantity ** 2) + 7 / 2 as a, log10(l_quantity) + least(l_tax, l_discount, 0.05) as b, fmod(l_extendedprice, 7) as c from lineitem")
def calc_expr(s, d):
    df = t(s, d, "lineitem")
    made = {"net": "round(l_extendedprice * (1 - l_discount), 2)", "a": "-l_quantity ^ 2 + 7/2", "b": "log(l_quantity) + min(l_tax, l_discount, 0.05)", "c": "l_extendedprice % 7"}
    return df.select("l_orderkey", "l_linenumber", *[calc_fn.calc(e, df.columns).alias(n) for n, e in made.items()])


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def json_field(s, d):
    return t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("select o_orderpriority, o_orderkey, o_totalprice, rn from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 5")
def win_rank(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(s, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", F.row_number().over(w).cast("bigint").alias("rn")).where("rn <= 5")


@query("select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as q from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_counts(s, d):
    return t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup_counts(s, d):
    return t(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("select count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts from lineitem")
def distinct_counts(s, d):
    return t(s, d, "lineitem").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def semi_join(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def anti_join(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("select n_name, r_name, count(c_custkey) as customers from nation join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by n_name, r_name")
def left_join_counts(s, d):
    n = t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = t(s, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return n.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("(select l_partkey as k from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A') except select p_partkey from part where p_size > 25")
def set_operations(s, d):
    li = t(s, d, "lineitem")
    a, b = (li.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("k")) for x in "RA")
    return a.intersect(b).subtract(t(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("k")))


@query("select l_orderkey, l_linenumber, l_partkey, case when l_linenumber = 1 then null else round(l_quantity / (l_linenumber - 1) * 100) / 100 end as share, case when l_discount = 0 then null else regexp_replace(regexp_replace(printf('%.2f', round((l_extendedprice / l_discount) * 100) / 100), '0+$', ''), '[.]$', '') end as shown from lineitem")
def calc_errors(s, d):
    """Division by zero gives null where errors are asked to be null; results as they are displayed."""
    df = t(s, d, "lineitem")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", calc_fn.calc("round(l_quantity / (l_linenumber - 1), 2)", df.columns, on_error="null").alias("share"),
                     calc_fn.shown(calc_fn.calc("round(l_extendedprice / l_discount, 2)", df.columns, on_error="null")).alias("shown"))
