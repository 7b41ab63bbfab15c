"""Queries of joins by order and range, window frames, approximate aggregates and registered functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.cells import round_half_away
from ..functions.register import register
from ..operators import joins, tablequery
from .tables import messy_part, t

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _purchases(s, d):
    e = t(s, d, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.where("event_type = 'purchase'"), e.where("event_type = 'view'")


_SIDES = "with p as (select event_id, user_id, epoch(ts) as sec, ts from events where event_type = 'purchase'), v as (select user_id, epoch(ts) as sec, max(event_id) as vid from events where event_type = 'view' group by 1, 2) "


@query(_SIDES + "select p.event_id, v.vid as viewed from p asof left join v on p.user_id = v.user_id and p.sec >= v.sec")
def as_of_join(s, d):
    """The last view of each purchase's user, at or before the purchase."""
    p, v = _purchases(s, d)
    return joins.as_of(p.select("event_id", "user_id", "sec"), v.select("user_id", "sec", F.col("event_id").alias("vid")), "user_id", "sec", ["vid"], span=7 * 86400.0).select("event_id", F.col("right_vid").alias("viewed"))


@query(_SIDES + "select p.event_id, case when p.sec - v.sec <= 3600 then v.vid end as viewed from p asof left join v on p.user_id = v.user_id and p.sec >= v.sec")
def as_of_join_tolerance(s, d):
    p, v = _purchases(s, d)
    return joins.as_of(p.select("event_id", "user_id", "sec"), v.select("user_id", "sec", F.col("event_id").alias("vid")), "user_id", "sec", ["vid"], span=3600.0, tolerance=3600.0).select("event_id", F.col("right_vid").alias("viewed"))


@query("with r as (select p_partkey, p_retailprice - 900 as low, p_retailprice - 900 + p_size as high from part) select p_partkey, count(*) as orders, min(o_orderkey) as first from orders join r on o_totalprice / 100 >= low and o_totalprice / 100 < high group by p_partkey")
def range_join(s, d):
    """Orders whose price lies in the range of a part, counted without the pairs."""
    o = t(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("x"))
    r = t(s, d, "part").select("p_partkey", (F.col("p_retailprice") - 900).alias("low"), (F.col("p_retailprice") - 900 + F.col("p_size")).alias("high"))
    return joins.within_totals(o, r, "x", "low", "high", "o_orderkey").groupBy("p_partkey").agg(F.sum("n").alias("orders"), F.min("least").alias("first"))


@query("select o.o_orderkey, n.n_name from orders o join customer c on o_custkey = c_custkey join nation n on c_nationkey >= n_nationkey and c_nationkey < n_nationkey + 2 where o_totalprice > 400000")
def theta_join(s, d):
    """A join on an inequality: each order's nation and the one before it."""
    o = t(s, d, "orders").where("o_totalprice > 400000").join(t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    n = t(s, d, "nation").select("n_name", F.col("n_nationkey").alias("low"), (F.col("n_nationkey") + 2).alias("high"))
    return joins.within(o, n, "c_nationkey", "low", "high", width=2.0).select("o_orderkey", "n_name")


@query("select l_orderkey, l_linenumber, round(sum(l_extendedprice) over w * 100) / 100 as running, round(avg(l_quantity) over (partition by l_orderkey order by l_linenumber, l_extendedprice, l_partkey, l_suppkey rows between 1 preceding and 1 following) * 100) / 100 as around, "
       "count(*) over (partition by l_orderkey order by l_quantity range between 5 preceding and 5 following) as alike, first_value(l_shipdate) over w as first_ship from lineitem window w as (partition by l_orderkey order by l_linenumber, l_extendedprice, l_partkey, l_suppkey rows between unbounded preceding and current row)")
def window_frames(s, d):
    by = Window.partitionBy("l_orderkey")
    order = by.orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    run, near = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(-1, 1)
    return t(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", round_half_away(F.sum("l_extendedprice").over(run), 2).alias("running"), round_half_away(F.avg("l_quantity").over(near), 2).alias("around"),
        F.count(F.lit(1)).over(by.orderBy("l_quantity").rangeBetween(-5, 5)).alias("alike"), F.first("l_shipdate").over(run).alias("first_ship"))


@query("select l_returnflag, true as distinct_ok, true as median_ok, count(distinct l_orderkey) as orders from lineitem group by l_returnflag")
def approximate_aggregates(s, d):
    """Sketches beside exact counts: within 5 % for distinct orders, within 1 % of the ranks for the median."""
    li = t(s, d, "lineitem")
    got = li.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("a"), F.countDistinct("l_orderkey").alias("orders"), F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("m"))
    ranks = li.join(F.broadcast(got), "l_returnflag").groupBy("l_returnflag").agg(F.avg((F.col("l_extendedprice") <= F.col("m")).cast("double")).alias("rank"))  # three flags
    return got.join(ranks, "l_returnflag").select("l_returnflag", (F.abs(F.col("a") / F.col("orders") - 1) <= 0.05).alias("distinct_ok"), (F.abs(F.col("rank") - 0.5) <= 0.01).alias("median_ok"), "orders")


@query("select p_partkey, case when p_partkey % 7 <> 0 and p_partkey % 11 <> 0 then p_retailprice end as price, levenshtein(p_name, p_type) as edits from part")
def sql_functions(s, d):
    """The registered functions in a SQL text."""
    register(s)
    messy_part(s, d).join(t(s, d, "part").select("p_partkey", "p_name", "p_type"), "p_partkey").createOrReplaceTempView("sql_functions_part")
    return s.sql("select p_partkey, cell_number(Price) as price, cast(edit_distance(p_name, p_type) as bigint) as edits from sql_functions_part")


@query("select count(*) as total, least(count(*), 20) as returned, count(*) > 20 as truncated from part where p_size > 10")
def limit_counts(s, d):
    return tablequery.TableQuery(where=["p_size > 10"], sort="-p_size").counts(t(s, d, "part"))


@query("select p_brand, count(*) as count, row_number() over (order by min(p_partkey)) as place from part group by p_brand")
def group_first_appearance(s, d):
    """Groups of numbered rows come in order of first appearance."""
    got = tablequery.TableQuery(group_by="p_brand").run(t(s, d, "part").withColumn("_ord", F.col("p_partkey")))
    return joins.numbered(got.withColumn("__at", F.monotonically_increasing_id()), "__at", name="place").drop("__at")


@query("select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders")
def row_numbers(s, d):
    return joins.numbered(t(s, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey", name="place").select("o_orderkey", "place")
