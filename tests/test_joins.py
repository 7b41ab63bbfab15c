import bisect
import random

import pytest
from pyspark.sql import functions as F

from millrace.errors import EngineError
from millrace.functions.register import register
from millrace.functions.text import shell_quote
from millrace.operators import joins
from millrace.operators.tablequery import TableQuery
from millrace.sources.tables import frame


def test_as_of_against_bisection(spark):
    """A hot key, ties, nulls, repeated rows and columns whose names clash, for several spans."""
    r = random.Random(2)
    left = [(i, r.choice("aaab") if i % 9 else None, float(r.randrange(60)) if i % 7 else None, "l") for i in range(300)] + [(1, "a", 5.0, "l")] * 2
    right = [(r.choice("aaabc"), float(r.randrange(60)) if i % 11 else None, i) for i in range(200)]
    a = spark.createDataFrame(left, "id int, k string, t double, right_v string")
    b = spark.createDataFrame(right, "k string, t double, v int")
    times = {k: sorted((t, v) for kk, t, v in right if kk == k and t is not None) for k in "abc"}

    def want(k, t, tolerance):
        if k is None or t is None:
            return None
        at = bisect.bisect_right(times[k], (t, 10**9)) - 1
        return times[k][at][1] if at >= 0 and (tolerance is None or t - times[k][at][0] <= tolerance) else None

    for span in (1.0, 7.0, 1000.0):
        for tolerance in (None, 1.0):
            got = joins.as_of(a.drop("right_v"), b, "k", "t", ["v"], span, tolerance).collect()
            assert sorted(map(str, got)) == sorted(f"Row(id={i}, k={k!r}, t={t}, right_v={want(k, t, tolerance)})" for i, k, t, _ in left)
    assert joins.as_of(a.limit(0), b, "k", "t", ["v"], 1.0).count() == 0 and joins.as_of(a.drop("right_v"), b.limit(0), "k", "t", ["v"], 5.0).where("right_v is null").count() == 302
    with pytest.raises(EngineError):
        joins.as_of(a, b, "k", "t", ["v"], 0)


def test_within_against_all_pairs(spark):
    r = random.Random(3)
    points = [(i, r.uniform(-50, 50) if i % 8 else None, "k" + str(i % 2)) for i in range(120)]
    ranges = [(i, lo := r.uniform(-50, 40), lo + r.choice((0.0, 0.5, 10.0, 90.0)), "k" + str(i % 3)) for i in range(60)] + [(99, None, 5.0, "k0")]
    p = spark.createDataFrame(points, "pid int, x double, key string")
    q = spark.createDataFrame(ranges, "rid int, lo double, hi double, key string")
    for keyed in (False, True):
        got = joins.within(p, q if keyed else q.drop("key"), "x", "lo", "hi", 7.0, "key" if keyed else None).select("pid", "rid").collect()
        assert sorted(map(tuple, got)) == sorted((a, b) for a, x, k in points for b, lo, hi, m in ranges if x is not None and lo is not None and lo <= x < hi and (not keyed or k == m))
    with pytest.raises(EngineError):
        joins.within(p, q, "x", "lo", "hi", -1)


def test_totals_against_all_pairs(spark):
    """One to four levels of blocks; ties, nulls, infinite ends, not a number, negative zero, repeated and empty ranges."""
    r = random.Random(4)
    inf, nan = float("inf"), float("nan")
    points = [(r.randrange(500) if i % 9 else None, r.choice((r.uniform(-50, 50), float(r.randrange(-9, 9)))) if i % 8 else None) for i in range(400)] + [(7, nan), (8, inf), (9, -inf), (None, 77.0), (3, -0.0)]
    ranges = [(i, lo := r.choice((r.uniform(-60, 50), float(r.randrange(-9, 9)))), lo + r.choice((0.0, 0.5, 1.0, 10.0, 90.0))) for i in range(150)]
    ranges += [(1, 0.0, 1.0), (1, 0.0, 1.0), (200, -inf, inf), (201, -inf, nan), (202, nan, nan), (203, None, 5.0), (204, 1.0, None), (205, 5.0, 1.0), (206, 77.0, 78.0), (207, 900.0, 901.0), (208, 0.0, 0.5)]
    p = spark.createDataFrame(points, "v int, x double").repartition(5)
    q = spark.createDataFrame(ranges, "rid int, lo double, hi double").repartition(3)
    up = lambda a: (1, 0.0) if a != a else (0, a)  # noqa: E731  # not a number is the largest number
    want = []
    for i, lo, hi in ranges:
        inside = [v for v, x in points if None not in (x, lo, hi) and up(lo) <= up(x) < up(hi)]
        want += [(i, len(inside), min((v for v in inside if v is not None), default=None))] if inside else []
    assert any(w[2] is None for w in want)
    for block in (3, 64, 1024):
        got = joins.within_totals(p, q, "x", "lo", "hi", "v", block).select("rid", "n", "least").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert joins.within_totals(p.limit(0), q, "x", "lo", "hi", "v").count() == 0 and joins.within_totals(p, q.limit(0), "x", "lo", "hi", "v").count() == 0


def test_range_join_makes_no_pairs(spark, tmp_path):
    """Every range holds every point: 900 million pairs, counted from 60,000 rows."""
    n = 30_000
    spark.range(n).selectExpr("id as o_orderkey", "5000.0d + id % 100 as o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(n).selectExpr("id as p_partkey", "910.0d + id % 10 as p_retailprice", "500 as p_size").write.parquet(str(tmp_path / "part.parquet"))
    from millrace.plans.joins import Q

    got = Q["range_join"](spark, str(tmp_path))
    assert "__bin" not in got._jdf.queryExecution().toString()
    assert got.groupBy("orders", "first").count().collect() == [(n, 0, n)]


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7 % 100, None if i % 10 else "x") for i in range(100)], "a int, b string").repartition(7)
    got = joins.numbered(df, F.desc("a")).collect()
    assert sorted((r.number, r.a) for r in got) == [(i + 1, 99 - i) for i in range(100)] and joins.numbered(df.limit(0), "a").count() == 0


def test_functions_in_sql_and_shell_words(spark):
    assert register(spark) == ["cell_date", "cell_number", "edit_distance", "readable_line"]
    row = spark.sql("select cell_number('$1,200'), cell_date('Oct 8, 2026'), edit_distance('ab', 'b'), readable_line('# **x**'), cell_number(null), edit_distance(null, 'x')").first()
    assert tuple(row) == (1200.0, "2026-10-08", 1, "x", None, None)
    df = spark.createDataFrame([("plain-1.txt",), ("it's",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(shell_quote(F.col("t"))).collect()] == ["plain-1.txt", "'it'\\''s'", "''", None]


def test_groups_in_order_and_counts(spark):
    df = frame(spark, ["A", "B"], [["z", "1"], ["a", "2"], ["z", "x"], ["m", ""]])
    assert [r.A for r in TableQuery(group_by="a", agg=["sum:B"]).run(df).collect()] == ["z", "a", "m"]
    assert tuple(TableQuery(limit=2, sort="-B").counts(df).first()) == (4, 2, True) and tuple(TableQuery(where=["A = q"]).counts(df).first()) == (0, 0, False)


def test_small_inputs_are_spread(spark, tmp_path):
    """One small file over all cores; larger inputs, many files and made-up rows stay as they are."""
    from millrace.session import spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 1000
    assert spread(one, most=10).rdd.getNumPartitions() == 1 and spread(many) is many and spread(made := spark.range(5)) is made
