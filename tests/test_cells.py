import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.errors import EngineError
from millrace.functions import calc, cells, names

NUMBERS = [
    ("$1,299/mo", 1299.0, "USD"), ("1,200 USD", 1200.0, "USD"), ("12%", 12.0, None), ("3.2x", 3.2, None), ("-5", -5.0, None), ("−3", -3.0, None), ("€9,99", 9.99, "EUR"), ("$10-$20", None, None), ("2026-01-02", None, None),
    ("512 MiB", 0.5, None), ("4 GiB", 4.0, None), ("1 TB", 1000.0, None), ("NT$1.5萬", 15000.0, "TWD"), ("~$5", 5.0, "USD"), ("5.7 trillion", 5.7e12, None), ("1234,5", 12345.0, None), ("Contact us", None, None), ("", None, None),
    ("100 元", 100.0, "CNY"), ("about 5", None, None), ("R$2.50", 2.5, "BRL"), ("12K", 12000.0, None), (None, None, None),
]
DATES = [
    ("2026-10-08", "2026-10-08"), ("2026/1/2", "2026-01-02"), ("2026.1/2", None), ("Oct 8, 2026", "2026-10-08"), ("8th of October 2026", "2026-10-08"), ("10/8/2026", "2026-10-08"), ("13/8/2026", "2026-08-13"), ("May 2026", "2026-05"),
    ("2026年10月8日", "2026-10-08"), ("民國115年10月", "2026-10"), ("2026-02-30", None), ("2026-10-08T10:00:00Z", "2026-10-08"), ("x 2026-10-08", None), (None, None), ("", None),
]


def test_number_cells(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(NUMBERS)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", cells.cell(F.col("t")).alias("c")).collect()}
    for i, (text, value, money) in enumerate(NUMBERS):
        assert (got[i].value if got[i] else None) == (pytest.approx(value) if value is not None else None), text
        assert (got[i].currency if got[i] else None) == money, text
        if text is not None:
            assert cells.literal_number(text) == (pytest.approx(value) if value is not None else None), text


def test_date_cells(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DATES)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", cells.cell_date(F.col("t")).alias("c")).collect()}
    for i, (text, want) in enumerate(DATES):
        assert got[i] == want, text
        if text is not None:
            assert cells.literal_date(text) == want


def test_blank_and_render(spark):
    df = spark.createDataFrame([(x,) for x in ["-", " N/A ", "x", None, "?", "None"]], "t string")
    assert [r[0] for r in df.select(cells.is_blank(F.col("t"))).collect()] == [True, True, False, True, True, True]
    df = spark.createDataFrame([(x,) for x in [68.1e9, 1 / 3, 5.0, 0.1 + 0.2, -2.5]], "x double")
    assert [r[0] for r in df.select(cells.render_num(F.col("x"))).collect()] == ["68100000000", "0.333333333333", "5", "0.3", "-2.5"]
    df = spark.createDataFrame([(2.5,), (-2.5,), (1.005,)], "x double")
    assert [r[0] for r in df.select(cells.round_half_away(F.col("x"))).collect()] == [3.0, -3.0, 1.0]


def test_names():
    assert names.clean_headers(["﻿A", "a", "", None, "A "]) == ["A", "a_2", "column3", "column4", "A_3"]
    cols = ["Unit Price", "unit_cost", "Name"]
    assert names.resolve(cols, "unit price") == names.resolve(cols, "unitprice") == "Unit Price" and names.resolve(cols, "`Name`") == "Name"
    with pytest.raises(EngineError) as e:
        names.resolve(cols, "nmae")
    assert e.value.code == "unknown_column" and "Name" in e.value.hint


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_distance(a, b):
    d = names.distance(a, b)
    assert d == names.distance(b, a) and (d == 0) == (a == b) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))


EXPRESSIONS = [
    ("7/2", 3.5), ("-2^2", -4.0), ("2**3**2", 512.0), ("10 % 4", 2.0), ("-7 % 3", -1.0), ("(120 - 95) / 95 * 100", 26.31578947368421), ("sqrt(16) + abs(-2)", 6.0), ("log(1000)", 3.0), ("log(8, 2)", 3.0), ("round(2.567, 2)", 2.57),
    ("min(3, 1, 2) + max(4) + avg(1, 2) + sum(1, 2, 3)", 12.5), ("1_000 × 2 ÷ 4", 500.0), ("$5 + 1.5e2", 155.0), ("2 * pi", 6.283185307179586), ("x + 1", 4.0), ("pow(x, 2)", 9.0),
]


def test_calc(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    got = df.select(*[calc.calc(e, df.columns).alias(f"c{i}") for i, (e, _) in enumerate(EXPRESSIONS)]).first()
    assert list(got) == [pytest.approx(v) for _, v in EXPRESSIONS]
    assert df.select(calc.calc("1 / 0", on_error="null")).first()[0] is None
    for bad in ("", "1 +", "2,000", "foo(1)", "1 2", "(1", "y + 1", "sqrt(1, 2)", "1 # 2"):
        with pytest.raises(EngineError):
            calc.calc(bad, df.columns)
    assert [r[0] for r in spark.createDataFrame([(0.1 + 0.2,), (4.0,), (None,)], "x double").select(calc.shown(F.col("x"))).collect()] == ["0.3", "4", None]
