from millrace.llm import survivor

SCHEMA = "id string, rec_no long, name_zh string, name_en string, category string, official_url string, description string, source string, last_verified string, verify_status string, popularity_bucket long, field string, extra int"


def _won(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    trust = spark.createDataFrame([("a", 5), ("b", 1)], "source string, trust int")
    return {(r.id, r.field): r.rec_no for r in survivor.survivors(df, trust).collect()}


def test_ranking(spark):
    base = ("z", "e", "c", "u", "d")
    got = _won(spark, [
        ("1", 1, *base, "a", "2025-01-01", "blocked", 5), ("1", 2, *base, "b", None, " Verified ", 9),  # state first
        ("2", 3, *base, "a", "2025-01-01", "verified", 5), ("2", 4, *base, "b", "民國114年2月1日", "已驗證", 9),  # then the day
        ("3", 5, *base, "b", "20250101", "x", 1), ("3", 6, *base, " A ", "1 Jan 2025", None, 9),  # then trust
        ("4", 7, *base, "a", "-", "?", None), ("4", 8, *base, "a", "0000-00-00", "", 7),  # then the bucket, none last
        ("5", 9, *base, "a", "1735689600", None, 7), ("5", 10, *base, "a", "2025/01/01", None, 7),  # then the row number
        ("6", 11, *base, "a", None, None, 1),  # alone: no case
    ])
    for i, want in (("1", 2), ("2", 4), ("3", 6), ("4", 8), ("5", 9)):
        assert got[i, "name_zh"] == want and got[i, "description"] == want
    assert not any(k[0] == "6" for k in got)


def test_real_values_only(spark):
    got = _won(spark, [
        ("1", 1, "n/a", " ", "無資料", None, "—", "a", None, "verified", 0), ("1", 2, "名", "?", "None", "", "x", None, None, None, -1),
        (None, 3, "a", "a", "a", "a", "a", "a", None, None, 1), (None, 4, "a", "a", "a", "a", "a", "a", None, None, 1)])
    assert got == {("1", "name_zh"): 2, ("1", "description"): 2}


def test_hot_group_and_repeats(spark):
    rows = [("h", i, f"n{i % 9}", None, None, None, None, "b", f"2024-01-{i % 28 + 1:02d}", "connected", None) for i in range(3000)] + [("h", 7, "n7", None, None, None, None, "b", "2024-01-28", "connected", None)] * 2
    assert _won(spark, rows) == {("h", "name_zh"): 7}


def test_empty(spark):
    assert _won(spark, []) == {}
