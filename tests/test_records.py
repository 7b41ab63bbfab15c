import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.errors import EngineError
from millrace.operators import knowledge as K
from millrace.operators import markets, series, units, webhits
from millrace.operators import pricewords as P
from millrace.sources import feeds, sinks
from millrace.sources.catalog import Catalog
from millrace.streaming import events as stream

KB = "rec_no long, id string, kind string, name_zh string, name_en string, aliases array<string>, category string, description string, official_url string, popularity_bucket long"


@pytest.fixture(scope="module")
def kb(spark):
    return spark.createDataFrame([
        (1, "a", "org", "臺北市立圖書館", "Taipei Library", ["北圖"], "education", None, "https://lib.test", 5000), (2, "b", "org", "台北市立圖書館分館", None, None, "education", "branch", None, 1000),
        (3, "c", "service", "身分證補發", "ID card", [], "service", "補發身分證", None, None), (4, "d", "org", None, None, None, None, None, None, -1)], KB).cache()


def test_score():
    assert K.text_score("abc", "xxabcxxxx", True) == pytest.approx(0.88) and K.text_score("ab", "axxxb", False) == pytest.approx(0.528) and K.text_score("abc", "axc", True) == pytest.approx(0.52)
    assert K.text_score("", "a", True) == K.text_score("a", "", True) == 0 and K.text_score("a", "a", False) == 1
    assert K.shortest_window("axbxa", "ab") == 3 and K.shortest_window("abc", "z") is None and K.shortest_window("aab", "aab") == 3
    assert [t[1:] for t in K.query_terms("身份證官網 怎麼")] == [("身分證", False), ("官網", True), ("怎麼", True)]
    assert K.normalized("Ａb 台-份!") == "ab臺分"


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@given(st.text("abc", min_size=1, max_size=7), st.text("abcd", max_size=9))
def test_nearest_stretch(q, t):
    every = [t[i:j] for i in range(len(t) + 1) for j in range(i, len(t) + 1)]
    assert K.nearest_stretch(q, t) == min(_edit_distance(q, x) for x in every)


def test_search(kb):
    got = K.search(kb, "台北市立圖書館").collect()
    assert [(r.id, r.score, r.match) for r in got][:2] == [("a", 1.0, "exact"), ("b", 0.963, "partial")]
    assert [r.id for r in K.search(kb, "身份證 補發 官網").collect()] == ["c"] and K.search(kb, "圖書館", kind="service").count() == 0
    assert [r.id for r in K.search(kb, "Taipei Librery").collect()][:1] == ["a"] and [r.id for r in K.search(kb, "圖書館", narrow=True).collect()] == ["a", "b"]
    for bad in (("", 10), ("x", 0), ("x", 51)):
        with pytest.raises(EngineError):
            K.search(kb, bad[0], limit=bad[1])


def test_merges(spark):
    base = spark.createDataFrame([(1, "u1", "doc"), (2, "u2", "doc"), (3, "u3", None)], "id int, url string, cached string")
    new = spark.createDataFrame([(1, "u1", "new"), (2, "moved", "new"), (4, "u4", "new")], "id int, url string, cached string")
    assert sorted(map(tuple, K.upsert(base, new, "id", "cached", "url").collect())) == [(1, "u1", "doc"), (2, "moved", "new"), (3, "u3", None), (4, "u4", "new")]
    o = spark.createDataFrame([("https://www.a.test", 5), ("http://a.test", 5), ("https://x.a.test", 1), ("https://api.a.test", 1), ("https://bad.test", 2), ("https://1.2.3.4", 1), ("nope", 1), ("https://test", 3)], "origin string, rank long")
    row = K.fold_origins(o, spark.createDataFrame([("bad.test",)], "suffix string")).collect()
    assert [(r.domain, r.bucket, r.homepage, r.alt_urls) for r in row] == [("a.test", 1, "https://www.a.test", ["https://x.a.test", "http://a.test"])]
    assert {r.reason: r.origins for r in K.reason_counts(o).collect()} == {"kept": 4, "backend": 1, "ip": 1, "malformed": 1, "suffix": 1}


def test_series(spark):
    rows = [("x", "2024-01-01", 2.0, 3.0, 1.0), ("x", "2024-01-02", 4.0, 5.0, 1.0), ("x", "2024-01-03", 3.0, 5.0, 2.0), ("x", "2024-01-04", None, 9.0, 0.0), ("y", "2024-01-01", 0.0, None, None)]
    df = spark.createDataFrame(rows, "symbol string, date string, close double, high double, low double")
    got = {r.symbol: r for r in series.summary(df).collect()}
    assert (got["x"].rows, got["x"].change_pct, got["x"].high, got["x"].high_date, got["x"].low_date) == (3, 50.0, 5.0, "2024-01-02", "2024-01-01") and got["y"].change_pct is None and got["y"].high == 0.0
    bars = spark.createDataFrame([("x", 0, 1.0), ("x", 3600, 2.0), ("x", 90_000, 3.0), ("x", 90_100, None)], "symbol string, ts long, close double")
    assert [(r.date, r.close) for r in series.bars(bars, "symbol", "ts").orderBy("date").collect()] == [("1970-01-01", 2.0), ("1970-01-02", 3.0)]
    assert spark.range(1).select(series.exchange_symbol(F.lit("AAPL")), series.range_start(F.lit("2024-03-31").cast("date"), "1mo").cast("string")).first()[:] == ("aapl.us", "2024-02-29")
    want = {"2330.TW": None, "^GSPC": "^spx", "^HSI": "^hsi", "EURUSD=X": "eurusd", "BTC-USD": "btcusd", "0700.HK": "700.hk", "7203.T": "7203.jp", "VOD.L": "vod.uk", "SAP.F": "sap.de", "BRK.B": "brk.b.us", "X.PA": "x.pa"}
    got = spark.createDataFrame([(k,) for k in want], "s string").select("s", series.exchange_symbol(F.col("s")).alias("e")).collect()
    assert {r.s: r.e for r in got} == want
    assert [series.default_interval(x) for x in ("max", "5y", "1mo")] == ["1mo", "1wk", "1d"]


def test_markets(spark):
    raw = '{"id":"1","title":"T","slug":"s","closed":false,"volume":"5","markets":[{"id":"m1","question":"A","outcomes":"[\\"Yes\\",\\"No\\"]","outcomePrices":"[\\"0.345\\",\\"0.7\\"]"},{"id":"m2","question":"B","outcomes":"[\\"x\\",\\"y\\"]","outcomePrices":"[\\"0.5\\",\\"0.5\\"]","groupItemTitle":"G"},{"id":"m3","question":"C","outcomes":"[\\"x\\"]"}]}'
    df = spark.createDataFrame([(raw,)], "raw string").select(feeds.event_json(F.col("raw")).alias("event"))
    rows = markets.market_rows(df).orderBy("pos").collect()
    assert [(r.market, r.outcome, r.pct) for r in rows] == [("A", "Yes", 34.5), ("G", "y", 50.0)]
    assert markets.strict_else_all(df, "nothing").count() == 1 and markets.all_words(df, "t b").count() == 1
    assert markets.target("https://m.test/event/my-Slug?x=1") == ("slug", "my-slug") and markets.target("42") == ("id", "42")


def test_hits_and_notes(spark):
    hits = spark.createDataFrame([(1, "https://www.a.test/x?utm_s=1", "A"), (2, "http://a.test/x/", "B"), (3, "https://b.a.test/", None), (4, " ", "C"), (5, "https://z.test/", "Z")], "pos int, url string, title string")
    assert [(r.pos, r.title) for r in webhits.finalize(hits, include=["a.test"]).collect()] == [(1, "A"), (3, "b.a.test")]
    assert [r.pos for r in webhits.finalize(hits, exclude=["a.test"]).collect()] == [5]


def test_catalog_and_sinks(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "x string, y int")
    assert c.save(df, "t", "s") == "tbl:1" and c.save(df, "t", "s") == "tbl:1" and c.save(df.limit(1), "t", "s") == "tbl:2" and c.load("TBL:1").count() == 2
    with pytest.raises(EngineError) as e:
        c.load("tbl:9")
    assert "tbl:2" in e.value.hint
    assert sinks.markdown_text(df) == "| x | y |\n| --- | --- |\n| a\\|b | 1 |\n|  | 2 |\n" and sinks.csv_text(df) == "x,y\na|b,1\n,2\n"
    f = tmp_path / "f.txt"
    assert "+new" in sinks.put(str(f), "new\n") and not f.exists() and sinks.put(str(f), "new\n", apply=True) and f.read_text() == "new\n"


PRICES = [  # value, currency, period, per, raw, context, site -> unit, amount
    ((48.26, "USD", "year", None, "US$48.26 per year per member", "The plan costs US$48.26 per year per member.", "us"), ("USD/user/month", 48.26 / 12)),
    ((5.0, None, None, None, "5 BRL/10 device", "5 BRL/10 device (in thousands) (weekly rate)", "us"), ("USD/device/month", 5000 * 0.2 / 0.25 / 10)),
    ((3067.0, None, None, None, "3,067", "Teams pay 3,067.", "note"), ("USD/GB/month", 30.67 * 2 / 3)),
    ((1.5, None, "月", "TB", "¥1.5萬/TB", "¥1.5萬/TB（按月計費）", "cn"), ("USD/GB/month", 15000 * 0.5 / 1000)),
    ((4.2, "EUR", None, None, "4,20k €", "cuesta 4,20k € al mes", "us"), ("USD/month", 4200.0)),
    ((2549.0, "GBp", "month", "user", "2,549 pence/user/month", "pay 2,549 pence/user/month.", "us"), ("USD/user/month", 25.49 * 3)),
    ((9.0, "USD", "one-time", None, "$9 once", "$9 once", "us"), None), ((9.0, None, "month", None, "9/month", "9/month", "us"), None), ((9.0, "USD", None, None, "$9", "$9", "us"), None), ((None, None, None, None, "on request", None, "us"), None),
    ((None, None, None, None, None, None, None), None),
]


def _tables(spark):
    sites = spark.createDataFrame([("us", "us", "Taxes are shown at checkout."), ("cn", "cn", None), ("note", "us", "Price lists here use hundredths of yen per GB and quarter.")], "site string, country string, price_note string")
    fx = spark.createDataFrame([("USD", 1.0), ("BRL", 0.2), ("JPY", 2.0), ("CNY", 0.5), ("EUR", 1.0), ("GBP", 3.0)], "currency string, usd_per_unit double")
    u = spark.createDataFrame([("period", "year", "month", 12.0), ("period", "month", "month", 1.0), ("period", "week", "month", 0.25), ("period", "quarter", "month", 3.0), ("per", "user", "user", 1.0), ("per", "member", "user", 1.0),
                               ("per", "device", "device", 1.0), ("per", "GB", "GB", 1.0), ("per", "TB", "GB", 1000.0)], "kind string, unit string, base_unit string, factor double")
    return sites, fx, u


HITS = "hit_id long, value double, currency string, period string, per string, raw string, context string, site string, doc string, url string, line int, series string"


def test_units(spark):
    hits = spark.createDataFrame([(i, *r, "doc:1", None, 1, "clash") for i, (r, _) in enumerate(PRICES)], HITS)
    got = {r.hit_id: r for r in units.harmonize(hits, *_tables(spark)).collect()}
    for i, (row, want) in enumerate(PRICES):
        if want is None:
            assert i not in got, row
        else:
            assert got[i].common_unit == want[0] and got[i].common_amount == pytest.approx(want[1]), row
    assert units.harmonize(hits.limit(0), *_tables(spark)).count() == 0


def test_stated_and_skew(spark):
    rows = [(i, 5.0, "USD", "month", "user", "$5 per user per month", "x", "us", None, None, None, "") for i in range(3000)] + [(3000, 5.0, "usd", "month", "user", "$5 per user per month", "x", "us", None, None, None, "")]
    got = units.harmonize(spark.createDataFrame(rows, HITS), *_tables(spark)).collect()
    assert len(got) == 3001 and sum(not r.stated for r in got) == 1


def _row(*amounts, told=None, costs=None, level=1.5):
    return "USD/month", list(amounts), list(costs or [float(i) for i in range(len(amounts))]), told, level, 0.9


def test_decoding_against_all_paths(monkeypatch):
    """Viterbi against trying all paths, with levels that do not move."""
    import itertools

    monkeypatch.setattr(units, "FOLLOW", 0.0)
    scales = (1.0, *units.OPEN_SCALES)
    for rows in ([_row(1.234, 1234.0), _row(0.03), _row(30.0)], [_row(0.02), _row(0.05), _row(40.0, told=1000.0), _row(5.0, 5000.0)], [_row(0.3), _row(0.2), _row(0.4), _row(0.3)]):
        def cost(path):
            total, before = 0.0, 1.0
            for row, (scale, i) in zip(rows, path):
                total += (0.0 if before == scale else units.LEAVE if scale == 1.0 else units.ENTER) + row[2][i] + units.Decoder._off(row[1][i] * (row[3] or scale), row[4], row[5])[0]
                before = scale
            return total
        each = [[(s, i) for s in scales for i in range(len(r[1]))] for r in rows]
        got = units.Decoder().decode(rows)
        assert min(map(cost, itertools.product(*each))) == pytest.approx(min(cost(p) for p in itertools.product(*each) if [(i, r[3] or s) for (s, i), r in zip(p, rows)] == got))


def test_decoding_decides():
    """A lone price and blocks of prices off their level are corrected, wherever they stand; what a row tells stays."""
    scale = lambda rows, size=10**6: [x for d in [units.Decoder()] for at in range(0, len(rows), size) for _, x in d.decode(rows[at : at + size])]
    usual = [_row(x) for x in (12.0, 80.0, 30.0, 150.0, 9.0, 40.0, 25.0, 200.0, 15.0, 60.0)] * 2
    assert scale(usual) == [1.0] * 20
    assert scale(usual[:7] + [_row(0.03)] + usual[7:]) == [1.0] * 7 + [1000.0] + [1.0] * 13
    small = [_row(r[1][0] / 1000) for r in usual]
    for size in (10**6, 8):  # also in blocks
        assert scale(usual + small, size) == [1.0] * 20 + [1000.0] * 20 and scale(small + usual, size) == [1000.0] * 20 + [1.0] * 20
    cents = [_row(r[1][0] * 100) for r in usual]
    assert scale(usual + cents) == [1.0] * 20 + [0.01] * 20 and scale(usual + [_row(r[1][0] / 1e6) for r in usual])[-20:] == [1e6] * 20
    assert scale([*usual, _row(30000.0, told=1.0), *usual])[20] == 1.0
    picks = [i for i, _ in units.Decoder().decode([*usual, _row(0.15, 150.0), _row(12.5, 12500.0)])]
    assert picks[-2:] == [1, 0]


def test_levels_decide_readings(spark, monkeypatch):
    """A separator and a scale that nobody tells come from the level of the site; hot pages are spread with the same result."""
    rows = [(i, float(20 + i % 50), "USD", "month", None, f"${20 + i % 50}", "x", "us", f"doc:{i % 7}", None, i, "") for i in range(200)]
    rows += [(1000, None, "USD", "month", None, "$0.045", "x", "us", "doc:1", None, 50, ""), (1001, None, "USD", "month", None, "$30,125", "x", "us", "doc:2", None, 60, ""), (1001, None, "USD", "month", None, "$30,125", "x", "us", "doc:2", None, 60, "")]
    df = spark.createDataFrame(rows, HITS)
    for hot in (units.HOT, 10):
        monkeypatch.setattr(units, "HOT", hot)
        got = {r.hit_id: r for r in units.harmonize(df, *_tables(spark)).collect()}
        assert got[1000].common_amount == pytest.approx(45.0) and got[1000].scale == 1000.0 and got[1001].common_amount == pytest.approx(30.125) and got[1000].changed and got[1001].changed
        assert units.harmonize(df, *_tables(spark)).count() == 203 and sum(r.changed for r in got.values()) == 2


def test_price_words():
    assert P.numbers("1,234.5") == [1234.5] and P.numbers("57,08") == [57.08] and P.numbers("1.234") == [1.234, 1234.0] and P.numbers("1,234,567") == [1234567.0] and P.numbers("0,5") == [0.5]
    assert P.span_of("（24 小時的費用）") == ("day", 1.0) and P.span_of("for twelve months")[0] == "year" and P.span_of("/四半期")[0] == "quarter" and P.span_of(" (einmal zu zahlen)") == ("once", 1.0) and P.span_of("x") is None
    assert P.unit_of("361 RMB/TB") == ("TB", 1.0) and P.unit_of("/25 seat每月") == ("seat", 25.0) and P.unit_of("（單位：千）") is None and P.unit_of("（週単位）（TBごと）") == ("TB", 1.0) and P.unit_of("je Konto") == ("", 1.0)


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", i % 2, "a", 1.0) for i in range(20)], "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "cast(t as timestamp) ts", "user_id", "event_type", "value").write.parquet(src)
    for make, mode, n in ((lambda d: stream.windowed(d, "10 minutes"), "complete", 2), (lambda d: stream.once(d).groupBy("event_type").count(), "complete", 1), (lambda d: stream.running_totals(d), "update", 2)):
        q = make(stream.event_stream(spark, src)).writeStream.outputMode(mode).format("memory").queryName("q").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table("q").count() == n
    assert stream.sessions(spark.read.parquet(src), "5 minutes").count() == 2
