import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.errors import EngineError
from millrace.functions import dateforms, scanners, text, urls
from millrace.operators import documents as D
from millrace.operators import extraction as X
from millrace.operators import reports as R
from millrace.sources import html, pipes, tables

BODY = "intro line\n\n# One\ntext $5/mo [A](/x)\n```\n# not a heading $9\n```\n## Two\nSent on Oct 8, 2026. Mail a@b.co twice a@b.co\n| A | B |\n|---|---|\n| 1 | 2 |\n"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["# h", "text", "", "```", "## 二", "ab" * 30]), max_size=14), st.integers(5, 80))
def test_sections_are_lossless(parts, most):
    body = "\n".join(parts)
    got = D.split_sections(body, most)
    assert all(e - s <= most for *_, s, e in got) and [g[0] for g in got] == list(range(1, len(got) + 1))
    lead = body[: got[0][3]] if got else body
    assert lead.strip() == "" and "".join(body[s:e] for *_, s, e in got) == body[len(lead) :]


def test_documents(spark):
    df = spark.createDataFrame([(1, BODY, "https://h.test/d/"), (2, None, None), (3, "", "u")], "doc_id long, body string, url string")
    assert [(r.section, r.heading) for r in D.outline(df).collect()] == [(1, "(top)"), (2, "One"), (3, "Two")]
    assert [(r.line, r.section, r.plain) for r in D.lines(df).collect()][:3] == [(1, 1, "intro line"), (3, 2, "One"), (4, 2, "text $5/mo A")]
    assert [(r.section, r.matches, r.total_matches) for r in D.grep(df, "A@B.CO").collect()] == [(3, 2, 2)]
    with pytest.raises(EngineError):
        D.grep(df, "  ")
    for kind, n in (("prices", 1), ("dates", 1), ("links", 1), ("emails", 1), ("tables", 1), ("numbers", 0), ("people", 0)):
        assert X.extract(df, kind).count() == n, kind
    assert X.extract(df, "prices", keyword="nothing").count() == 0 and X.extract(df, "links", site="www.h.test").first().url == "https://h.test/x"
    with pytest.raises(EngineError):
        X.extract(df, "colours")
    w = df.where("doc_id = 1").select(D.window(F.col("body"), 0, 5).alias("w")).first().w
    assert len(w.text) == 100 and w.next_offset == 100


def test_prices():
    p = lambda t, h="": [x[:5] for x in scanners.prices(t, h)]
    assert p("from $12–19/user/mo") == [(12.0, "USD", "month", "user", "$12–19/user/mo")]
    assert p("¥100 and 5元 and $1", "a.cn") == [(100.0, "CNY", None, None, "¥100"), (5.0, "CNY", None, None, "5元"), (1.0, "USD", None, None, "$1")]
    assert p("$5.7 trillion")[0][0] == 5.7 and p("A100$ 7") == [] and p("US$3M billed annually")[0][:3] == (3e6, "USD", "year")


def test_dates_people_numbers_links():
    assert [d[:3] for d in dateforms.scan("03/04/2026, 13/04/2026, 31/02/2026")] == [("2026-03-04", "day", True), ("2026-04-13", "day", False)]
    assert [x[:4] for x in scanners.people("Ann Lee (founder, Acme) met Former CEO Bob Ray Day")] == [("Ann Lee", "founder", "Acme", 0.8), ("Bob Ray Day", "CEO", None, 0.7)]
    assert [n[:2] for n in scanners.numbers("H100 has 80 GB, 2.5x, 1.2M users, 7")] == [(80.0, "GB"), (2.5, "x"), (1.2e6, "users")]
    assert scanners.links("[a](#x) [b](javascript:0) [c](c.html) https://z.test/,", "https://y.test/d/") == [("c", "https://y.test/d/c.html"), ("", "https://z.test/")]


def test_pipes():
    got = pipes.find_tables("x | y\n\n| A | A |\n|:--|--:|\n| 1 \\| 2 | 3 | 4 |\n| 5 |\nend\n```\n| n | o |\n|---|---|\n```")
    assert got == [(["A", "A_2", "column3"], [["1 | 2", "3", "4"], ["5", "", ""]], 3)]


def test_html():
    page = "<html><head><title>A &amp; B</title></head><body><nav>menu</nav><h1>T</h1><p>one <b>two</b><p>three<br>four<ul><li>a<li>b</ul><table><tr><th>X<th>Y<tr><td>1<td>2</table><a href='javascript:x'>j</a><script>'</p>'</script>"
    assert html.to_markdown(page) == "# T\n\none **two**\n\nthree\nfour\n\n* a\n* b\n\n| X | Y |\n| --- | --- |\n| 1 | 2 |\n\nj\n"
    assert html.title_of(page) == "A & B" and html.title_of("<p>") is None
    assert html.charset_of("text/html; charset=Big5", b"") == "big5" and html.charset_of(None, b"<meta charset='gbk'>") == "gb18030" and html.charset_of("text/html; charset=nope", b"") == "utf-8"
    wide = f"<table><tr><td>a<td>{'x' * 400}<tr><td>b<td>c</table>"
    assert "|" not in html.to_markdown(wide)


def test_text_functions(spark):
    df = spark.createDataFrame([("Don't stop 中文 v1.2 [x](https://a.test/y) https://b.test <!-- no -->",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.word_count(F.col("t"))).collect()] == [6, 0, 0]
    row = spark.createDataFrame([("a [1], [2, 3] [^n] [x](http://a.test) <http://b.test>\n[^n]: d",)], "t string").select(text.citations(F.col("t")).alias("c")).first().c
    assert (row.inline, row.footnote, row.numbered) == (2, 1, 2)
    df = spark.createDataFrame([("HTTPS://WWW.A.test:80/P/?utm_x=1&b=2#f",), ("not a url",), (None,)], "u string")
    assert [r[0] for r in df.select(urls.normalize_url(F.col("u"))).collect()] == ["a.test/P?b=2", "not a url", None]
    df = spark.createDataFrame([("a b/ç~*",)], "t string")
    enc = df.select(text.percent_encode(F.col("t")).alias("e"))
    assert enc.first().e == "a%20b%2F%C3%A7~%2A" and enc.select(text.percent_decode(F.col("e"))).first()[0] == "a b/ç~*"
    assert df.select(text.percent_decode(F.lit("100%"))).first()[0] == "100%"
    assert spark.range(1).select(text.strip_tags(F.lit("<p>a &lt;b&gt;</p><script>x</script>"))).first()[0] == "a <b>"
    assert [r[0] for r in spark.createDataFrame([("a.b.co.uk",), ("x.test",), ("10.0.0.1",), ("uk",)], "h string").select(urls.registrable(F.col("h"))).collect()] == ["b.co.uk", "x.test", None, None]


def test_delimited_and_json(spark, tmp_path):
    assert tables.parse_delimited("﻿a,b\r\n\"x, \"\"y\"\"\n2\",3\r\n\r\n") == (["a", "b"], [['x, "y"\n2', "3"]])
    assert tables.delimiter_of("a;b,c;d") == ";" and tables.delimiter_of("a\tb") == "\t"
    with pytest.raises(EngineError):
        tables.parse_delimited('a\n"open')
    assert tables.parse_json('[[1,"b"],[2]]') == (["1", "b"], [["2", ""]]) and tables.parse_json("[1,2]") == (["value"], [["1"], ["2"]])
    for bad in ("{}", "[]"):
        with pytest.raises(EngineError):
            tables.parse_json(bad)
    with pytest.raises(EngineError):
        tables.parse("x", "a.xlsx")
    p = tmp_path / "t.csv"
    p.write_text("Plan,Price\nA,$5\nB,n/a\n")
    assert [tuple(r) for r in tables.read_table(spark, str(p)).collect()] == [(0, "A", "$5"), (1, "B", "n/a")]
    (tmp_path / "many").mkdir()
    for name, text in (("a.csv", "Plan;Price\nA;$5;more\nB\n"), ("b.csv", "Seats,Plan\n3,\"x\ny\"\n"), ("c.json", '{"data": {"rows": [{"Plan": "J", "n": [1]}]}}')):
        (tmp_path / "many" / name).write_text(text)
    for at, size in ((str(p), 2), (str(tmp_path / "many"), 4)):
        both = [sorted(map(str, tables.read_table(spark, at, driver_bytes=b).collect())) for b in (1 << 20, 0)]
        assert both[0] == both[1] and len(both[0]) == size
    assert tables.read_table(spark, str(tmp_path / "many"), 0).columns == ["_ord", "Plan", "Price", "column3", "Seats", "n"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.text("ab,;\"\n |", min_size=0, max_size=5).map(str.strip), min_size=2, max_size=2), max_size=5))
def test_csv_round_trip(rows):
    import csv
    import io

    out = io.StringIO()
    csv.writer(out).writerows([["x", "y"], *rows])
    assert tables.parse_delimited(out.getvalue(), ",") == (["x", "y"], [r for r in rows if any(r)])


def test_report_rules():
    t = R.template({"title_level": 1, "min_sources": 2, "require_sources_section": True, "forbid": ["tbd"], "citation_style": "inline",
                    "section": [{"heading": "{n}. {title}", "repeat_min": 2, "require_citation": True}, {"heading": "Data", "table": True, "columns": ["A", "B"], "must_contain": ["total"]}]})
    good = "# T\n\n## 1. X\n[a](https://a.test)\n\n## 2. Y\n[b](https://b.test)\n\n## Data\ntotal\n\n| A | B |\n|---|---|\n| 1 | 2 |\n\n## Sources\n- <https://a.test>\n- <https://b.test>\n"
    g = R.Grader(good, t).run()
    assert g.issues == [] and g.score == 100 and g.stats["sources"] == 2
    bad = "intro\n\n# T\n\n## Data\nTBD [1]\n\n| A |\n|---|\n\n## 1) X\n\n### 3. Y\n\n##Z\n<!-- TODO: x -->\n\nUnder\n-----\n\n## Refs\n\n# Again\n"
    rules = {i[1] for i in R.Grader(bad, t).run().issues}
    assert rules >= {"title", "multiple_h1", "forbidden", "todo", "heading_format", "numbering", "heading_level", "citation", "must_contain", "table_columns", "table", "order", "sources_section", "min_sources", "citation_style"} - {"citation_style"}
    assert R.Grader("", t).run().score == 0 or R.Grader("", t).run().issues
    noted = R.template({"title_level": 0, "sources_from_notes": True})
    assert [i[1] for i in R.Grader("see https://www.a.test/x/ and https://b.test", noted, {"a.test/x"}).run().issues] == ["source_not_in_notes"]
    for wrong in ({"nope": 1}, {"citation_style": "loud"}, {"section": [{"heading": ""}]}):
        with pytest.raises(EngineError):
            R.template(wrong)
    text = R.skeleton(t, [{"id": 1, "text": "fact", "tag": "1", "source": "https://a.test"}])
    assert "## 2. Title" in text and "- fact" in text and "<https://a.test>" in text


@pytest.mark.parametrize("kind", ["prices", "dates", "people", "numbers", "emails", "tables"])
def test_facts_of_all_pages(spark, tmp_path, kind):
    """The query over stored pages, with a long page of a hot site and repeated facts, against a plain loop over the lines."""
    import __spark_entry__ as entry

    busy = "Ann Lee, CEO of Acme, paid $5 and €7 on 2024-05-06 for 3 GB; write to a@b.test or A@B.TEST.\n王小明總裁\n```\n$9\n```\n| A | B |\n|---|---|\n| 1 | 2 |\n\n"
    pages = spark.read.parquet("/root/testdata/sf0.001/fetched_docs.parquet").select("doc_id", "site", "url", "title", "body")
    more = [(10**9 + i, "hot.test", f"https://hot.test/{i}", "T", busy * (2000 if i == 0 else 2)) for i in range(100)]
    pages.union(spark.createDataFrame(more, pages.schema)).union(spark.createDataFrame([(10**9 + 500, None, None, None, None)], pages.schema)).write.parquet(f"{tmp_path}/fetched_docs.parquet")
    find = {"prices": lambda x, h: [(f[0], f[1], f[2], f[3]) for f in scanners.prices(x, h)], "dates": lambda x, h: [(f[0], f[3]) for f in dateforms.scan(x)], "people": lambda x, h: [(f[0].lower(), f[1].lower()) for f in scanners.people(x)],
            "numbers": lambda x, h: [(f[0], f[1], scanners.clip(x, f[-2], f[-1], 120)) for f in scanners.numbers(x, h)], "emails": lambda x, h: [(f[0].lower(),) for f in scanners.addresses(x)]}
    want = set()
    for r in spark.read.parquet(f"{tmp_path}/fetched_docs.parquet").collect():
        if kind == "tables":
            want |= {(f"doc:{r.doc_id}", line, tuple(columns), len(rows)) for columns, rows, line in X.tables_in(r.body or "")}
            continue
        first, fence = {}, False
        for n, raw in enumerate((r.body or "").split("\n"), 1):
            if raw.lstrip().startswith(("```", "~~~")):
                fence = not fence
            elif not fence:
                for key in find[kind](scanners.readable(raw), X._host(r.url)):
                    first.setdefault(key, n)
        want |= {(f"doc:{r.doc_id}", n, *key) for key, n in first.items()}
    key = {"prices": ("value", "currency", "period", "per"), "dates": ("date", "raw"), "people": ("name", "role"), "numbers": ("value", "unit", "context"), "emails": ("email",), "tables": ("columns", "row_count")}[kind]
    low = lambda v: tuple(v) if isinstance(v, list) else v.lower() if isinstance(v, str) and kind in ("people", "emails") else v
    got = [(r.doc, r.line, *(low(r[k]) for k in key)) for r in entry.queries()[f"pages_{kind}"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and sum(x[0] == "doc:1000000000" for x in got) > 0


def test_readable_lines():
    for raw, want in (("> - **a** [x](http://y) \\[15\\] b[1] `c`", "a x b c"), ("| a \\| b | c |", "a | b | c"), ("# H __z__", "H z"), ("plain  text", "plain text"), ("![pic](a.png) [note 3]end", "pic end"), ("", "")):
        assert scanners.readable(raw) == want
    long = "x" * 100 + " $5 " + "y" * 100
    assert scanners.clip(long, 101, 103, 20) == "…xxxxxxxx $5 yyyyyyyy…" and scanners.clip("short", 0, 5, 20) == "short"


def test_scanner_cases():
    p = lambda t: [x[:5] for x in scanners.prices(t)]
    assert p("Business: €9.99 per user/month, billed annually")[0][2:4] == ("month", "user") and p("1,200 USD one-time")[0][2] == "one-time" and p("月費 299元/月")[0][:3] == (299.0, "CNY", "month")
    assert [x[0] for x in p("$10 – $20 per month")] == [10.0, 20.0] and p("9,99 € pro Monat")[0][0] == 9.99 and p("2.0 in 2026 with 12 features") == [] and p("：JPY 6,410/月")[0][:3] == (6410.0, "JPY", "month")
    assert [n[:2] for n in scanners.numbers("a $5.7 trillion market, 10k stars, 3 per cent, 營收 3.5億, 3 units")] == [(5.7e12, "USD"), (1e4, "stars"), (3.0, "%"), (3.5e8, None)]
    who = lambda t: [x[:4] for x in scanners.people(t)]
    assert who("Nvidia CEO Jensen Huang said") == [("Jensen Huang", "CEO", "Nvidia", 0.7)] and who("Lisa Su — Chair and CEO") == [("Lisa Su", "Chair and CEO", None, 0.6)]
    assert who("Jensen Huang is the founder and CEO of NVIDIA.") == [("Jensen Huang", "founder and CEO", "NVIDIA", 0.9)] and who("輝達執行長黃仁勳今天表示") == [("黃仁勳", "執行長", None, 0.5)]
    assert who("The Chief Executive Officer of the company spoke. Noticias Inicio Contacto Prensa") == [] and who("執行長表示看好") == []
    assert [d[0] for d in dateforms.scan("民國115年10月8日, 2026 年 3 月, Oct. 8th, 2026, 25/12/2026, 2026-13-01, version 1.2.3")] == ["2026-10-08", "2026-03", "2026-10-08", "2026-12-25"]


def test_html_tables_sources_and_one_pass(spark):
    body = "intro <table><tr><th>A<th>B<tr><td>1<td>2</table>\n\n# H\n| A | B |\n|---|---|\n| 1 | 2 |\n\n| C | D |\n|---|---|\n| 3 | 4 |\n```\n<table><tr><th>X<th>Y<tr><td>1<td>2</table>\n```\n<table><tr><td>no end"
    assert X.tables_in(body) == [(["A", "B"], [["1", "2"]], 1), (["C", "D"], [["3", "4"]], 8)]
    df = spark.createDataFrame([(1, body, None, "Page"), (2, BODY, "https://h.test/d/", None), (3, None, None, None)], "doc_id long, body string, url string, title string")
    assert X.extract(df, "tables", title="title").first().title == "Page"
    assert [r.line for r in X.extract(df, "prices", section=2).collect()] == [4] and X.extract(df, "prices", section=1).count() == 0
    every = X.extract_all(df).collect()
    assert {(k, sum(r.kind == k for r in every)) for k in X.KINDS} == {(k, X.extract(df, k).count()) for k in X.KINDS} and [r.nth for r in every if r.kind == "emails"] == [1]
    assert X.named_sources("doc:2, doc:1", "DOC:2,,doc:9") == ["doc:2", "doc:1", "doc:9"]
    got = X.extract_from(df, ["doc:2,doc:1", "Doc:2", "doc:9"], "tables").select("source_no", "doc").distinct().collect()
    assert {tuple(r) for r in got} == {(1, "doc:2"), (2, "doc:1")}
    with pytest.raises(EngineError):
        X.named_sources(" , ")


def test_bodies_and_handles(spark):
    from millrace.sources.catalog import document

    df = spark.createDataFrame([(1, b"<p>x", "text/html"), (2, b"{broken", "application/json"), (3, None, None), (4, b"\xff\xd8", "image/jpeg"), (5, b"", None)], "id int, raw binary, kind string")
    assert [r[0] for r in df.select(html.readable_body(F.col("raw"), F.col("kind"))).collect()] == ["x\n", "{broken", None, None, ""]
    docs = spark.createDataFrame([(i, f"T{i}") for i in range(7)], "doc_id long, title string")
    assert document(docs, " Doc:3 ").first().title == "T3"
    for bad in ("doc:99", "tbl:1", "doc:x", ""):
        with pytest.raises(EngineError) as e:
            document(docs, bad)
        assert "doc:6 T6" in e.value.hint and "doc:1 " not in e.value.hint
