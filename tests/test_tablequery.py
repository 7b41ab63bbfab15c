import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.errors import EngineError
from millrace.operators.profile import profile
from millrace.operators.tablequery import TableQuery, parse_sort, parse_where
from millrace.sources.tables import frame

PLANS = (["Plan", "Price", "Seats", "Launched", "Vendor"], [
    ["Free", "$0", "1", "2024-01-05", "Acme"], ["Pro", "$1,299/yr", "25", "Mar 3, 2025", "acme "], ["Team", "$49/mo", "", "2023年5月", "Beta"], ["Enterprise", "Contact us", "1,000", "n/a", "Beta"], ["Lite", "$9.50", "3", "", "Acme"]])


@pytest.fixture(scope="module")
def plans(spark):
    return frame(spark, *PLANS).cache()


def _names(df):
    return [r.Plan for r in df.collect()]


def test_where(plans):
    run = lambda *w: sorted(_names(TableQuery(where=list(w)).run(plans)))
    assert run("price < 50") == ["Free", "Lite", "Team"] and run("Price >= $49") == ["Pro", "Team"]
    assert run("Price = contact us") == ["Enterprise"] and run("seats != 1") == ["Enterprise", "Lite", "Pro", "Team"]  # a blank differs
    assert run("Launched >= 2024-01-01") == ["Free", "Pro"] and run("launched < 1 January 2024") == ["Team"]
    assert run("vendor contains ACM", "price < 5") == ["Free"] and run("vendor startswith b") == ["Enterprise", "Team"] and run('vendor = ""') == []


@pytest.mark.parametrize("text", ["Price", "a not contains b", "= 5", "Price =", "Price ! 5", "nope = 1"])
def test_bad_where(plans, text):
    with pytest.raises(EngineError):
        TableQuery(where=[text]).run(plans)


def test_parse():
    assert parse_where("a b >= 'x y'") == ("a b", ">=", "x y") and parse_where("a <> b") == ("a", "!=", "b") and parse_where("x starts with y") == ("x", "startswith", "y")
    assert parse_sort("-A, B desc, +C, D asc, E") == [("A", True), ("B", True), ("C", False), ("D", False), ("E", False)]


def test_group(plans):
    got = {r.Vendor: (r.count, r.sum_Price, r.count_Seats) for r in TableQuery(group_by="vendor", agg=["count", "sum:Price", "count:Seats"]).run(plans).collect()}
    assert {k: v[1:] for k, v in got.items()} == {"Acme": (9.5, 2), "acme": (1299.0, 1), "Beta": (49.0, 1)}
    assert TableQuery(where=["Plan = none such"], group_by="Vendor").run(plans).count() == 0
    row = TableQuery(where=["Plan = none such"], agg=["count", "sum:Price", "avg:Price", "min:Price"]).run(plans).first()
    assert list(row) == [0, 0.0, None, None]
    assert TableQuery(agg=["sum:Price", "sum:price"]).run(plans).columns == ["sum_Price", "sum_Price_2"]
    with pytest.raises(EngineError):
        TableQuery(agg=["median:Price"]).run(plans)


def test_sort_and_select(plans):
    assert _names(TableQuery(sort="-Price", tie=["_ord"]).run(plans)) == ["Pro", "Team", "Lite", "Free", "Enterprise"]
    assert _names(TableQuery(sort="Price", tie=["_ord"]).run(plans)) == ["Free", "Lite", "Team", "Pro", "Enterprise"]
    assert _names(TableQuery(sort="Launched desc", tie=["_ord"]).run(plans)) == ["Pro", "Free", "Team", "Enterprise", "Lite"]
    assert TableQuery(sort="Seats", select="plan,Plan", limit=2, tie=["_ord"]).run(plans).collect() == [("Free", "Free"), ("Lite", "Lite")]


def test_profile(plans):
    assert {r.column: r.type for r in profile(plans).collect()} == {"_ord": "number", "Plan": "text", "Price": "currency", "Seats": "number", "Launched": "date", "Vendor": "text"}
    assert {r.type for r in profile(plans.limit(0).drop("_ord")).collect()} == {"text"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.sampled_from(["", "n/a", "$3", "12%", "7", "x", "-1"])), min_size=1, max_size=12), st.booleans())
def test_sort_keeps_all_rows_and_puts_misfits_last(spark, values, down):
    df = frame(spark, ["v"], [[v] for v in values])
    got = [r.v for r in TableQuery(sort=("-" if down else "") + "v", tie=["_ord"]).run(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, values))
    usable = [v for v in got if v in ("$3", "12%", "7", "-1")]
    blanks = [v is None or v in ("", "n/a") for v in got]
    if 2 * len(usable) >= len(got) - sum(blanks):  # by number: everything else comes last, in its own order
        assert got[: len(usable)] == usable and usable == sorted(usable, key=lambda v: float(v.strip("$%")), reverse=down)
    else:  # by text: only blanks come last
        assert blanks == sorted(blanks)
