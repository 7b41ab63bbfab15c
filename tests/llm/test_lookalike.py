from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import lookalike

T = lookalike.transducer()


def test_forms():
    assert T.apply("Ｂima　Ｖo") == "Bima Vo"
    assert T.apply("Vаbo Ροnalа́") == "Vabo Ponalá"  # Cyrillic and Greek letters, one with a mark
    assert T.apply("n​̃") == "ñ" and T.apply("金﻿⽕⁠里") == "金火里"
    assert T.key("Ríbadi (ＢＡＲ)") == "ríbadibar" and T.key("—  .") == ""
    assert T.key("Ribadi") != T.key("Ríbadi") and T.key("乐") != T.key("樂")


@given(st.text(max_size=40))
def test_stable(text):
    once = T.apply(text)
    assert T.apply(once) == once


def test_mapping_is_checked():
    assert all(own != to for _, own, to in T.conflicts)
    assert all(T.table.get(x, x) == x for to in T.table.values() for x in to if x in T.table and len(T.table[x]) == 1)


def test_pairs(spark):
    terms = spark.createDataFrame([(1, "bimavo"), (2, "ｂimavo"), (3, None), (4, ""), (5, "bíma"), (6, "ｂimavo")], "term_id long, norm string")
    kb = spark.createDataFrame([("x", "Bima Vo", None), ("x", "bimavo!", []), ("y", None, ["Вima Vo", None]), (None, "bimavo", None)], "id string, name_zh string, aliases array<string>")
    got = sorted(map(tuple, lookalike.same_reading(terms, kb).collect()))
    # term 1 equals a name of x as it is; y's alias only looks the same
    assert got == [(1, "y"), (2, "x"), (2, "y"), (6, "x"), (6, "y")]
    assert lookalike.same_reading(terms.limit(0), kb).count() == 0


def test_hot_term(spark):
    from millrace.session import skew_join

    left = spark.range(5000).selectExpr("id", "case when id % 2 = 0 then 'h' else cast(id as string) end as k")
    right = spark.createDataFrame([("h", 1), ("h", 2), ("7", 3)], "k string, v int")
    assert sorted(map(tuple, skew_join(left, right, "k", hot=100).collect())) == sorted(map(tuple, left.join(right, "k").collect()))
