import itertools
import random

from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import namelink as N


def _slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs(a, b):
    assert N.lcs(a, b) == _slow_lcs(a, b)


def test_names_are_read_in_any_order():
    want = {"kind": "design", "number": "9", "person": "william", "place": "fobo", "brand": "lifofo", "stem": ""}
    for t in ("William Lifofo Design Studio No. 9, Fobo", "Lifofo, William - Design Studio No. 9 (Fobo)", "Fobo: Design Studio No. 9 Lifofo William", "Bill Lifófo Dseign Studio No. 9, Fobo"):
        assert N.read_name(t) == want
    assert N.read_name("第2電力股份有限公司（蘭月利凱卡）")["stem"] == "蘭月利凱卡" and N.read_name("兰月利凯卡第2电力股份有限公司")["kind"] == "power"
    assert N.read_name("KZBNG") == {"kind": "", "number": "", "person": "", "place": "", "brand": "kzbng", "stem": ""} and N.read_name("大安里綜合醫院")["stem"] == "大安里" and N.read_name("--") is None and N.read_name("") is None and N.read_name(None) is None


def _pairs(spark, rows):
    df = spark.createDataFrame([(i, z, e, a, u, 1) for i, z, e, a, u in rows], "id string, name_zh string, name_en string, aliases array<string>, official_url string, fid int")
    return sorted(map(tuple, N.same_organisation(df).collect()))


ROWS = [
    ("a", "山木瑞馬瑞食品合作社", "Kopo Titoti Food Cooperative", None, None), ("b", None, "Food Coop, Titoti, Kopo", [], None), ("c", "山木瑞马瑞食品合作社", None, None, ""), ("d", None, "Kopo Titoti Water Company", None, None),
    ("e", None, "Kopo Titoti Food Cooperative No. 2", None, None), ("f", None, "Elizabeth Napano Bakery, Vogi", None, None), ("g", None, "Betty Napano Bakery, Vogi", None, None), ("h", None, "Robert Napano Bakery, Vogi", None, None),
    ("i", "n/a", "?", [None, ""], None), (None, None, "Kopo Titoti Food Cooperative", None, None), ("a", "山木瑞馬瑞食品合作社", "Kopo Titoti Food Cooperative", None, None),
]


def test_pairs(spark):
    assert _pairs(spark, ROWS) == [("a", "b"), ("a", "c"), ("b", "c"), ("f", "g")]


def test_empty(spark):
    assert _pairs(spark, []) == []


def test_blocks_lose_no_pair_of_a_small_table(spark):
    """Against comparing all pairs of forms by the same decision."""
    places, brands = ["kopo", "vogi", "kapo"], ["titoti", "napano", "titati", "titot", "itioti"]
    rows = [(f"{i:02d}", None, f"{p.title()} {b.title()} Food Cooperative", None, None) for i, (p, b) in enumerate(itertools.product(places, brands))]
    forms = {r[0]: {**N.read_name(r[2]), "dom": ""} for r in rows}
    want = {(x, y) for x, y in itertools.combinations(sorted(forms), 2) if N.alike(forms[x], forms[y], set())}
    assert want <= set(_pairs(spark, rows))


def test_membership(spark):
    df = spark.createDataFrame([r for r in ROWS], "id string, name_zh string, name_en string, aliases array<string>, official_url string")
    got = {r.id: r.class_size for r in N.membership(df).collect()}
    assert got["a"] == 3 and got["d"] == 1 and "i" not in got


def _accepted(forms):
    return {(x, y) for x, y in itertools.combinations(range(len(forms)), 2)
            if (forms[x]["kind"], forms[x]["number"]) == (forms[y]["kind"], forms[y]["number"]) and N.alike(forms[x], forms[y], set())}


def _candidates(spark, forms):
    df = spark.createDataFrame([(i, *(f[p] for p in N._PARTS), f["dom"]) for i, f in enumerate(forms)], "fid long, " + ", ".join(f"{p} string" for p in (*N._PARTS, "dom")))
    return {(min(r.a_fid, r.b_fid), max(r.a_fid, r.b_fid)) for r in N.candidates(df).select("a_fid", "b_fid").collect()}


def _form(**parts):
    return dict.fromkeys((*N._PARTS, "dom"), "") | {"kind": "food"} | parts


def test_common_blocks_lose_no_pair(spark):
    """A common place, brand, domain, stem part and brand beside stems, against comparing all pairs."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ktnmpr" if i % 2 == 0 else "aio") for i in range(n))
    han = lambda n: "".join(rng.choice("山木瑞馬大維") for _ in range(n))
    forms = [_form(place="kopo", brand="titoti"), _form(place="kopo", brand="titota"), _form(place="kopo", brand="nitoti"), _form(place="kopo", brand="itoti"), _form(place="kopo", brand="tamatimopira"), _form(place="kopo", brand="tamatinopiro")]
    forms += [_form(place="kopo", brand=word(rng.choice([5, 6, 6, 7, 8]))) for _ in range(120)]
    forms += [_form(place=word(rng.choice([2, 3, 4, 4, 5, 8])), brand=rng.choice(["marapi", "marapo"])) for _ in range(120)] + [_form(place=x + ".", brand="marapi") for x in "ktn"]
    forms += [_form(place=word(8), brand=word(8)) for _ in range(60)] + [_form(place="katamano", brand="pirokana"), _form(place="katamani", brand="pirokani")]
    forms += [_form(stem="山木" + han(3)) for _ in range(90)] + [_form(stem=han(rng.choice([1, 2, 4, 12]))) for _ in range(60)] + [_form(stem="大維瑞馬山木大維瑞馬山木"), _form(stem="大瑞馬山木大維瑞馬山木")]
    forms += [_form(brand="titoti", stem=han(2)) for _ in range(80)] + [_form(brand=word(6), stem="瑞馬") for _ in range(80)]
    forms += [_form(dom="kopo", brand=word(6), place=word(4)) for _ in range(80)] + [_form(dom="kopo", stem=han(4)) for _ in range(20)]
    forms = [dict(x) for x in {tuple(sorted(f.items())) for f in forms}]
    want = _accepted(forms)
    assert len(want) > 1000 and not want - _candidates(spark, forms)


UNTYPED = [
    ("a", None, "Northwind Trading Ltd", None, None), ("b", None, "Northwnd Trading Limited", None, None), ("c", None, "Northwind Tradings Corp", None, None), ("d", None, "Trading, Northwind (Ltd.)", ["NTL"], None),
    ("e", None, "Oakridge Steel Works", None, None), ("f", None, "Oakridge Steel Mill", None, None), ("g", None, "NTL", None, None), ("h", "新竹鋼鐵廠", None, None, None), ("i", "新竹鋼铁厂", None, None, None), ("j", "新竹紡織廠", None, None, None),
    ("k", None, "Kopo Titoti", ["Kopo Titoti Clinic"], None), ("l", None, "Kopo Titoti Bakery", ["Kopo Titoti"], None), ("m", None, "Umbrella", None, "https://umbrella.test/"), ("n", None, "umbrella", None, "https://www.umbrella.test"), ("o", None, "Northwind Trading Ltd 2", None, None),
]


def test_names_without_a_known_kind(spark):
    """They link where all words agree; a nickname beside a full name links nothing; each id has its group."""
    assert _pairs(spark, UNTYPED) == [("a", "b"), ("a", "d"), ("b", "d"), ("h", "i"), ("m", "n")]
    df = spark.createDataFrame([(*r, 1) for r in UNTYPED], "id string, name_zh string, name_en string, aliases array<string>, official_url string, fid int")
    got = {r.id: r.class_size for r in N.membership(df).collect()}
    assert set(got) == {r[0] for r in UNTYPED} and got["a"] == 3 and got["g"] == 1


def test_common_block_of_names_without_a_kind(spark):
    """More names than COMMON share two words; against all pairs."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    words += [w[:2] + w[3:] for w in words[:20]] + [w[:3] + "z" + w[4:] for w in words[:20]]
    rows = [(f"{i:03d}", None, f"{w.title()} Trading Ltd", None, None) for i, w in enumerate(words)]
    forms = {x[0]: {**N.read_name(x[2]), "dom": ""} for x in rows}
    want = {(x, y) for x, y in itertools.combinations(sorted(forms), 2) if N.alike(forms[x], forms[y], set())}
    assert len(want) >= 40 and want <= set(_pairs(spark, rows))
