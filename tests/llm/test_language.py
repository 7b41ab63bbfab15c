import numpy as np
import pyarrow.dataset as ds
import pytest

from millrace.llm import language as L

EN = "The office answers questions every day. It asks every applicant to bring a signed copy."
DE = "Das Amt beantwortet jeden Tag Fragen. Die Abteilung verlangt von allen eine unterschriebene Kopie."
ZH = "市府櫃檯每天回覆問題。業者請每位申請人帶簽名的影本。"


@pytest.fixture(scope="module")
def rows(sf):
    return ds.dataset(f"{sf}/documents.parquet").to_table().to_pylist()


@pytest.fixture(scope="module")
def model(rows):
    names = {n: lang for lang, ns in L.NAMES.items() for n in ns}
    label = lambda x: names.get((x or "").strip().lower().split("-")[0])
    return L.fit([(r["text"], label(r["lang"])) for r in rows if r["text"] and label(r["lang"])])


def test_sentences_are_lossless(rows):
    for r in rows:
        assert "".join(L.sentences(r["text"] or "")) == (r["text"] or "")


def test_segments(model):
    flat = np.log(np.full(len(L.LANGS), 1 / len(L.LANGS)))
    text = f"{EN} {DE}\n\n{ZH}\n| a | 5 |\n🙂"
    got = model.segments(text, flat)
    assert [g[0] for g in got] == ["en", "de", "zh"] and all(0.5 < g[1] <= 1 for g in got)
    assert "".join(text[a:b] for _, _, a, b, _ in got) == text
    assert model.segments("🙂 12.5 | 1 |", flat) == [] and model.segments("", flat) == []


def test_held_out_accuracy(model, sf):
    """Every document whose label names a language: the labels are mostly right, so agreement must be high."""
    other = ds.dataset(sf.replace("0.001", "0.01") + "/documents.parquet").to_table().to_pylist()
    names = {n: lang for lang, ns in L.NAMES.items() for n in ns}
    flat = np.log(np.full(len(L.LANGS), 1 / len(L.LANGS)))
    seen = right = 0
    for r in other:
        want = names.get((r["lang"] or "").strip().lower().split("-")[0])
        got = model.segments(r["text"] or "", flat)
        if want and len(got) == 1:
            seen += 1
            right += got[0][0] == want
    assert seen > 300 and right / seen > 0.8


def test_found(spark, model):
    schema = "doc_id long, text string, lang string, site string, id int, prior string"
    df = spark.createDataFrame([
        (1, EN, "en-US", "a.example", 0, ""), (2, EN, "xx", "a.example", 0, ""), (3, DE, "English", None, 0, ""), (4, f"{EN} {ZH}", "en", "b.test", 0, ""), (5, None, None, None, 0, ""), (6, " ", "en", "a.example", 0, ""),
        (7, ZH, "zh_TW", "a.example", 0, ""), (8, DE, "nl", "a.example", 0, ""), (9, "12 %", None, "a.example", 0, ""), (10, EN * 300, None, "a.example", 0, "")], schema)
    got = sorted(map(tuple, L.mislabelled(L.segments(df, model=model)).collect()))
    assert got == [(2, 1, "en"), (3, 1, "de"), (4, 1, "en"), (4, 2, "zh"), (8, 1, "de"), (10, 1, "en")]
    assert L.segments(df.limit(0), model=model).count() == 0


def test_priors(spark):
    df = spark.createDataFrame([("a.jp", "ja")] * 50 + [("b.jp", None), ("c.de", "de"), (None, "en")], "site string, lang string")
    p = {r.site: r.prior for r in L.host_priors(df).collect()}
    ja, de = L.LANGS.index("ja"), L.LANGS.index("de")
    assert all(abs(sum(x) - 1) < 1e-9 for x in p.values()) and p["a.jp"][ja] > p["b.jp"][ja] > p["c.de"][ja] and p["c.de"][de] > p["b.jp"][de]


def test_addresses_say_nothing(model):
    flat = np.log(np.full(len(L.LANGS), 1 / len(L.LANGS)))
    assert [g[0] for g in model.segments(f"{ZH} www.none.example/a?b=1&c=2", flat)] == ["zh"] and model.segments("https://der.die/das?und=nicht mail@das-haus.test", flat) == []


def test_label_and_host_decide_short_texts(spark, model):
    """Where a text says nothing its label decides, else its host; a clear text overrules both."""
    df = spark.createDataFrame(
        [(i, EN, "fr", "fr.example") for i in range(30)] + [(i, EN, "de", "de.example") for i in range(30, 60)] + [(100, "Ωψξψξ", "de", None), (101, "Ωψξψξ", None, "fr.example"), (102, "Ωψξψξ", None, None), (103, DE, "fr", "fr.example")], "doc_id long, text string, lang string, site string")
    got = {r.doc_id: r for r in L.segments(df, model=model).collect()}
    assert got[100].lang == "de" and got[101].lang == "fr" and got[103].lang == "de" and got[0].lang == "en"
    assert got[102].confidence < got[101].confidence < 0.99 and got[103].confidence > 0.99


def test_confidence_is_calibrated(model, sf):
    """Pieces of one to three words of other documents: mean confidence near the share that is right."""
    flat = np.log(np.full(len(L.LANGS), 1 / len(L.LANGS)))
    other = ds.dataset(sf.replace("0.001", "0.01") + "/documents.parquet").to_table().to_pylist()
    right, sure = [], []
    for r in other:
        whole = model.segments(r["text"] or "", flat)
        if len(whole) != 1 or whole[0][0] in ("zh", "ja"):
            continue
        for n in (1, 2, 3):
            got = model.segments(" ".join(r["text"].split()[1 : 1 + n]), flat)
            if got:
                right.append(got[0][0] == whole[0][0])
                sure.append(got[0][1])
    assert len(right) > 500 and abs(np.mean(right) - np.mean(sure)) < 0.08 and np.mean(np.array(sure)[~np.array(right)]) < np.mean(np.array(sure)[np.array(right)]) - 0.1
