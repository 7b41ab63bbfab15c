import gzip
import json

from millrace.sources import imports as I


def test_curated_and_seed(spark, tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[[record]]\nid = "a"\nname_zh = "甲"\naliases = ["x", "y"]\n[[record]]\nid = "b"\n', encoding="utf-8")
    got = {r.id: r for r in I.curated(spark, str(p)).collect()}
    assert got["a"].aliases == ["x", "y"] and got["b"].name_zh is None
    s = tmp_path / "s.json.gz"
    with gzip.open(s, "wt") as f:
        json.dump({"source": "list", "rows": [{"d": "a.test", "n": 1}, {"d": "b.test", "n": 2}]}, f)
    assert sorted(map(tuple, I.seed(spark, str(s)).collect())) == [("a.test", 1, "list"), ("b.test", 2, "list")]


def test_redirects():
    assert I.unwrapped("https://a.test/x", "u") == "https://a.test/x" and I.unwrapped("javascript:0", "u") is None
    assert I.unwrapped("https://r.test/ck/a?u=a1aHR0cHM6Ly9iLnRlc3Qv", "u", "a1") == "https://b.test/" and I.unwrapped("https://r.test/?u=%21", "u") is None
    assert I.page_hits("<p>no hits", "hit", "a", "n") == []
