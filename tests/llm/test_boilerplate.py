import numpy as np
import pyarrow.dataset as ds

from millrace.llm import boilerplate as B
from millrace.llm.chrome_labels import labels

PAGE = """Skip to main content
* [Home](https://x.test/n0)
* [Pricing](https://x.test/n1)

# The market board answers roughly 10 questions a day

After a short review, the exchange lists a lower price for yearly contracts, as the board explained.
A cookie notice must let visitors refuse as easily as they accept, the office writes.
Sponsored content

## Prices

- The Pro plan costs $12 per month.

**Related articles**
* The records team rounds all amounts to the nearest unit

© 2024 X Guide. All rights reserved."""


def test_page():
    (numbers, p), = B.furniture([PAGE])
    assert [n for n, x in zip(numbers, p) if x >= B.LIMIT] == [1, 2, 3, 9, 15, 16, 18]


def test_held_out_agreement(sf):
    bodies = [b for b in ds.dataset(sf.replace("0.001", "0.01") + "/fetched_docs.parquet").to_table(columns=["body"])["body"].to_pylist() if b]
    good = total = 0
    for body, (numbers, p) in zip(bodies, B.furniture(bodies)):
        want = labels(body.split("\n"))
        good += sum(bool(want[n - 1]) == (x >= B.LIMIT) for n, x in zip(numbers, p))
        total += len(numbers)
    assert good / total > 0.99


def test_gradients():
    r = B.Reader()
    data = [(t, w) for _, t, w in (r.page("Home\n# A b\ntext here."), r.page("one\n\ntwo two"))]
    truth = [np.array([1, 0, 0], np.float32), np.array([1, 0], np.float32)]
    net = B.Network(seed=3)
    _, grad = net.gradients(data, truth)
    for name, at in (("Uf", (2, 5)), ("Wb", (20, 40)), ("u", (4,)), ("bf", (30,))):
        old = net.p[name][at]
        ends = []
        for d in (1e-2, -1e-2):
            net.p[name][at] = old + d
            ends.append(net.gradients(data, truth)[0])
        net.p[name][at] = old
        assert abs((ends[0] - ends[1]) / 2e-2 - grad[name][at]) < 2e-3


def test_fit_learns():
    bodies = [PAGE.replace("10", str(i)) for i in range(24)]
    net = B.fit(bodies, rounds=60)
    (numbers, p), = B.furniture([PAGE], net, B.Reader())
    assert [n for n, x in zip(numbers, p) if x >= 0.5] == [1, 2, 3, 9, 15, 16, 18]


def test_columns(spark):
    df = spark.createDataFrame([(1, PAGE, 7), (2, None, 7), (3, "", 7), (4, "\n \n", 7), (5, "word " * 50_000, 7)], "doc_id long, body string, line_no int")
    got = sorted(map(tuple, B.furniture_lines(df).collect()))
    assert [r for r in got if r[0] == 1] == [(1, n) for n in (1, 2, 3, 9, 15, 16, 18)] and not any(r[0] in (2, 3, 4) for r in got)
    text = {r.doc_id: r.m for r in df.select("doc_id", B.main_body("body").alias("m")).collect()}
    assert text[1].startswith("# The market") and "Sponsored" not in text[1] and text[2] is None and text[3] == ""
    assert B.furniture_lines(df.limit(0)).count() == 0


def test_wording_in_no_list(sf):
    """Pages whose words are all replaced by made-up ones: layout and context alone must tell furniture from the main body."""
    import pyarrow.dataset as ds

    from millrace.llm.chrome_labels import labels

    bodies = [b for b in ds.dataset(sf.replace("0.001", "0.01") + "/fetched_docs.parquet").to_table(columns=["body"])["body"].to_pylist() if b]
    assert B.reworded("Menu [Home](/a/b) 5", 1) != "Menu [Home](/a/b) 5" and "](/a/b) 5" in B.reworded("Menu [Home](/a/b) 5", 1) and B.reworded("x X", 1).lower().split()[0] == B.reworded("x X", 1).lower().split()[1]
    both = hit = told = 0
    made = ["\n".join(B.reworded(x, 7_000 + i) for x in b.split("\n")) for i, b in enumerate(bodies)]
    for body, (numbers, scores) in zip(bodies, B.furniture(made)):
        marks = labels(body.split("\n"))
        for n, p in zip(numbers, scores):
            told += bool(marks[n - 1])
            hit += p >= B.LIMIT
            both += bool(marks[n - 1]) and p >= B.LIMIT
    assert both / told > 0.98 and both / hit > 0.98
