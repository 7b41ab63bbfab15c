from millrace.llm import mixing


def _mixture(spark, rows, targets):
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    rates = mixing.rates(sizes, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    mix = mixing.mix(sizes, rates, "doc_id")
    return mix, rates


def test_shares_and_caps(spark):
    rows = [(i, "a", 10) for i in range(4000)] + [(i + 4000, "b", 20) for i in range(600)] + [(9000, None, 5), (9001, "c", 7)]
    mix, rates = _mixture(spark, rows, [("a", 0.5, 2), ("b", 0.5, 3)])
    got = {r.source: r for r in mixing.reached(mix, rates).collect()}
    assert set(got) == {"a", "b"}
    for r in got.values():
        assert abs(r.actual_share - 0.5) < 0.02 and r.most_repeats <= r.max_repeats
    assert got["b"].rate == 3.0  # the source that runs out first is used to its cap
    keys = [(r.doc_id, r.copy_no) for r in mix.collect()]
    assert len(keys) == len(set(keys))


def test_same_on_every_run(spark):
    rows = [(i, "a" if i % 3 else "b", i % 17) for i in range(500)]
    first = sorted(map(tuple, _mixture(spark, rows, [("a", 0.3, 1), ("b", 0.7, 4)])[0].collect()))
    again = sorted(map(tuple, _mixture(spark, rows[::-1], [("a", 0.3, 1), ("b", 0.7, 4)])[0].collect()))
    assert first == again


def test_edges(spark):
    mix, rates = _mixture(spark, [], [("a", 1.0, 2)])
    assert mix.count() == 0 and [(r.actual_share, r.tokens_used) for r in mixing.reached(mix, rates).collect()] == [(0.0, 0)]
    mix, rates = _mixture(spark, [(1, "a", 0), (2, "b", 5)], [("a", 0.5, 2), ("b", 0.5, 2), ("b", 0.5, 2), (None, 0.1, 1), ("x", 0.2, 0)])
    assert {r.source: r.tokens_used for r in mixing.reached(mix, rates).collect()} == {"a": 0, "b": 10}
