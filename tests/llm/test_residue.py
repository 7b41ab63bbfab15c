import random
import time

import pytest

from millrace.llm import residue as R

TEXT = "After a short review, the exchange lists a lower price for yearly contracts, as the board explained.\n\nVolume reached 45,102 units, compared with 82,318 in the week before. When asked about the delay, the office pointed to form G461."
CASES = [
    ("Plans", "# Title\n\n" + TEXT, False), ("Plans", None, False), (None, None, False), ("Plans", "", False), ("{{ title }}", TEXT, True), ("Untitled", "# x\n\n" + TEXT, True), ("Plans", TEXT.replace("office", "{{office}}"), True),
    ("Plans", TEXT + "\n\nTotal: NaN null", True), ("Plans", TEXT + "\n\nLast update: Invalid Date", True), ("Plans", TEXT + "\n\nLorem ipsum dolor sit amet magna.", True), ("Plans", "# T\n\nxxxx xxxx xxx", True),
    ("404 Not Found", "# 404 Not Found\n\nThe page could not be found.", True), ("拒絕存取", "# 拒絕存取\n\n您沒有檢視這個頁面的權限。\n\nCode: 79", True), ("Plans", '{"error":{"code":1}}', True), ("Access denied", "", True),
    ("Why a good 404 page matters", "# Why a good 404 page matters\n\nThe review counted 9 portals whose error page offers a search box. A message such as \"page not found\" is not enough.\n" + TEXT, False),
    ("How template placeholders work", "# How\n\nA placeholder is a named gap.\n\n```\nDear {{ name }}\n```\n" + TEXT, False), ("Plans", "# Title\n\n" + TEXT + "\n\nSome functions of this site need JavaScript to be enabled.", False),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, f"s{i}.test", t, b, True) for i, (t, b, _) in enumerate(CASES)], "doc_id long, site string, title string, body string, sure boolean")
    got = {r.doc_id for r in R.found(df).collect()}
    assert got == {i for i, (_, _, want) in enumerate(CASES) if want}
    assert R.found(df.limit(0)).count() == 0


def _found(spark, rows):
    return {r.doc_id: r.evidence for r in R.evidence(spark.createDataFrame(rows, "doc_id long, site string, title string, body string")).collect()}


def test_doubtful_value_needs_evidence(spark):
    """A lone 'null' is a slot only if aligned records fill it."""
    line = "Since the spring update, the plan of {} covers storage, support and two weekly backups."
    alone = [(1, "a.test", "T", TEXT + "\n\n" + line.format("null"))]
    filled = alone + [(i, f"{i}.test", "T", TEXT + "\n\n" + line.format(x)) for i, x in ((2, "Bar"), (3, "the city"))]
    assert _found(spark, alone) == {} and _found(spark, filled) == {1: "slot"}


def test_evidence(spark):
    """Each kind of evidence: aligned slots, repeated filler and titles, whole pages in no list of words, words alone."""
    tail = "the office pointed to the form and to the open requests of the week."
    rows = [(i, f"{i}.test", "T", f"When asked about the {x}, {tail}") for i, x in enumerate(("delay", "price", "fee"))]
    rows += [(10, "a.test", "T", f"When asked about the {{{{topic}}}}, {tail}"), (11, "a.test", "T", "A slot @@x@@ nobody else has around it here.")]
    rows += [(20 + i, f"{i}.test", "T", TEXT + "\n\nLorem ipsum dolor sit amet consectetur elit.") for i in range(3)]
    rows += [(30 + i, f"{i}.test", "Untitled document", TEXT) for i in range(3)]
    rows += [(40 + i, f"{i}.test", "T", f"Warning: division by zero in module_{i} on line {i * 7}\n\nRequest 46{i}-1") for i in range(4)]
    rows += [(50 + i, f"{i}.test", "T", TEXT * 4) for i in range(4)]  # an article that sites share
    got = _found(spark, rows)
    assert {k: got.pop(k) for k in (10, 11)} == {10: "slot", 11: "words"}
    assert got == {**{20 + i: "filler" for i in range(3)}, **{30 + i: "title" for i in range(3)}, **{40 + i: "page" for i in range(4)}}


def test_all_surroundings_when_too_many_are_asked_for(spark, monkeypatch):
    rows = [(i, f"{i}.test", "T", f"When asked about the {x}, the office pointed to the form.") for i, x in enumerate(("delay", "price", "${x}"))]
    monkeypatch.setattr(R, "MOST_ASKED", 1)
    assert _found(spark, rows) == {2: "slot"}


def test_long_texts_and_short_lines(spark):
    """Filler in short lines with commas, a page of a hundred thousand lines, nulls in all columns, repeated ids."""
    rows = [(1, "a.test", "T", TEXT + "\n\nLorem, ipsum, dolor, sit, amet"), (2, None, None, (TEXT + "\n") * 20_000 + "\n{{x}} end"), (None, None, None, None), (3, "a.test", None, ""), (1, "a.test", "T", TEXT)]
    assert set(_found(spark, rows)) == {1, 2}


@pytest.mark.parametrize("text", ["${plan}", "%%x%%", "<<user.name>>", "[[city]]", "__org__", "{% block x %}", "<%= x %>", "[INSERT title]", "[Your x here]", "(x TBD)", "【請填入 x】", "@@x@@", "{city}", "#{x}"])
def test_variables(text):
    assert R.VARIABLE.search(f"a {text} b") and R.VARIABLE.search(f"字{text}字")


def test_not_variables():
    for text in ("a [link](https://x.test/a_b__c)", "2 < 3 and 5 > 4", "100%", "| --- |", "snake_case_name", "f(x) {"):
        assert not R.VARIABLE.search(text)


def test_slots_are_induced_from_aligned_records(spark):
    """Blank slots, placeholders of any syntax and defaults count where other records fill the slot."""
    names = ["Ana", "Bob", "Carla", "Dora", "Emil", "Fay", "Gus", "Hal", "Ida", "Jon", "Kim", "Lea", "Max", "Nia", "Oto", "Pia", "Quin", "Rob", "Sue", "Tom", "Uma", "Vic", "Wes", "Xia", "Yan"]
    line = "Dear {}, welcome to the service desk of the office."
    bad = ["", "%NAME%", "<name>", "{first name}", "______", *["John Doe"] * 10]
    make = lambda values: {r.doc_id for r in R.found(spark.createDataFrame([(i, f"{i}.test", "T", TEXT + "\n\n" + line.format(v)) for i, v in enumerate(values)], "doc_id long, site string, title string, body string")).collect()}
    assert make(names + bad) == set(range(25, 40))
    assert make(["<name>", "John Doe", ""]) == set() and make(names) == set()


def test_any_of_many_marks_may_be_the_slot(spark):
    """One of seven texts in marks is a slot that six records fill, wherever it stands."""
    words = ["$desk", "#help", "<info>", "[sales]", "@press", "%board%", "?? open"]
    rows = []
    for place in range(7):
        for i, value in enumerate(["Ana", "Bob", "Carla", "Dora", "Emil", "Fay", "<name>"]):
            line = "Write to " + ", ".join(words[:place] + [value] + words[place + 1 :]) + " about the request."
            rows.append((place * 10 + i, f"{i}.test", "T", TEXT + "\n\n" + line))
    assert _found(spark, rows) == {place * 10 + 6: "line" for place in range(7)}


def test_one_open_slot_against_every_line():
    """The keys of single slots, joined from pieces, are those of the whole lines."""
    r = random.Random(5)
    parts = ["Ana", "Xxx", "XXX", "N/A", "TBD", " ", "  ", " ", "-", "--", "'", "12", "3.", "1....2", "4", "....", "%x y%", "{a}", "<B c>", "[d]", "$e", "#Fay", "@g@", "__", "??", "word", "ΑΣ", "Σ", "\u3000", "字", "␣", ",", " ,", "()", "( )", ":", "é", "ｶ", "İ"]
    seen = 0
    for _ in range(4000):
        line = "".join(r.choice(parts) for _ in range(r.randrange(2, 30))).strip()
        got = R.empty_slots(line)
        want = set()
        for pattern in (R._MARKED, R._GAP):
            hits = [m.span() for m in pattern.finditer(line)]
            seen += len(hits) > 4
            for some in [hits, *([h] for h in hits)] if hits else []:
                text, end = "", 0
                for a, b in some:
                    text, end = text + line[end:a] + "␣", b
                want |= {R._constant(R._FILLED.sub("␣", text + line[end:])), R._constant(R._slots(text + line[end:]))}
        if R._MARK_HINT.search(line) and R._GAP_HINT.search(line):
            assert set(got) == want - {None}, line
        else:
            assert set(got) <= want
    assert seen > 400


def test_many_marks_in_one_long_line():
    """Forty thousand marks in a line of half a megabyte."""
    line = " ".join(f"[x{'abcdefghij'[i % 10]}{i}], word" for i in range(40_000))
    began = time.time()
    keys = R.empty_slots(line)
    assert len(keys) > 40_000 and time.time() - began < 60
