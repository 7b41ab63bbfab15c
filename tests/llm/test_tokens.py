import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import tokens

RAW = os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(RAW), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    raw = open(RAW, "rb").read()
    enc = tokens.BytePairEncoder(tokens.read_ranks(raw))
    return enc, tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=200))
def test_same_ids_as_the_library_and_round_trip(pair, text):
    ours, theirs = pair
    ids = ours.encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert ours.decode(ids) == text


def test_long_piece(pair):
    ours, theirs = pair
    assert ours.encode("ab" * 20_000) == theirs.encode_ordinary("ab" * 20_000)
    assert ours.encode("漢字" * 3000) == theirs.encode_ordinary("漢字" * 3000)


def test_columns(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "Hello world")], "doc_id long, text string").withColumnRenamed("x", "ids")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()}
    assert got[1] == got[4] and got[1] and got[2] == [] and got[3] is None
    back = df.select("doc_id", tokens.decoded(spark, tokens.token_ids(spark, "text")).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {1: "Hello world", 2: "", 3: None, 4: "Hello world"}
    n = {r.doc_id: r.n for r in df.select("doc_id", tokens.token_count(spark, "text").alias("n")).collect()}
    assert n == {1: len(got[1]), 2: 0, 3: 0, 4: len(got[1])}


def test_empty_table(spark):
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rank_file():
    assert tokens.read_ranks(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"ab") + b" 1\n\n") == {b"a": 0, b"ab": 1}
