import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brinework.llm import tokens as K

tiktoken = pytest.importorskip("tiktoken")
RANKS = K.read_ranks(f"{K.TOKENIZERS}/{K.DEFAULT}.tiktoken")
ENCODER = K.Encoder(RANKS)
PUBLIC = tiktoken.Encoding("own", pat_str=K.PIECES, mergeable_ranks=RANKS, special_tokens={})
TEXTS = st.text(alphabet=st.sampled_from("ab 1'éёжш​­漢🙂\n\t\x00.,-sdllreveт"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_same_as_public(text):
    assert ENCODER.encode(text) == PUBLIC.encode_ordinary(text)
    assert K.decode(ENCODER.encode(text), ENCODER.vocabulary).decode("utf-8") == text


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 60), st.integers(0, 10), TEXTS)
def test_edits(text, at, gone, new):
    at = min(at, len(text))
    gone = min(gone, len(text) - at)
    doc = K.Document(ENCODER, text)
    doc.edit(at, gone, new)
    want = text[:at] + new + text[at + gone :]
    assert doc.text == want and doc.ids() == PUBLIC.encode_ordinary(want)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=24), st.binary(max_size=8))
def test_prefix_table(raw, more):
    table = K.PrefixTable(ENCODER.vocabulary, raw)
    assert table.ids() == ENCODER.vocabulary.merge(raw)
    assert table.append(more).ids() == ENCODER.vocabulary.merge(raw + more)
    assert table.edit(len(raw) // 2, 1, b"x").ids() == ENCODER.vocabulary.merge(table.text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"the ", b"salt", b"mine", b"s", b" ", b"aaaa", b"\xd0\xb0"]), max_size=60), st.integers(0, 100), st.integers(0, 12), st.binary(max_size=6))
def test_edits_of_long_tables(parts, at, gone, new):
    raw = b"".join(parts)
    at = min(at, len(raw))
    table = K.PrefixTable(ENCODER.vocabulary, raw).edit(at, gone, new)
    want = K.PrefixTable(ENCODER.vocabulary, raw[:at] + new + raw[at + gone :])
    assert table.text == want.text and table.last == want.last


def test_edit_of_a_table_stops_early():
    raw = b"salt mine " * 3000
    table = K.PrefixTable(ENCODER.vocabulary, raw)
    seen = []
    append = table.append
    table.append = lambda more: (seen.append(len(more)), append(more))[1]
    table.edit(1000, 3, b"xyz")
    assert sum(seen) < 5 * ENCODER.vocabulary.longest and table.last == K.PrefixTable(ENCODER.vocabulary, table.text).last


def test_edit_encodes_little():
    doc = K.Document(ENCODER, "слово " * 5000)
    assert doc.edit(12000, 3, "иное") < 8


def test_documents(spark):
    long = "очень длинный текст " * 20000
    df = spark.createDataFrame([(1, "Hello мир"), (2, ""), (3, None), (4, " "), (5, "<|endoftext|>"), (6, long), (7, "Hello мир")], "doc_id long, text string").selectExpr("*", "'clash' AS ids", "1 AS tokens")
    out = df.select("doc_id", K.token_ids(spark, K.F.col("text")).alias("ids"), K.token_count(spark, K.F.col("text")).alias("n"))
    got = {r["doc_id"]: (r["ids"], r["n"]) for r in out.collect()}
    assert got[2] == got[3] == ([], 0)
    assert got[1][0] == got[7][0] == PUBLIC.encode_ordinary("Hello мир") and got[4][0] == PUBLIC.encode_ordinary(" ")
    assert 50256 not in got[5][0] and got[6][0] == PUBLIC.encode_ordinary(long) and got[6][1] == len(got[6][0])


def test_file_is_ranks():
    assert len(RANKS) == 50256 and base64.b64encode(b"!") and RANKS[b"!"] == 0
