import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomeworks.functions import codec, text
from tomeworks.operators import index


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["x"] for r in df.select("i", make(F.col("c")).alias("x")).orderBy("i").collect()]


CASES = {
    "out-of-date": ["out", "of", "date"],
    "they'd": ["theyd"],
    "No7 or 1911 or 3": ["no7", "or", "1911", "or", "3"],
    "snake_case": ["snake", "case"],
    "ﬂower": ["flower"],
    "Maße": ["masse"],
    "long‑lost—kin": ["long", "lost", "kin"],
    "": [],
    "… !": [],
    "x² 東京 Ⅷ": ["x2", "東京", "viii"],
}


def test_tokens(spark):
    assert column(spark, CASES, text.tokens) == list(CASES.values())
    assert [text.python_tokens(c) for c in CASES] == list(CASES.values())
    assert column(spark, [None], text.tokens) == [[]]


@settings(max_examples=30, deadline=None)
@given(values=st.lists(st.text(st.characters(min_codepoint=9, max_codepoint=126), max_size=20), min_size=1, max_size=20))
def test_texts_of_ascii_are_cut_alike_on_the_jvm(spark, values):
    assert column(spark, values, text.tokens) == [text.python_tokens(v) for v in values]
    assert column(spark, values, text.phrase_form) == [" ".join(text.TOKEN.findall(v.lower())) for v in values]


def test_query_tokens(spark):
    given_ = ["Grünkohl", "rose rosé", "rosé rose rose", "plain"]
    wanted = [["grünkohl", "grunkohl"], ["rose", "rosé"], ["rosé", "rose", "rose"], ["plain"]]
    assert column(spark, given_, text.query_tokens) == wanted
    assert [text.python_query_tokens(x) for x in given_] == wanted


def test_accents(spark):
    values = ["é", "ậ", "한글", "𑄮", "plain", None, "ﬁ"]
    bare = [None if v is None else "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn") for v in values]
    assert column(spark, values, text.strip_accents) == bare


def test_boilerplate(spark):
    cases = [
        "Notice\n*** START OF A\nBody\n*** end of A\nAfter",
        "p\n*** START OF\nq",
        "p\n*** END OF\nq",
        "none",
        "x\n*** END OF\ny\n*** START OF\nz",
        "",
    ]
    assert column(spark, cases, text.strip_boilerplate) == ["Body", "q", "p", "none", "", ""]


def test_document_tokens_strip_markers_and_line_ends(spark):
    texts = ["Notice\r\n*** START OF X\r\nOld Quay–side\r\n*** END OF X\r\n", "Été", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("content", F.lit("clash"))
    got = index.tokenised(docs, "i").orderBy("i").collect()
    assert [r["toks"] for r in got] == [["old", "quay", "side"], ["été"], [], []]


def test_slices_keep_order_and_nulls(monkeypatch):
    monkeypatch.setattr(text, "SLICE", 7)
    values = ["abc", None, "defgh", "i" * 20, "", "jk", None]
    assert text.in_slices(pa.array(values, pa.string()), str.upper, pa.string()).to_pylist() == [v and v.upper() for v in values]
    assert [len(x) for x in text.slices_of(pa.array(values, pa.string()))] == [2, 1, 1, 3]


def test_phrases(spark):
    cases = ['"far out" and "far in"', "Far out, far Ïn!", '"', '"..." only']
    assert column(spark, cases, text.phrase_query) == ["far out far in", "far out far ïn", "", "only"]


def test_metadata_form_and_key(spark):
    assert column(spark, ["  Roe,\tAda  M. ", None], text.metadata_form) == ["roe, ada m.", ""]
    assert column(spark, ["Ada M Roe", "Roe, Ada M."], text.sorted_key) == ["ada m roe"] * 2
    assert column(spark, ["Roe, Ada M.;;Ösk, Tim； Jr; ", None], text.author_keys) == [["ada m roe", "jr tim ösk"], []]


def test_plain_number(spark):
    assert column(spark, ["00012", "no. 7", "#31", "12.0", "", None, "x", "000"], text.plain_number) == ["12", "7", "31", "12", None, None, None, "0"]


@pytest.mark.parametrize("n,code", [(0, b"\x00"), (1, b"\x01"), (127, b"\x7f"), (300, b"\xac\x02"), (65_536, b"\x80\x80\x04")])
def test_codes(n, code):
    assert codec.encode_number(n) == code
    assert codec.decode_number(code) == (n, len(code))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 99_999), st.integers(1, 900)), unique_by=lambda p: p[0]))
def test_postings_bytes_round_trip(pairs):
    pairs = sorted(pairs)
    assert codec.decode_postings(codec.encode_postings(pairs)) == pairs


def test_bad_codes():
    with pytest.raises(ValueError):
        codec.encode_number(-1)
    with pytest.raises(ValueError):
        codec.decode_number(b"\xff" * 6)
    with pytest.raises(IndexError):
        codec.decode_number(b"\x80")


def test_gaps_over_ranges(spark):
    ids = [0, 3, 4, 90, 65_000]
    df = spark.createDataFrame([("t", i) for i in ids] + [("u", 9)], "term string, docid long")
    gapped = codec.posting_gaps(df, spread=4)
    assert [r["gap"] for r in gapped.where("term = 't'").orderBy("docid").collect()] == codec.gaps(ids)
    assert all(r["docid"] == r["restored"] for r in codec.gap_sums(gapped, spread=4).collect())
