"""Problems 1, 3, 5: terms, look-alike characters, survivors."""

import datetime as dt
import math
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomeworks.llm import codepoints as C
from tomeworks.llm import p1_distinctive as p1
from tomeworks.llm import p3_lookalikes as p3
from tomeworks.llm import p5_survivor as p5

POSTINGS = "term string, docid long, passage_no int, tf int, block_no int"
STATS = "docid long, gutenberg_id string, doc_len long, doc_norm double"


def test_residuals_against_brute_force(spark):
    posts = [(f"t{(d * 7 + k) % 23}", d, k, 1 + (d + k) % 4, 1) for d in range(30) for k in range(9)] + [("the", d, 0, 5, 1) for d in range(30)]
    posts += posts[:9] + [(None, 1, 1, 1, 1), ("x", None, 1, 1, 1), ("dead", 3, 1, 0, 1), ("dead", 3, 1, None, 1)]
    live = {p for p in posts if p[0] and p[1] is not None and (p[3] or 0) >= 1}
    n, total, length, df = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
    for t, d, _, tf, _ in live:
        n[d, t] += tf
        total[t] += tf
        length[d] += tf
        df[t].add(d)
    stats = [(d, str(d), length[d], None) for d in range(30)] + [(0, "0", length[0], 1.0), (99, "99", 0, 0.0), (None, "n", 5, 0.0)]
    whole = sum(length.values())
    scores = p1.term_scores(spark.createDataFrame(posts, POSTINGS).withColumn("n", F.lit("clash")), spark.createDataFrame(stats, STATS))
    got = {(r["docid"], r["term"]): (r["n"], r["n_records"], r["residual"]) for r in scores.collect()}
    assert set(got) == set(n)
    for (d, t), (count, records, residual) in got.items():
        e = length[d] * total[t] / whole
        want = (n[d, t] - e) / math.sqrt(e * (1 - length[d] / whole) * (1 - total[t] / whole))
        assert count == n[d, t] and records == len(df[t]) and abs(residual - want) < 1e-9
    found = {(r["docid"], r["term"]) for r in p1.distinctive(scores, 3, 0.05, 2, 15).collect()}
    assert found == {k for k in n if got[k][2] > 0 and n[k] >= 3 and n[k] >= 0.05 * length[k[0]] and 2 <= len(df[k[1]]) <= 15}


def test_residuals_of_nothing(spark):
    assert p1.term_scores(spark.createDataFrame([], POSTINGS), spark.createDataFrame([], STATS)).count() == 0
    unknown = p1.term_scores(spark.createDataFrame([("a", 1, 0, 2, 1)], POSTINGS), spark.createDataFrame([], STATS))
    assert [tuple(r)[2:] for r in unknown.collect()] == [(2, None, 1, 2, None, None)] and p1.distinctive(unknown).count() == 0
    one = p1.term_scores(spark.createDataFrame([("a", 1, 0, 2, 1)], POSTINGS), spark.createDataFrame([(1, "1", 2, None)], STATS)).first()
    assert one["residual"] is None and one["share"] == 1.0


PLAIN = {
    "Wooden Chest": ("Wooden Chest", False),
    "Woоden Chest": ("Wooden Chest", True),  # Cyrillic o
    "Тhе Cloak": ("The Cloak", True),
    "Ｗｉｎｉｆｒｅｄ": ("Winifred", True),
    "Café": ("Café", True),
    "Café": ("Café", False),
    "oﬃce": ("office", True),
    "a​b﻿c­": ("abc", True),
    "a b c": ("a b c", True),
    "Записки долгой зимы": ("Записки долгой зимы", False),
    "Записки, Vol. II": ("Записки, Vol. II", False),
    "Зaписки": ("Записки", True),  # Latin a
    "Ιστορίες του βορρά": ("Ιστορίες του βορρά", False),
    "Dash — quote ’ “x” … -": ("Dash — quote ’ “x” … -", False),
    "": ("", False),
    "ậ": ("ậ", True),
    "ậ": ("ậ", True),
}


def test_plain_form(spark):
    rows = [(i, t, None) for i, t in enumerate(PLAIN)] + [(50, None, "x"), (50, None, "x")]
    got = p3.level_columns(
        spark.createDataFrame(rows, "rec_id long, title string, authors string").withColumn("title_odd", F.lit(3)), "rec_id", ["title", "authors"]
    ).collect()
    for r in got:
        wanted = (None, False) if r["rec_id"] == 50 else list(PLAIN.values())[r["rec_id"]]
        assert (r["title"], r["title_odd"]) == wanted, r
    assert len(got) == len(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aẹ́̂ñ가ᄀ​ﬁＡ  "), st.characters(codec="utf-8", max_codepoint=0x2FFF)), max_size=12), max_size=6))
def test_round_trip_and_composition(texts):
    a = pa.array(texts, pa.string())
    t = C.from_arrow(a)
    assert C.to_arrow(t).to_pylist() == texts
    # Hangul syllables from letters are not in the table of pairs.
    decomposed = [unicodedata.normalize("NFD", x) for x in texts if not any("ᄀ" <= c <= "ᇿ" or "가" <= c <= "힣" for c in x)]
    made = C.to_arrow(C.compose(C.from_arrow(pa.array(decomposed, pa.string())))).to_pylist()
    for before, after in zip(decomposed, made, strict=True):
        assert unicodedata.normalize("NFD", after) == before


def test_very_long_runs_of_marks():
    t = C.from_arrow(pa.array(["a" + "́" * 5000, "b"]))
    assert C.to_arrow(C.level(t)[0]).to_pylist() == ["á" + "́" * 4999, "b"]


def reference_words(text):
    import re

    text = re.sub(r"(?<=\w)-[ \t]*\r?\n\s*(?=\w)", "", text)
    text = re.sub(r"(?<=\w)-(?=\w)", "", text).replace("'", "").replace("’", "")
    return re.findall(r"[^\W_]+", text.casefold())


def test_words():
    texts = ["Carp-\nenter’s well-known -- x_y", "", "it's\r\nnort-\r\n  hern.", "a - b", "ﬁn STRASSE Straße", "end-", "-start"]
    w = C.words(C.fold_table().apply(C.level(C.from_arrow(pa.array(texts)))[0]))
    counts = np.bincount(w.row, minlength=len(texts)).tolist()
    assert counts == [len(reference_words(unicodedata.normalize("NFKC", x))) for x in texts]
    last = C.words(C.fold_table().apply(C.from_arrow(pa.array(["strasse straße STRASSE"]))))
    assert len(set(last.hash.tolist())) == 1
    marked = C.words(C.from_arrow(pa.array(["one [12] two<i>three</i> {3}four [x]"])), markup=True)
    assert len(marked.hash) == 5


def n_words(*texts, markup=True):
    w = C.words(C.fold_table().apply(C.level(C.from_arrow(pa.array(texts)))[0]), markup=markup)
    return np.bincount(w.row, minlength=len(texts)).tolist()


def test_markup_of_any_length_and_kind():
    tags = [f'<span class="{"x" * 90}">', '<span\nclass="y">', '<a title="é">', "</i>", "<!-- note -->", "[1]", "[1234567]", "{12345678901}"]
    assert n_words(*(f"one {t} two" for t in tags)) == [2] * len(tags)
    assert n_words("one < two > three", "one [x] two", "one <b two", "one [12", "] two <b", "c> three") == [3, 3, 3, 2, 2, 2]


def test_words_split_at_a_line_end_before_any_number_of_blanks():
    assert n_words("wo-\n" + " " * 40 + "rd", "wo-" + " " * 30 + "\r\n\n\trd", "wo-" + " " * 30 + "rd", "wo-\n-rd", "wo-\n") == [1, 1, 2, 2, 1]


def test_letters_and_signs_of_all_planes():
    assert n_words("\U00030001\U00030002 \U00031350") == [2]
    plain, odd = C.level(C.from_arrow(pa.array(["ab\U000e0041c", "a\U000e0101b", "ʙird ᴡood", "Bօօk", "Ꭰonald", "ꓐook", "Ⲣoem", "Հայաստան"])))
    assert C.to_arrow(plain).to_pylist() == ["abc", "ab", "Bird Wood", "Book", "Donald", "Book", "Poem", "Հայաստան"]
    assert odd.tolist() == [True] * 7 + [False]


def test_blocks_do_not_change_words(monkeypatch):
    texts = ["it's a well-\n   known <b>day</b> ﬁnd [12] ab’c " * 5, "", "x" * 300, "a b", "-", "e" * 40 + " y"]
    make = lambda: [c.tolist() for c in C.words(C.fold_table().apply(C.level(C.from_arrow(pa.array(texts)))[0]), markup=True)]
    whole = make()
    for size in (1, 7, 64):
        monkeypatch.setattr(C, "BLOCK", size)
        assert make() == whole


META = "rec_id long, gutenberg_id string, title string, authors string, language string, bookshelf string, rights string, has_text int, feed string, updated_at timestamp, loaded_at timestamp"


def meta(i, book, title, authors="A", rights="R", feed="lo", day=1):
    at = dt.datetime(2020, 1, day) if day else None
    return (i, book, title, authors, "en", None, rights, 1, feed, at, None)


def test_survivors(spark):
    rows = [
        meta(1, "7", "T", day=2), meta(2, "007", "T", "n/a", day=3), meta(3, "no. 7", "T...", feed="hi", day=1),  # each better in one respect: no case
        meta(4, "8", "Good", day=5), meta(5, "8.0", "Go [cut]", day=4), meta(6, "8", "Good", day=5),  # 4 and 6 are one
        meta(7, "9", "One", day=1),  # single
        meta(8, "10", "A", day=3), meta(9, "10", "B", day=3),  # latest twice
        meta(10, "11", None, None, None, None, None), meta(11, "11", "x", None, None, "lo", 1),
        meta(12, "none", "x"), meta(13, None, "x"),
    ]
    feeds = spark.createDataFrame([("lo", 1), ("hi", 5), ("hi", 4)], "feed string, trust int")
    scored = p5.ranked(p5.distinct_rows(spark.createDataFrame(rows, META)), feeds)
    best = {r["_book"]: r["rec_id"] for r in p5.survivors(scored).collect()}
    assert best == {"7": 1, "8": 4, "9": 7, "10": 8, "11": 11}
    facts = {r["_book"]: r["_rows"] for r in p5.group_facts(scored).collect()}
    assert facts == {"7": 3, "8": 2, "9": 1, "10": 2, "11": 2}
    clashing = spark.createDataFrame(rows, META).withColumns({c: F.lit("x") for c in ("_book", "_trust", "_feed", "_score", "_has_title", "trust")})
    assert {r["_book"]: r["rec_id"] for r in p5.survivors(p5.ranked(p5.distinct_rows(clashing), feeds)).collect()} == best
    none = p5.ranked(p5.distinct_rows(spark.createDataFrame([], META)), feeds)
    assert p5.survivors(none).count() == 0


def test_survivor_queries(spark, tmp_path):
    rows = [meta(1, "7", "T", day=2), meta(2, "007", "T", "n/a", day=1), meta(3, "8", "Good", day=5), meta(4, "8", "Go…", day=6)]
    spark.createDataFrame(rows, META).write.parquet(str(tmp_path / "metadata.parquet"))
    spark.createDataFrame([("lo", 1)], "feed string, trust int").write.parquet(str(tmp_path / "feeds.parquet"))
    assert [tuple(r) for r in p5.p5_found(spark, str(tmp_path)).collect()] == [("7", 1)]
    assert {r["gutenberg_id"]: r["title"] for r in p5.p5_golden(spark, str(tmp_path)).collect()} == {"7": "T", "8": "Good"}
