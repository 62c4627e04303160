import dataclasses
import math

import pytest
from pyspark.sql import functions as F

from tomeworks.operators import evalkit, index, metadata, phrase, rank, snippet


DOCS = [
    ("a1", "otter heron otter otter"),
    ("b2", "heron newt"),
    ("c3", "newt, newt and OTTER"),
    ("d4", "marsh"),
    ("a1", "heron again"),
    ("e5", None),
    ("f6", "")
]


@pytest.fixture(scope="module")
def small(spark):
    return index.build(spark.createDataFrame(DOCS, "gutenberg_id string, text string"))


def test_statistics(small):
    assert {r["term"]: r["df"] for r in small.lexicon.collect()} == {"otter": 2, "heron": 2, "newt": 2, "and": 1, "marsh": 1, "again": 1}
    stats = {r["gutenberg_id"]: r for r in small.docstats.collect()}
    # The two texts of a1 count together.
    assert {r["doc_len"] for r in small.postings.where("gutenberg_id = 'a1'").collect()} == {6}
    assert {k: r["doc_len"] for k, r in stats.items()} == {"a1": 6, "b2": 2, "c3": 4, "d4": 1, "e5": 0, "f6": 0}
    assert small.n == 6 and small.avgdl == pytest.approx(13 / 6)
    assert {(r["term"], r["tf"]) for r in small.postings.where("gutenberg_id = 'a1'").collect()} == {("otter", 3), ("heron", 2), ("again", 1)}
    weight = lambda tf, df: (1 + math.log(tf)) * (math.log(7 / (df + 1)) + 1)
    assert stats["a1"]["doc_norm"] == pytest.approx(math.sqrt(weight(3, 2) ** 2 + weight(2, 2) ** 2 + weight(1, 1) ** 2))
    assert stats["f6"]["doc_norm"] == 0.0 and index.validate(small).count() == 0


def test_alias_rows_are_not_merged(spark):
    docs = [("0", "Försterin"), ("0", "Försterin"), ("1", "rose rosé"), ("2", "한글"), (None, "lost")]
    i = index.build(spark.createDataFrame(docs, "gutenberg_id string, text string"))
    rows = sorted((r["gutenberg_id"], r["term"], r["tf"]) for r in i.postings.collect())
    assert rows[:5] == [("0", "forsterin", 2), ("0", "försterin", 2), ("1", "rose", 1), ("1", "rose", 1), ("1", "rosé", 1)] and len(rows) == 7
    assert {r["term"]: r["df"] for r in i.lexicon.collect()}["rose"] == 2
    assert {r["gutenberg_id"]: r["doc_len"] for r in i.docstats.collect()} == {"0": 2, "1": 2, "2": 1}


def test_save_and_load(spark, small, tmp_path):
    with pytest.raises(ValueError):
        index.load(spark, str(tmp_path / "none"))
    path = str(tmp_path / "i")
    index.save(small, path)
    again = index.load(spark, path)
    assert again.n == 6 and again.lexicon.count() == 6

    # A rebuild that dies half-way leaves nothing that is taken for an index.
    class Dying:
        def __getattr__(self, name):
            raise RuntimeError("died")

    with pytest.raises(RuntimeError):
        index.save(dataclasses.replace(small, docstats=small.docstats, lexicon=Dying()), path)
    with pytest.raises(ValueError):
        index.load(spark, path)
    index.save(small, path)
    assert index.load(spark, path).n == 6


def hand_made(spark):
    long = {"x": 5, "y": 1, "z": 6}
    posts = [(t, d, n, long[d]) for t, d, n in (("reed", "x", 4), ("reed", "y", 1), ("wren", "x", 1), ("wren", "z", 2), ("teal", "z", 3), ("void", "x", 0))]
    p = spark.createDataFrame(posts, "term string, gutenberg_id string, tf int, doc_len long")
    stats = spark.createDataFrame([("x", 5, 2.5), ("y", 1, 1.25), ("z", 6, 3.5)], "gutenberg_id string, doc_len long, doc_norm double")
    return index.Index(p, index.lexicon_of(p), stats, 3, 4.0)


@pytest.mark.parametrize("few", [rank.FEW, 0])
def test_models(spark, few, monkeypatch):
    monkeypatch.setattr(rank, "FEW", few)
    i = hand_made(spark)
    q = rank.asked(rank.query_frame(spark, {1: "teal", 2: "reed wren", 3: "void", 4: "", 5: "zzz"}))
    assert q.few == bool(few)
    bm = {(r["query_nr"], r["gutenberg_id"]): r["score"] for r in rank.bm25(i, q).collect()}
    assert bm == {(1, "z"): pytest.approx(round(math.log(2.5 / 1.5) * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 6 / 4)), 6))}
    vs = rank.cosine(i, q).collect()
    assert {r["gutenberg_id"] for r in vs if r["query_nr"] == 2} == {"x", "y", "z"}
    assert not [r for r in vs if r["query_nr"] in (3, 4, 5)]


def shelves(spark):
    rows = [
        ("10", "The Heron's Winter", "Roe, Ada M.", 1),
        ("20", "Winter Roads", "Nobody Known", 0),
        ("30", "Marsh Songs", "Ash, Tom;Roe, Ben", 1),
        ("70", None, None, 1)
    ]
    m = spark.createDataFrame(rows, "gutenberg_id string, title string, authors string, has_text int")
    return rank.searchable(m.select("*", F.lit("en").alias("language"), F.lit(None).cast("string").alias("bookshelf"), F.lit("").alias("rights")))


@pytest.mark.parametrize("few", [rank.FEW, 0])
def test_structured(spark, few, monkeypatch):
    monkeypatch.setattr(rank, "FEW", few)
    q = rank.asked(rank.query_frame(spark, {1: "Ada M Roe", 2: "roads", 3: "en", 4: "herons winter", 5: "Ben Roe", 6: "   ", 7: "arsh son"}))
    got = sorted((r["query_nr"], r["gutenberg_id"], r["score"]) for r in rank.structured(shelves(spark), q).collect())
    assert got == [
        (1, "10", 8.0),
        (1, "30", 1.0),
        (3, "10", 1.0),
        (3, "30", 1.0),
        (3, "70", 1.0),
        (4, "10", 14.0),
        (5, "10", 1.0),
        (5, "30", 7.0),
        (7, "30", 10.0)
    ]
    assert [r["gutenberg_id"] for r in rank.structured(shelves(spark), q, include_missing_text=True).where("query_nr = 2").collect()] == ["20"]


def test_rank_ties_are_by_string(spark):
    r = spark.createDataFrame([(1, "7", 1.5), (1, "100", 1.5), (1, "42", 2.0)], "query_nr int, gutenberg_id string, score double")
    assert [(x["rank"], x["gutenberg_id"]) for x in rank.rank(r).orderBy("rank").collect()] == [(1, "42"), (2, "100"), (3, "7")]


def test_trigger(spark):
    p = spark.createDataFrame(
        [(t, str(d), 1) for t in ("to", "be", "or", "not") for d in range(9)] + [("rare", "9", 1)], "term string, gutenberg_id string, tf int"
    )
    i = index.Index(p, index.lexicon_of(p), spark.createDataFrame([("0", 1, 1.0)], "gutenberg_id string, doc_len long, doc_norm double"), 10, 4.0)
    q = rank.asked(rank.query_frame(spark, {1: "to be, or not to be", 2: "to be", 3: 'one "', 4: "to be rare thing"}))
    assert {r["query_nr"]: r["fallback"] for r in rank.triggered(i, q).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_phrase_fallback(spark):
    docs = spark.createDataFrame(
        [("77", "Far out, or far in: that is not asked."), ("2", "nothing"), ("3", "a start here"), ("4", "art"), ("4", "Grüße; tart")],
        "gutenberg_id string, text string"
    )
    i = index.build(docs)
    q = rank.asked(rank.query_frame(spark, {1: '"far in that"', 2: '"tar"', 3: '"art"', 4: '"', 5: "nothing"}))
    got = {(r["query_nr"], r["gutenberg_id"]): (r["score"], r["fallback_used"]) for r in phrase.bm25_with_fallback(i, docs, q).collect()}
    assert got[(1, "77")][0] > 5 and got[(2, "3")] == got[(2, "4")] == (5.0, True)
    assert got[(3, "4")][0] > 5 and (3, "3") not in got and not got[(5, "2")][1]
    none = phrase.bm25_with_fallback(i, docs, q, allow_full_scan=False)
    assert not none.where("query_nr = 2").count() and none.where("query_nr = 1").first()["score"] == got[(1, "77")][0]


def test_caps_of_the_fallback(spark):
    docs = spark.createDataFrame(
        [(str(k), "owl " * (k % 5 + 1) + "swan") for k in range(30)] + [(str(k), "filler text") for k in range(30, 90)],
        "gutenberg_id string, text string"
    )
    i = index.build(docs)
    q = rank.asked(rank.query_frame(spark, {1: '"owl swan"', 2: '"wl swa"'}))
    plain = rank.rank(rank.bm25(i, q), 7).where("query_nr = 1").collect()
    rows = phrase.bm25_with_fallback(i, docs, q, reranked=7, scanned=4).collect()
    assert {
        (r["gutenberg_id"], r["score"]) for r in rows if r["query_nr"] == 1
    } == {(r["gutenberg_id"], r["score"] + 5.0) for r in plain} and len(plain) == 7
    assert sorted(r["gutenberg_id"] for r in rows if r["query_nr"] == 2) == sorted(map(str, range(30)))[:4]


def test_snippets(spark):
    body = "first line\nsecond line\n" + "x " * 200 + "\nhere is a needle in the text\n" + "y " * 200
    docs = spark.createDataFrame(
        [
            ("1", body, 1),
            ("2", "needle  \n short", 1),
            ("3", "it's", 1),
            ("4", "no such word", 1),
            ("4", "a Ñandú needle", 2),
            ("4", "needle too", 3)
        ],
        "gutenberg_id string, text string, part int"
    )
    i = index.build(docs)
    q = rank.asked(rank.query_frame(spark, {1: "needle its", 2: "needle"}))
    results = spark.createDataFrame([(1, "1"), (1, "2"), (1, "3"), (1, "9"), (2, "4")], "query_nr int, gutenberg_id string")
    got = {r["gutenberg_id"]: (r["snippet"], r["start_line"]) for r in snippet.snippets(i, docs, q, results, order="part").collect()}
    pos = body.index("needle")
    start = pos + 3 - 125
    assert got["1"] == (" ".join(body[start : start + 250].split()), str(1 + body[:start].count("\n")))
    assert got["2"] == ("needle short", "1") and got["3"] == ("it's", "1") and got["9"] == ("", "")
    assert got["4"] == ("a Ñandú needle", "1")


def test_best_token_tie_goes_to_query_order(spark):
    i = index.build(spark.createDataFrame([("1", "alpha beta"), ("2", "gamma")], "gutenberg_id string, text string"))
    results = spark.createDataFrame([(1, "1")], "query_nr int, gutenberg_id string")
    assert snippet.best_tokens(i, rank.asked(rank.query_frame(spark, {1: "beta alpha"})), results).first()["token"] == "beta"


def test_merge(spark):
    rows = [
        ("1", "Tide Almanac", "Ash, Tom", "en"),
        ("01", "Tide Almanac", "Roe, Ada", "en"),
        ("2.0", " ", None, "en"),
        ("x", "lost", None, None),
        (None, None, None, None)
    ]
    m = spark.createDataFrame(rows, "gutenberg_id string, title string, authors string, language string").withColumns(
        {"bookshelf": F.lit("Science"), "rights": F.lit(None).cast("string"), "has_text": F.lit(5)}
    )
    docs = spark.createDataFrame([("1",), (None,)], "gutenberg_id string")
    flagged = metadata.flag_text(metadata.merge(m), docs)
    got = {r["gutenberg_id"]: r for r in flagged.collect()}
    assert set(got) == {"1", "2"} and got["1"]["authors"] == "Ash, Tom;Roe, Ada" and got["2"]["title"] == ""
    assert (got["1"]["has_text"], got["2"]["has_text"]) == (1, 0)
    assert metadata.report(m, flagged).first().asDict() == {"raw_rows": 5, "unique_ids": 2, "with_text": 1, "missing_text": 1}


LABELS = [1, 0, 2, 1, 0]


def test_metrics(spark):
    j = spark.createDataFrame(
        [("1", "bm25", i + 1, str(i), x) for i, x in enumerate(LABELS)] + [("2", "bm25", 1, "a", 0)],
        "query_nr string, model string, rank int, gutenberg_id string, label int"
    )
    m = {r["query_nr"]: r for r in evalkit.metrics(j).collect()}
    assert (m["1"]["p_at_k"], m["1"]["p_at_k_partial"], m["1"]["ap"]) == (0.2, 0.25, 0.75)
    gain = [1, 0, 0.5, 1, 0]
    dcg = lambda g: sum(x / math.log2(i + 2) for i, x in enumerate(g))
    assert m["1"]["ndcg"] == round(dcg(gain) / dcg(sorted(gain, reverse=True)), 4)
    assert (m["2"]["ap"], m["2"]["ndcg"]) == (0.0, 0.0)
    assert {r["query_nr"]: r["p"] for r in evalkit.judged_precision(j).collect()} == {"1": 0.4, "2": 0.0}
    assert evalkit.summary(evalkit.metrics(j)).first()["mean_p_at_k"] == 0.1


def test_overlap_and_quantiles(spark):
    q = rank.query_frame(spark, {1: "x"})
    r = spark.createDataFrame(
        [(1, "vsm", k, str(k), 5.0 - k) for k in (1, 2, 3)] + [(1, "bm25", 1, "2", 9.0)],
        "query_nr int, model string, rank int, gutenberg_id string, score double"
    )
    o = {(x["model_1"], x["model_2"]): (x["overlap"], x["jaccard"]) for x in evalkit.overlap(r, q).collect()}
    assert o == {("structured", "vsm"): (0, 0.0), ("structured", "bm25"): (0, 0.0), ("vsm", "bm25"): (1, 0.3333)}
    s = {x["model"]: x for x in evalkit.score_quantiles(r, q).collect()}
    assert (s["vsm"]["p25"], s["vsm"]["median"], s["structured"]["result_count"], s["structured"]["p25"]) == (2.5, 3.0, 0, None)


def test_validation_finds_each_fault(spark):
    good = ["1\t42\t2.0\t\t", "2\t100\t1.5\t\t", "3\t7\t1.5\t\t"]
    lists = {
        "a": good,
        "b": ["1\t2\t3"],
        "c": ["1\t1\t2.0\t\t", "3\t2\t1.0\t\t"],
        "d": ["1\t1\t1.0\t\t", "2\t2\t2.0\t\t"],
        "e": ["1\tB\t1.0\t\t", "2\tA\t1.0\t\t"],
        "f": [f"{i + 1}\t{i}\t1.0\t\t" for i in range(101)]
    }
    lines = spark.createDataFrame(
        [(k, "m", i + 1, v) for k, vs in lists.items() for i, v in enumerate(vs)], "query_nr string, model string, line int, value string"
    )
    expected = spark.createDataFrame([(k, "m") for k in "abcdefg"], "query_nr string, model string")
    got = {(r["query_nr"], r["failure"]) for r in evalkit.validate_lists(lines, expected).collect()}
    assert {x for x in got if x[0] != "f"} == {
        ("b", "columns"), ("c", "rank not in sequence"), ("d", "score rises"), ("e", "ids of a tie descend"), ("g", "missing")
    }
    assert ("f", "too many rows") in got


def test_dense_ids(spark):
    df = spark.createDataFrame([(str(i),) for i in (*range(50), 3)] + [(None,)], "k string")
    got = {r["k"]: r["docid"] for r in index.dense_ids(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(map(str, range(50))))}
