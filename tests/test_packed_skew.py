from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tomeworks.operators import packed, skew

SHELVES = ["Poetry", "Travel, Northern", "Folk Tales & Legends", "Arts and Crafts", "Law", "Children's Reading"]
CELLS = {
    # authors, expected
    "Smith, John": ["Smith, John"],
    "Smith, John, Capt.": ["Smith, John, Capt."],
    "Smith, John; Ann Doe": ["Smith, John", "Ann Doe"],
    "Smith, John;;Doe, Ann": ["Smith, John", "Doe, Ann"],
    "Smith, John; ": ["Smith, John"],
    "Smith, John | Doe, Ann|Roe & Sons": ["Smith, John", "Doe, Ann", "Roe & Sons"],
    '"Smith, John", Roe & Sons, "Doe, Ann"': ["Smith, John", "Roe & Sons", "Doe, Ann"],
    "['O'Neil, Pat', 'Doe, Ann']": ["O'Neil, Pat", "Doe, Ann"],
    "Smith, John; Doe, Ann and Roe, Max": ["Smith, John", "Doe, Ann", "Roe, Max"],
    "Ann Doe & Smith, John, Dr.": ["Ann Doe", "Smith, John, Dr."],
    "Roe and Sons": ["Roe and Sons"],
    "Todd & Sons, Publishers": ["Todd & Sons, Publishers"],
    "Ann Doe, Max Roe": ["Ann Doe", "Max Roe"],
    "Smith, John / Doe, Ann": ["Smith, John", "Doe, Ann"],
    "Smith, John\nDoe, Ann": ["Smith, John", "Doe, Ann"],
    "n/a": [],
    "[not known]": [],
    "  ": [],
    None: [],
    "": [],
}


@pytest.fixture(scope="module", params=["to the tasks", "by joins"])
def values(spark, request):
    few = packed.DICTIONARY, packed.SOURCES
    if request.param == "by joins":
        packed.DICTIONARY, packed.SOURCES = (0, 0), 0
    rows = [(i, "f" if i % 2 else None, a, s) for i, (a, s) in enumerate(zip(list(CELLS) * 6, SHELVES * 20, strict=True))]
    extra = [
        ("Travel, Northern, Law", ["Travel, Northern", "Law"]),
        ("Poetry/Folk Tales & Legends", ["Poetry", "Folk Tales & Legends"]),
        ("'Children's Reading', 'Law'", ["Children's Reading", "Law"]),
        ("Arts and Crafts and Law", ["Arts and Crafts", "Law"])
    ]
    rows += [(1000 + i, "f", None, s) for i, (s, _) in enumerate(extra)]
    df = spark.createDataFrame(
        rows, "rec_id long, feed string, authors string, bookshelf string"
    ).withColumns({"k": F.lit(1), "value": F.lit("x"), "pos": F.lit(0)})
    out = defaultdict(dict)
    for r in packed.split_packed(df, "rec_id", "feed", {"authors": "name", "bookshelf": "label"}).collect():
        out[r["rec_id"], r["field_name"]][r["pos"]] = r["value"]
    packed.DICTIONARY, packed.SOURCES = few
    return rows, extra, out


def test_names(values):
    rows, _, out = values
    for i, _, cell, _ in rows[:120]:
        got = out.get((i, "authors"), {})
        assert [got[p] for p in sorted(got)] == CELLS[cell], cell
        assert sorted(got) == list(range(1, len(got) + 1))


def test_labels(values):
    rows, extra, out = values
    for i, _, _, shelf in rows[:120]:
        assert out[i, "bookshelf"] == {1: shelf}
    for i, (_, wanted) in enumerate(extra):
        assert list(out[1000 + i, "bookshelf"].values()) == wanted


def test_labels_of_many_atoms(spark):
    shelves = ["Law", "Poetry", "Tales of the Old Northern Sea", "Birds, Beasts, Fish, Trees and Flowers"]
    cells = {f"{a} {b}": [a, b] for a in shelves[:3] for b in shelves[:3] if a != b} | {f"{shelves[3]}; {a}": [shelves[3], a] for a in shelves[:2]}
    rows = [(i, s) for i, s in enumerate(shelves * 5)] + [(100 + i, c) for i, c in enumerate(cells)]
    df = spark.createDataFrame(rows, "rec_id long, bookshelf string").withColumn("feed", F.lit("f"))
    out = defaultdict(dict)
    for r in packed.split_packed(df, "rec_id", "feed", {"bookshelf": "label"}).collect():
        out[r["rec_id"]][r["pos"]] = r["value"]
    assert [list(dict(sorted(out[100 + i].items())).values()) for i in range(len(cells))] == list(cells.values())


def test_words_that_close_a_name_are_learned(spark):
    cells = ["Roe & Gebrüder"] * 20 + ["Smith, John, Freiherr"] * 20 + ["Hale, Ann"] * 40
    asked = {
        "Smith, John, Freiherr, Doe, Ann": ["Smith, John, Freiherr", "Doe, Ann"], "Ann Roe & Gebrüder, Hale, Ann": ["Ann Roe & Gebrüder", "Hale, Ann"]
    }
    df = spark.createDataFrame([(i, "f", c) for i, c in enumerate([*cells, *asked])], "rec_id long, feed string, authors string")
    out = defaultdict(list)
    for r in packed.split_packed(df, "rec_id", "feed", {"authors": "name"}).orderBy("pos").collect():
        out[r["rec_id"]].append(r["value"])
    assert [out[80 + i] for i in range(len(asked))] == list(asked.values())


def test_cells_told_by_their_form_are_cut_like_others():
    for cell in ("Smith, John", "O'Neil , Pat", "Smith,\u00a0J. B.", "Ann Doe", "Smith-Roe, Ann of Ash"):
        assert packed.values_of(cell, "name", packed.HARD + "&", packed.Known.of(())) == [cell]


def test_very_long_cell(spark):
    names = [f"Last{i}, First" for i in range(5000)]
    df = spark.createDataFrame([(1, "f", "; ".join(names))], "rec_id long, feed string, authors string")
    assert packed.split_packed(df, "rec_id", "feed", {"authors": "name"}).count() == 5000


def test_no_rows(spark):
    df = spark.createDataFrame([], "rec_id long, feed string, authors string, bookshelf string")
    assert packed.split_packed(df, "rec_id", "feed", {"authors": "name", "bookshelf": "label"}).count() == 0


POSTINGS = "term string, docid long, passage_no int, tf int, block_no int"
LEXICON = "term string, df long, byte_offset long, length long, block_no int"


def brute(postings, lexicon):
    live = {p for p in postings if p[0] is not None and p[1] is not None and (p[3] or 0) >= 1}
    docs, tf = defaultdict(set), Counter()
    for t, d, _, n, b in live:
        docs[t, b].add(d)
        tf[t, b] += n
    wrong = {(t, b) for t, df, _, _, b in lexicon if df != len(docs[t, b])}
    return {k: (len(v), tf[k]) for k, v in docs.items() if v}, wrong


def test_counts_against_brute_force(spark):
    postings = [("hot", d, p, 1 + p, 1) for d in range(400) for p in range(3)] + [(f"t{d % 37}", d, 0, d % 3, 1 + d % 2) for d in range(200)]
    postings += postings[:50] + [(None, 1, 1, 1, 1), ("x", None, 1, 1, 1), ("y", 1, 1, None, 1), ("z", 1, 1, 2, None)]
    lexicon = [
        ("hot", 400, 0, 9, 1),
        ("hot", 400, 0, 9, 1),
        ("gone", 0, 0, 1, 1),
        ("dead", 3, 0, 1, 1),
        ("t5", None, 0, 1, 1),
        (None, 2, 0, 1, 1),
        ("z", 1, 0, 1, None)
    ] + [(f"t{i}", 2, 0, 1, 1) for i in range(37)]
    counts = skew.term_counts(
        spark.createDataFrame(postings, POSTINGS).withColumn("_slot", F.lit(7)),
        spark.createDataFrame(lexicon, LEXICON).withColumn("n_records", F.lit(0)),
        tasks=6
    ).cache()
    expected, wrong = brute(postings, lexicon)
    assert {(r["term"], r["block_no"]): (r["n_records"], r["total_tf"]) for r in counts.collect() if r["n_records"]} == expected
    assert {tuple(r) for r in skew.wrong_df(counts).collect()} == wrong


def test_no_tables(spark):
    counts = skew.term_counts(spark.createDataFrame([], POSTINGS), spark.createDataFrame([], LEXICON))
    assert counts.count() == 0 and skew.wrong_df(counts).count() == 0


def test_load_is_even(spark):
    loads = spark.createDataFrame([("hot", 100_000)] + [(f"k{i}", 100) for i in range(2000)], "k string, n long")
    plan = skew.plan_fragments(loads, ["k"], "n", tasks=12)
    assert max(plan.loads) < 1.1 * sum(plan.loads) / 12
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), "id")
    placed = plan.fragment(rows, ["id"])
    assert placed.count() == 3000 and placed.where("k = 'hot'").select("_slot").distinct().count() > 6


def test_rows_reach_their_task(spark):
    df = spark.range(1000).select((F.col("id") % 8).cast("int").alias("_slot"), F.col("id"))
    parts = skew.to_tasks(df, 8).select(F.spark_partition_id().alias("p"), "_slot").distinct()
    assert parts.count() == 8 and parts.select("p").distinct().count() == 8


def test_shard_join_is_a_join(spark):
    big = spark.range(2000).select(
        F.when(F.col("id") < 1500, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"), "id"
    )
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    got = skew.shard_join(big, small, ["k"], ["id"], "n")
    assert got.count() == 2000 and got.exceptAll(big.join(small, "k").select(*got.columns)).count() == 0
