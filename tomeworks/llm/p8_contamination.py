"""Problem 8: evaluation texts leaking into training text.

Every run of five words of a test item is a seed. One pass over the corpus finds them in documents.

Edited copies: every seed joins a document to its items, so a copy is found by any five words that
the edits left, and is aligned where its text is read. The part of a document that is aligned holds
every alignment through the seed: left of it a positive score has at most three words of the
document to each of the item, as two words more cost what one equal word gives, and right of it
likewise.

If only runs of so many equal words are sought, the pass keeps of each document no more than the
words around its seeds in which such a run can lie. The seeds' counts over the whole corpus come
from what it kept; then the rarest held seed of each such window of an item is enough to join.

Where a seed joins, a Smith-Waterman alignment of words scores the copy, edited or whole, and the
longest run of equal consecutive words is measured on the same matrix.

The test items are the stated query set: they go to the tasks in blocks of at most BLOCK items, and
the corpus is read once for each block.

Defined results: null or empty texts and passages match nothing; an item of fewer than five words
has no seed and matches nothing; repeated rows give one result per pair of ids; empty tables give
no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks.llm import codepoints as C
from tomeworks.session import materialize, table

SEED, RUN, EQUAL, BLOCK = 5, 12, 10, 20_000
MATCH, MISMATCH, GAP = 2, -1, -1
REACH = 1 - MATCH // max(MISMATCH, GAP)  # words of a document to each word of an item in an alignment of positive score, at most
CELLS = 1 << 20
FILTER_BITS = 22


def folded(t: C.Texts) -> C.Texts:
    return C.fold_table().apply(C.level(t)[0])


class Items:
    """The words of a block of test items and the seeds among them."""

    def __init__(self, ids: list, passages: list[str | None]):
        w = C.words(folded(C.from_arrow(pa.array(passages, pa.string()))), markup=True)
        self.ids = ids
        self.start = np.searchsorted(w.row, np.arange(len(ids) + 1))
        self.hash = w.hash
        self.gram, self.at = C.ngrams(w, SEED)  # at: number of the seed's first word
        self.item = w.row[self.at] if len(self.at) else np.empty(0, np.int64)
        self.seeds = np.unique(self.gram)
        self.own = np.unique(C.mix(w.hash ^ C.mix(w.row.astype(np.uint64))))

    def shared(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """How many words of each window are words of its item: no alignment has more equal ones."""
        size = high - low
        off = C.offsets(size)
        at = np.repeat(low - off[:-1], size) + np.arange(off[-1])
        key = C.mix(hashes[at] ^ C.mix(np.repeat(item, size).astype(np.uint64)))
        i = np.minimum(np.searchsorted(self.own, key), len(self.own) - 1)
        return np.add.reduceat((self.own[i] == key).astype(np.int64), off[:-1])

    def every(self) -> tuple[np.ndarray, np.ndarray]:
        """All seeds, as sorted hashes and their places."""
        order = np.argsort(self.gram, kind="stable")
        return self.gram[order], order

    def chosen(self, counts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Seeds that are the rarest of some window of run words, as sorted hashes and their places.

        A window with a seed that no document holds is whole in none, so such a seed may stand for it.
        """
        rank = np.lexsort((self.gram, counts[np.searchsorted(self.seeds, self.gram)])).argsort()
        keep = np.zeros(len(self.gram), bool)
        for i in range(len(self.ids)):
            a, b = np.searchsorted(self.item, [i, i + 1])
            if a == b:
                continue
            width = min(run - SEED + 1, b - a)
            windows = np.lib.stride_tricks.sliding_window_view(rank[a:b], width)
            keep[a + np.arange(len(windows)) + windows.argmin(axis=1)] = True
        place = np.flatnonzero(keep)
        order = place[np.argsort(self.gram[place], kind="stable")]
        return self.gram[order], order


def seed_filter(seeds: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, bool)
    out[(seeds & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    return out


def lookup(gram: np.ndarray, seeds: np.ndarray, screen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams are seeds, and the first place of each among the sorted seeds."""
    maybe = np.flatnonzero(screen[(gram & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
    i = np.searchsorted(seeds, gram[maybe])
    hit = seeds[np.minimum(i, len(seeds) - 1)] == gram[maybe]
    return maybe[hit], i[hit]


def merged(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of a row (or other group) joined: row, low, high; and the joined one of each window."""
    order = np.lexsort((low, row))
    row, low, high = row[order], low[order], high[order]
    size = np.int64(high.max(initial=0) + 1)
    reach = np.maximum.accumulate(high + row * size) - row * size
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (low[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    joined = np.empty(len(row), np.int64)
    joined[order] = np.cumsum(fresh) - 1
    return row[first], low[first], np.maximum.reduceat(high, first), joined


def around_seeds(documents: DataFrame, key: str, text: str, seeds: np.ndarray, run: int) -> DataFrame:
    """row_key, seeds (numbers of the seeds in it), part: the folded text around seeds in which a run of so many equal words can lie."""
    source = documents.select(F.col(key).alias("row_key"), F.make_valid_utf8(F.col(text)).alias("row_text"))
    schema = f"row_key {documents.schema[key].dataType.simpleString()}, seeds array<int>, part string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = seed_filter(seeds)
        for batch in batches:
            for part in C.slices(batch, "row_text"):
                t = folded(C.from_arrow(part.column(1)))
                w = C.words(t, markup=True)
                gram, at = C.ngrams(w, SEED)
                which, number = lookup(gram, seeds, screen)
                if not len(which):
                    continue
                at, bounds = at[which], np.searchsorted(w.row, np.arange(part.num_rows + 1))
                row = w.row[at]
                row, low, high, joined = merged(row, np.maximum(at - (run - SEED), bounds[row]), np.minimum(at + run, bounds[row + 1]))
                pair = np.unique(joined * len(seeds) + number)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(pair // len(seeds), np.arange(len(row) + 1)).astype(np.int32)),
                    pa.array((pair % len(seeds)).astype(np.int32))
                )
                kept = C.to_arrow(C.spans(t, w.first[low], w.end[high - 1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), lists, kept], ["row_key", "seeds", "part"])

    return source.mapInArrow(cut, schema)


def smith_waterman(windows: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score and longest run of equal words of each window with its passage.

    All pairs advance together, one passage word at a time; gaps within a row come from a running maximum.
    """
    n, m = max(map(len, windows)), max(map(len, passages))
    a, b = np.zeros((len(windows), n), np.uint64), np.ones((len(windows), m), np.uint64)
    for i, (x, y) in enumerate(zip(windows, passages, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    b_live = np.arange(m) < np.array([len(y) for y in passages])[:, None]
    a_live = np.arange(n) < np.array([len(x) for x in windows])[:, None]
    score, run = np.zeros((len(windows), n), np.int32), np.zeros((len(windows), n), np.int32)
    best, longest = np.zeros(len(windows), np.int32), np.zeros(len(windows), np.int32)
    slope = -GAP * np.arange(n, dtype=np.int32)
    for j in range(m):
        same = (a == b[:, j : j + 1]) & a_live & b_live[:, j : j + 1]
        before = np.zeros_like(score)
        before[:, 1:] = score[:, :-1]
        step = np.maximum(before + np.where(same, MATCH, MISMATCH), score + GAP)
        np.maximum(step, 0, out=step)
        score = (np.maximum.accumulate(step + slope, axis=1) - slope).astype(np.int32)
        score[~b_live[:, j]] = 0
        before = np.zeros_like(run)
        before[:, 1:] = run[:, :-1]
        run = np.where(same, before + 1, 0)
        best, longest = np.maximum(best, score.max(axis=1)), np.maximum(longest, run.max(axis=1))
    return best, longest


def alignments(
    w: C.Words, rows: int, items: Items, seeds: np.ndarray, place: np.ndarray, screen: np.ndarray, reach: int | None, least_words: int
) -> tuple[np.ndarray, ...]:
    """row, item, score, longest of each row and item that one of the seeds joins.

    reach: words to both sides of a seed's first one that count; by default all that an alignment can need.
    least_words: parts of a row with fewer words of the item are left out.
    """
    gram, at = C.ngrams(w, SEED)
    which, number = lookup(gram, seeds, screen)
    times = (np.searchsorted(seeds, seeds, side="right") - np.searchsorted(seeds, seeds))[number]
    pos = np.repeat(at[which], times)
    one = place[np.repeat(number, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    item, row = items.item[one], w.row[pos]
    bounds = np.searchsorted(w.row, np.arange(rows + 1))
    size, within = np.diff(items.start)[item], items.at[one] - items.start[item]
    left, right = (REACH * within, REACH * (size - within)) if reach is None else (reach - SEED, reach)
    group, low, high, _ = merged(row * len(items.ids) + item, np.maximum(pos - left, bounds[row]), np.minimum(pos + right, bounds[row + 1]))
    row, item = group // len(items.ids), group % len(items.ids)
    if len(row) and least_words:
        enough = items.shared(w.hash, low, high, item) >= least_words
        row, item, low, high = row[enough], item[enough], low[enough], high[enough]
    score, longest = np.zeros(len(low), np.int32), np.zeros(len(low), np.int32)
    by_size = np.argsort(high - low, kind="stable")
    while len(by_size):
        cells = np.cumsum((high - low)[by_size])
        batch = by_size[: max(1, int(np.searchsorted(cells, CELLS // 4)))]
        by_size = by_size[len(batch) :]
        passages = [items.hash[items.start[item[k]] : items.start[item[k] + 1]] for k in batch]
        score[batch], longest[batch] = smith_waterman([w.hash[low[k] : high[k]] for k in batch], passages)
    return row, item, score, longest


def align(
    source: DataFrame, column: str, is_folded: bool, items: Items, seeds: np.ndarray, place: np.ndarray, reach: int | None, least_words: int
) -> DataFrame:
    """row_key, item, score, longest of each row of source(row_key, column) and item that one of the seeds joins."""
    schema = f"row_key {source.schema['row_key'].dataType.simpleString()}, item int, score int, longest int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = seed_filter(seeds)
        for batch in batches:
            for part in C.slices(batch, column):
                t = C.from_arrow(part.column(1))
                w = C.words(t if is_folded else folded(t), markup=True)
                row, item, score, longest = alignments(w, part.num_rows, items, seeds, place, screen, reach, least_words)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row)), pa.array(item.astype(np.int32)), pa.array(score), pa.array(longest)],
                        ["row_key", "item", "score", "longest"]
                    )

    return source.select("row_key", column).mapInArrow(run, schema)


def leaks(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    passage: str = "passage",
    block: int = BLOCK,
    run: int | None = None,
    least_words: int = 0
) -> DataFrame:
    """key, item_key, item_words, score, share, longest of each pair of document and item joined by a seed.

    share: the score against that of a whole copy. longest: equal consecutive words.
    run: if only pairs of so many equal consecutive words are needed (SEED at least); others may be left out, and
    score and longest are those of the words around the seeds.
    least_words: pairs with fewer equal words in their alignment may be left out, whose score is below MATCH for each of so many.
    """
    spark = documents.sparkSession
    queries = items.select(F.col(item_key).alias("q"), F.col(passage).alias("p")).where(F.col("q").isNotNull()).distinct()
    blocks = max(1, -(-queries.count() // block))
    out = None
    for k in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).orderBy("q", "p").collect()
        mine = Items([r["q"] for r in rows], [r["p"] for r in rows])
        if not len(mine.seeds):
            continue
        if run is None:
            texts = documents.select(F.col(key).alias("row_key"), F.make_valid_utf8(F.col(text)).alias("row_text"))
            found = align(texts, "row_text", False, mine, *mine.every(), None, least_words)
        else:
            held = materialize(around_seeds(documents, key, text, mine.seeds, run), "p8-held")
            counts = np.zeros(len(mine.seeds), np.int64)
            found = held.select(F.explode("seeds").alias("s")).groupBy("s").agg(F.count("*").alias("n")).toArrow()
            counts[found["s"].to_numpy()] = found["n"].to_numpy()
            found = align(held, "part", True, mine, *mine.chosen(counts, run), run, max(run, least_words))
        size = np.diff(mine.start)
        names = spark.createDataFrame(
            [(i, q, int(size[i])) for i, q in enumerate(mine.ids)],
            f"item int, {item_key} {items.schema[item_key].dataType.simpleString()}, item_words int"
        )
        found = found.join(F.broadcast(names), "item").drop("item")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame(
            [],
            f"{key} {documents.schema[key].dataType.simpleString()}, {item_key} {items.schema[item_key].dataType.simpleString()}, item_words int, score int, share double, longest int"
        )
    best = out.groupBy(F.col("row_key").alias(key), item_key).agg(
        F.max("item_words").alias("item_words"), F.max("score").alias("score"), F.max("longest").alias("longest")
    )
    return best.select(key, item_key, "item_words", "score", (F.col("score") / (MATCH * F.col("item_words"))).alias("share"), "longest")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least RUN consecutive words of an item's passage."""
    pairs = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), run=RUN)
    return pairs.where(F.col("longest") >= RUN).select("doc_id", "item_id")


def p8_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole and edited copies: pairs with five equal words in a row whose alignment has the score of at least ten equal words."""
    pairs = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), least_words=EQUAL)
    return pairs.where(F.col("score") >= EQUAL * MATCH).withColumn("share", F.round("share", 6))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with the number of documents it leaked into."""
    items = table(spark, sf_dir, "eval_items")
    hits = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.select("item_id", "suite").distinct().join(hits, "item_id", "left").fillna(0, ["n_documents"])
