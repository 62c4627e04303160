"""Problem 10: repetition inside a single document.

Texts become word hashes (see codepoints); rolling hashes of several n-gram lengths and of lines
show which runs of words were seen before in the same document. All occurrences but the first are
marked, and the marked words and characters are measured. One pass, no shuffle.

Defined results: a null or empty text, or one without words, has shares of 0; repeated rows come
out repeated; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks.llm import codepoints as C
from tomeworks.session import table

LENGTHS = (4, 6, 10)


def repeated_words(w: C.Words, n: int) -> np.ndarray:
    """Which words lie in a run of n words seen before in the same row."""
    covered = np.zeros(len(w.hash) + 1, np.int32)
    gram, at = C.ngrams(w, n)
    if len(gram):
        key = gram ^ C.mix(w.row[at].astype(np.uint64) + np.uint64(1))
        again = at[pd.Series(key).duplicated().to_numpy()]
        covered[again] += 1
        covered[again + n] -= 1
    return np.cumsum(covered[:-1]) > 0


def repeated_lines(w: C.Words, t: C.Texts) -> np.ndarray:
    """Which words lie in a line of the same words as an earlier line of the row."""
    if not len(w.hash):
        return np.zeros(0, bool)
    line = np.searchsorted(np.flatnonzero((t.cp == 10) | (t.cp == 13)), w.first)
    fresh = np.ones(len(line), bool)
    fresh[1:] = (line[1:] != line[:-1]) | (w.row[1:] != w.row[:-1])
    first = np.flatnonzero(fresh)
    number = np.cumsum(fresh) - 1
    place = np.arange(len(line)) - first[number]
    power = np.cumprod(np.full(int(place.max()) + 1, C.ODD1 | np.uint64(1), np.uint64))
    whole = C.mix(np.add.reduceat(w.hash * power[place], first)) ^ C.mix(w.row[first].astype(np.uint64) + np.uint64(1))
    return pd.Series(whole).duplicated().to_numpy()[number]


def repetition(documents: DataFrame, key: str, text: str, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Per row: n_words, and for each n the share of words (rep_words_n) and of characters (rep_chars_n) in
    runs of n words seen before; the same for lines (rep_lines, by characters)."""
    names = [f"rep_words_{n}" for n in lengths] + [f"rep_chars_{n}" for n in lengths] + ["rep_lines"]
    source = documents.select(F.col(key).alias("row_key"), F.make_valid_utf8(F.col(text)).alias("row_text"))
    schema = f"row_key {documents.schema[key].dataType.simpleString()}, n_words long, " + ", ".join(f"{n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "row_text"):
                t = C.fold_table().apply(C.from_arrow(part.column(1)))
                w, rows = C.words(t), part.num_rows
                n_words, chars = np.bincount(w.row, minlength=rows), np.bincount(w.row, w.chars, minlength=rows)
                marks = [repeated_words(w, n) for n in lengths]
                by_word = [np.bincount(w.row[m], minlength=rows) / np.maximum(n_words, 1) for m in marks]
                by_char = [np.bincount(w.row[m], w.chars[m], minlength=rows) / np.maximum(chars, 1) for m in [*marks, repeated_lines(w, t)]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words.astype(np.int64)), *map(pa.array, by_word + by_char)], ["row_key", "n_words", *names]
                )

    return source.mapInArrow(run, schema).withColumnRenamed("row_key", key)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which three tenths of the words lie in runs of 6 words seen before."""
    shares = repetition(table(spark, sf_dir, "documents"), "doc_id", "text", (6,))
    return shares.where((F.col("n_words") > 0) & (F.col("rep_words_6") >= 0.3)).select("doc_id").distinct()


def p10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = repetition(table(spark, sf_dir, "documents"), "doc_id", "text")
    return shares.select("doc_id", "n_words", *(F.round(c, 9).alias(c) for c in shares.columns[2:]))
