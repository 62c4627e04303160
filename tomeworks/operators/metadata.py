"""The catalogue: merging of duplicate rows, text flags, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeworks.functions.text import plain_number

WHITE = r"[\s\x1c-\x1f]"
FIELDS = ("title", "authors", "language", "bookshelf", "rights")


def merge(metadata: DataFrame) -> DataFrame:
    """One row per book number; of each field the distinct filled values, sorted, joined by a semicolon.

    Rows without a number are left out. Distinct values are gathered map-side first.
    """

    def values(c: str):
        stripped = F.regexp_replace(c, rf"(?U)^{WHITE}+|{WHITE}+$", "")
        return F.array_join(F.array_sort(F.collect_set(F.nullif(stripped, F.lit("")))), ";").alias(c)

    book = plain_number(F.col("gutenberg_id").cast("string"))
    rows = metadata.select(book.alias("gutenberg_id"), *FIELDS).where(F.col("gutenberg_id").isNotNull())
    return rows.groupBy("gutenberg_id").agg(*map(values, FIELDS))


def flag_text(merged: DataFrame, docs: DataFrame) -> DataFrame:
    """has_text: 1 if a document has the book's number."""
    have = docs.select("gutenberg_id").where(F.col("gutenberg_id").isNotNull()).distinct().withColumn("has_text", F.lit(1))
    return merged.join(have, "gutenberg_id", "left").fillna(0, ["has_text"])


def report(metadata: DataFrame, flagged: DataFrame) -> DataFrame:
    """raw_rows, unique_ids, with_text, missing_text in one row."""
    raw = metadata.agg(F.count("*").alias("raw_rows"))
    books = flagged.agg(F.count("*").alias("unique_ids"), F.coalesce(F.sum("has_text"), F.lit(0)).alias("with_text"))
    return raw.join(F.broadcast(books), F.lit(True)).withColumn("missing_text", F.col("unique_ids") - F.col("with_text"))


def missing(flagged: DataFrame) -> DataFrame:
    return flagged.where("has_text = 0").select("gutenberg_id")
