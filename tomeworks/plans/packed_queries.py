"""Queries of the general data operators (packed fields, skewed keys) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tomeworks.operators import packed, skew
from tomeworks.session import table


PACKED_FIELDS = {"authors": "name", "bookshelf": "label", "language": "label"}


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of authors, bookshelf and language with its position."""
    return packed.split_packed(table(spark, sf_dir, "metadata"), "rec_id", "feed", PACKED_FIELDS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of cells that hold two or more."""
    return p2_values(spark, sf_dir).where("n_values >= 2").drop("n_values").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.wrong_df(p6_term_counts(spark, sf_dir))


def p6_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.term_counts(table(spark, sf_dir, "postings"), table(spark, sf_dir, "lexicon"))


_COUNTS = """
WITH p AS (SELECT DISTINCT term, docid, passage_no, tf, block_no FROM postings WHERE term IS NOT NULL AND docid IS NOT NULL AND tf >= 1),
n AS (SELECT term, block_no, count(DISTINCT docid) AS n_records, count(*) AS n_passages, CAST(sum(tf) AS BIGINT) AS total_tf FROM p
  GROUP BY term, block_no),
l AS (SELECT term, block_no, min(df) AS min_df, max(df) AS max_df, count(*) > count(df) AS null_df FROM lexicon GROUP BY term, block_no),
j AS (SELECT coalesce(n.term, l.term) AS term, coalesce(n.block_no, l.block_no) AS block_no, coalesce(n_records, 0) AS n_records,
      coalesce(n_passages, 0) AS n_passages, coalesce(total_tf, 0) AS total_tf, min_df, max_df, coalesce(null_df, false) AS null_df,
  null_df IS NOT NULL AS in_lexicon
      FROM n FULL JOIN l ON n.term IS NOT DISTINCT FROM l.term AND n.block_no IS NOT DISTINCT FROM l.block_no)
"""
QUERIES = {"p2_found": p2_found, "p2_values": p2_values, "p6_found": p6_found, "p6_term_counts": p6_term_counts}
SQL = {
    "p6_term_counts": _COUNTS + "SELECT * FROM j",
    "p6_found": _COUNTS + "SELECT term, block_no FROM j WHERE in_lexicon AND (null_df OR min_df <> n_records OR max_df <> n_records)",
}
