"""Problem 1: how distinctive a term is per record.

Correspondence-analysis residuals: with n the count of a term in a record, r the record's length,
c the term's total and N the size of the index, expected = r * c / N and

    residual = (n - expected) / sqrt(expected * (1 - r / N) * (1 - c / N))

All plain DataFrame arithmetic. The join with the term margins splits terms by their load
(shard_join), so a term in a third of all records is not one task's work.

Defined results: rows with a null term or record or tf below 1 are not live; rows alike in all
columns count once; of repeated docstats rows the largest doc_len counts; a record without a
positive doc_len, or one that is the whole index, has a null residual; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks.operators.skew import live_postings, shard_join
from tomeworks.session import materialize, table


def term_scores(postings: DataFrame, docstats: DataFrame) -> DataFrame:
    """docid, term, n, doc_len, n_records, total, share, residual: one row per record and live term."""
    spark = postings.sparkSession
    live = live_postings(postings).repartition("term", "docid").distinct()
    cells = materialize(live.groupBy("term", "docid").agg(F.sum("tf").alias("n")), "p1-cells")
    terms = materialize(cells.groupBy("term").agg(F.count("*").alias("n_records"), F.sum("n").alias("total")), "p1-terms")
    docs = docstats.select("docid", "doc_len").where(F.col("docid").isNotNull()).groupBy("docid").agg(F.max("doc_len").alias("doc_len"))
    size = docs.agg(F.coalesce(F.sum("doc_len"), F.lit(0)).alias("s")).first()["s"]
    whole = F.lit(float(size) or None).cast("double")
    joined = shard_join(cells, terms, ["term"], ["docid"], "n_records").join(docs, "docid", "left")
    expected = F.col("doc_len") * F.col("total") / whole
    spread = expected * (1 - F.col("doc_len") / whole) * (1 - F.col("total") / whole)
    residual = F.when(spread > 0, (F.col("n") - expected) / F.sqrt(spread))
    share = F.when(F.col("doc_len") > 0, F.col("n") / F.col("doc_len"))
    return joined.select("docid", "term", "n", "doc_len", "n_records", "total", share.alias("share"), residual.alias("residual"))


def distinctive(scores: DataFrame, min_count: int = 5, min_share: float = 0.03, min_records: int = 2, max_records: int = 15) -> DataFrame:
    """Terms that occur more often than expected, often in the record and in few records."""
    return scores.where(
        (F.col("residual") > 0) & (F.col("n") >= min_count) & (F.col("share") >= min_share) & F.col("n_records").between(min_records, max_records)
    )


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's live terms with their residuals, rounded."""
    s = term_scores(table(spark, sf_dir, "postings"), table(spark, sf_dir, "docstats"))
    return s.select("docid", "term", F.col("n").cast("long").alias("n"), "n_records", F.round("residual", 4).alias("residual"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = term_scores(table(spark, sf_dir, "postings"), table(spark, sf_dir, "docstats"))
    return distinctive(s).select("docid", "term")


P1_SCORES_SQL = """
WITH live AS (SELECT DISTINCT term, docid, passage_no, tf, block_no FROM postings
              WHERE term IS NOT NULL AND docid IS NOT NULL AND tf >= 1),
cells AS (SELECT term, docid, sum(tf) AS n FROM live GROUP BY term, docid),
terms AS (SELECT term, count(*) AS n_records, sum(n) AS total FROM cells GROUP BY term),
docs AS (SELECT docid, max(doc_len) AS doc_len FROM docstats WHERE docid IS NOT NULL GROUP BY docid),
whole AS (SELECT CAST(sum(doc_len) AS DOUBLE) AS s FROM docs),
e AS (SELECT c.docid, c.term, CAST(c.n AS BIGINT) AS n, CAST(t.n_records AS BIGINT) AS n_records, d.doc_len,
             t.total, s, d.doc_len * CAST(t.total AS DOUBLE) / s AS ex
      FROM cells c JOIN terms t USING (term) LEFT JOIN docs d USING (docid) CROSS JOIN whole),
v AS (SELECT *, ex * (1 - doc_len / s) * (1 - CAST(total AS DOUBLE) / s) AS spread FROM e)
"""
SQL = {
    "p1_scores": P1_SCORES_SQL + "SELECT docid, term, n, n_records, round(CASE WHEN spread > 0 THEN (n - ex) / sqrt(spread) END, 4) AS residual FROM v",
    "p1_found": P1_SCORES_SQL + "SELECT docid, term FROM v WHERE spread > 0 AND n > ex AND n >= 5 AND CAST(n AS DOUBLE) / doc_len >= 0.03::DOUBLE AND n_records BETWEEN 2 AND 15",
}
