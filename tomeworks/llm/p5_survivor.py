"""Problem 5: the best representative of each duplicate group.

Rows alike in all columns but the row id are one (the smallest id). The rest are ranked within
their group by completeness, trust and recency, ties broken by the smallest id. The ranking is a
window with a limit of one row, which Spark applies before the shuffle as well as after, so a
group that holds a third of all rows moves only one row of each input partition.

Defined results: a group key without a digit is no group and its rows are left out; a null or
unknown feed has the lowest trust; a null updated_at is earliest; extra columns take part only in
telling rows apart; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomeworks.functions.text import plain_number
from tomeworks.session import blank, materialize, table

# What stands for "not known".
STAND_INS = ("n/a", "unknown", "none", "null", "-", "?", "[not known]")
FIELDS = ("title", "authors", "rights")
USED = ("rec_id", *FIELDS, "feed", "updated_at")


def filled(col: Column) -> Column:
    """The cell holds a whole value: not null, blank, a stand-in, or broken off."""
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")))
    return ~blank(col) & ~t.isin(*STAND_INS) & ~t.rlike(r"(\.\.\.|…|\[cut\])$")


def distinct_rows(metadata: DataFrame) -> DataFrame:
    """Rows alike in all columns but rec_id, once, with the smallest rec_id and the plain book number."""
    others = [c for c in metadata.columns if c != "rec_id"]
    once = metadata.groupBy(*others).agg(F.min("rec_id").alias("rec_id"))
    return once.select(plain_number(F.col("gutenberg_id")).alias("_book"), *USED).where(F.col("_book").isNotNull())


def ranked(rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """One surviving row per book, of distinct_rows."""
    trust = feeds.groupBy(F.col("feed").alias("_feed")).agg(F.max("trust").alias("_trust"))
    rows = rows.join(trust, rows["feed"] == trust["_feed"], "left").drop("_feed")
    score = F.lit(0)
    for c in FIELDS:
        rows = rows.withColumn(f"_has_{c}", filled(F.col(c)))
        score = score + F.col(f"_has_{c}").cast("int")
    return rows.withColumn("_score", score).withColumn("_trust", F.coalesce("_trust", F.lit(-(2**31))))


def survivors(scored: DataFrame) -> DataFrame:
    order = [F.col("_score").desc(), F.col("_trust").desc(), F.col("updated_at").desc_nulls_last(), F.col("rec_id").asc_nulls_last()]
    return scored.withColumn("_rank", F.row_number().over(W.partitionBy("_book").orderBy(*order))).where("_rank = 1").drop("_rank")


def group_facts(scored: DataFrame) -> DataFrame:
    """What the best row is held against: group size, fields filled at all, latest update and its count, highest trust."""
    latest = F.coalesce(F.col("updated_at").cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    by_time = scored.groupBy("_book", latest.alias("_at")).agg(
        F.count("*").alias("_n"), F.max("_trust").alias("_t"), *(F.max(f"_has_{c}").alias(f"_any_{c}") for c in FIELDS)
    )
    last = F.max(F.struct("_at", "_n"))
    return by_time.groupBy("_book").agg(
        F.sum("_n").alias("_rows"), last["_at"].alias("_last"), last["_n"].alias("_last_n"), F.max("_t").alias("_top"), *(F.max(f"_any_{c}").alias(f"_any_{c}") for c in FIELDS)
    )


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving row per book."""
    scored = ranked(distinct_rows(table(spark, sf_dir, "metadata")), table(spark, sf_dir, "feeds"))
    return survivors(scored).select(F.col("_book").alias("gutenberg_id"), "rec_id", "title", "authors", "rights", "feed", "updated_at")


def p5_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One built record per book: each field from the most trusted, then latest row that fills it."""
    scored = ranked(distinct_rows(table(spark, sf_dir, "metadata")), table(spark, sf_dir, "feeds"))
    at = F.coalesce(F.col("updated_at"), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    best = [F.max_by(F.when(F.col(f"_has_{c}"), F.col(c)), F.struct(F.col(f"_has_{c}"), "_trust", at, -F.col("rec_id"))).alias(c) for c in FIELDS]
    return scored.groupBy(F.col("_book").alias("gutenberg_id")).agg(*best, F.count("*").alias("n_rows"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors that are best in every respect, of books with two or more different rows."""
    # Written, as the survivors and the facts they are held against both come from it.
    scored = materialize(ranked(distinct_rows(table(spark, sf_dir, "metadata")), table(spark, sf_dir, "feeds")).drop("feed", *FIELDS), "p5-rows")
    best = survivors(scored).join(group_facts(scored), "_book")
    whole = F.lit(True)
    for c in FIELDS:
        whole = whole & (F.col(f"_has_{c}") | ~F.col(f"_any_{c}"))
    latest = F.coalesce(F.col("updated_at").cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    best = best.where((F.col("_rows") >= 2) & whole & (latest == F.col("_last")) & (F.col("_last_n") == 1) & (F.col("_trust") == F.col("_top")))
    return best.select(F.col("_book").alias("gutenberg_id"), "rec_id")


_ROWS = """
WITH u AS (SELECT min(rec_id) AS rec_id, gutenberg_id AS gid, title, authors, language, bookshelf, rights, has_text, feed, updated_at, loaded_at
           FROM metadata GROUP BY gutenberg_id, title, authors, language, bookshelf, rights, has_text, feed, updated_at, loaded_at),
f AS (SELECT u.*, CAST(CAST(regexp_extract(gid, '\\d+') AS BIGINT) AS VARCHAR) AS book, coalesce(t.trust, -2147483648) AS trust,
   {filled} FROM u LEFT JOIN feeds t ON u.feed = t.feed WHERE regexp_matches(gid, '\\d')),
r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY (ht::INT + ha::INT + hr::INT) DESC, trust DESC, updated_at DESC NULLS LAST,
  rec_id) AS rk FROM f)
""".replace(
    "{filled}",
    ", ".join(
        f"(trim(coalesce({c}, ''), chr(32)||chr(9)||chr(10)||chr(13)||chr(160)) <> '' AND lower(trim({c})) NOT IN ('n/a','unknown','none','null','-','?','[not known]') AND NOT regexp_matches(lower(trim({c})), '(\\.\\.\\.|…|\\[cut\\])$')) AS {a}"
        for c, a in (("title", "ht"), ("authors", "ha"), ("rights", "hr"))
    ),
)
SQL = {
    "p5_survivors": _ROWS + "SELECT book AS gutenberg_id, rec_id, title, authors, rights, feed, updated_at FROM r WHERE rk = 1",
    "p5_found": _ROWS
    + """SELECT a.book AS gutenberg_id, a.rec_id FROM f a WHERE (SELECT count(*) FROM f b WHERE b.book = a.book) >= 2
AND NOT EXISTS (SELECT 1 FROM f b WHERE b.book = a.book AND b.rec_id <> a.rec_id AND
 ((b.ht AND NOT a.ht) OR (b.ha AND NOT a.ha) OR (b.hr AND NOT a.hr) OR b.trust > a.trust
  OR coalesce(b.updated_at, TIMESTAMP '0001-01-01') >= coalesce(a.updated_at, TIMESTAMP '0001-01-01')))""",
    "p5_golden": _ROWS
    + """SELECT book AS gutenberg_id, count(*) AS n_rows, """
    + ", ".join(
        f"(SELECT g.{c} FROM f g WHERE g.book = f.book AND g.{a} ORDER BY trust DESC, coalesce(updated_at, TIMESTAMP '0001-01-01') DESC, rec_id LIMIT 1) AS {c}"
        for c, a in (("title", "ht"), ("authors", "ha"), ("rights", "hr"))
    )
    + " FROM f GROUP BY book",
}
