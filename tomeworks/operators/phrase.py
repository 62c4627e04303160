"""Phrase fallback of BM25: re-rank by substring, or scan all texts where BM25 found nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeworks.functions import text
from tomeworks.operators.index import Index
from tomeworks.operators.rank import Asked, bm25, rank, triggered
from tomeworks.session import materialize, spread

BONUS, RERANKED, SCANNED = 5.0, 5000, 200


def holding(docs: DataFrame, phrases: DataFrame, q: Asked) -> DataFrame:
    """query_nr, gutenberg_id of the records of which a raw text holds the phrase: each text is folded once for all phrases."""
    forms = spread(docs.select("gutenberg_id", "text"), "gutenberg_id").select(
        "gutenberg_id", text.phrase_form(text.newlines(F.col("text"))).alias("form")
    )
    return forms.join(q.sent(phrases), F.col("form").contains(F.col("phrase"))).select("query_nr", "gutenberg_id").distinct()


def bm25_with_fallback(
    index: Index, docs: DataFrame, q: Asked, allow_full_scan: bool = True, reranked: int = RERANKED, scanned: int = SCANNED
) -> DataFrame:
    """query_nr, gutenberg_id, score, fallback_used.

    Of a query that triggers the fallback and has a phrase, the first RERANKED results are kept, and
    those of which a raw text holds the phrase gain BONUS. If BM25 found nothing and a full scan is
    allowed, the first SCANNED records by id that hold the phrase have a score of BONUS. The texts are
    read once for both; without a scan only those of the results are.
    """
    results = materialize(bm25(index, q), "bm25")
    found = results.select("query_nr").distinct().withColumn("found", F.lit(True))
    state = triggered(index, q).withColumn("phrase", text.phrase_query(F.col("raw"))).join(found, "query_nr", "left")
    state = materialize(
        state.select(
            "query_nr", "phrase", F.coalesce("found", F.lit(False)).alias("found"), (F.col("fallback") & (F.col("phrase") != "")).alias("act")
        ),
        "phrases"
    )
    columns = ("query_nr", "gutenberg_id", "score", "fallback_used")
    calm = results.join(
        q.sent(state.where("found and not act").select("query_nr")), "query_nr", "left_semi"
    ).withColumn("fallback_used", F.lit(False))
    kinds = {r["found"] for r in state.where("act").select("found").distinct().collect()}
    if not kinds or (kinds == {False} and not allow_full_scan):
        return calm.select(*columns)
    top = rank(results.join(q.sent(state.where("found and act").select("query_nr")), "query_nr", "left_semi"), reranked).drop("rank")
    if allow_full_scan and False in kinds:
        hits = holding(docs, state.where("act").select("query_nr", "phrase"), q)
    else:
        # Written, so that its size is known and the texts need not be shuffled where it is small.
        wanted = materialize(top.select("gutenberg_id").distinct(), "phrase-wanted")
        hits = holding(docs.join(wanted, "gutenberg_id", "left_semi"), state.where("found and act").select("query_nr", "phrase"), q)
    hits = materialize(hits, "phrase-hits") if len(kinds) > 1 else hits
    out = calm
    if True in kinds:
        again = top.join(hits.withColumn("holds", F.lit(True)), ["query_nr", "gutenberg_id"], "left")
        out = out.unionByName(
            again.withColumn(
                "score", F.when(F.col("holds"), F.col("score") + BONUS).otherwise(F.col("score"))
            ).withColumn("fallback_used", F.lit(True)).select(*columns)
        )
    if allow_full_scan and False in kinds:
        new = hits.join(q.sent(state.where("act and not found").select("query_nr")), "query_nr", "left_semi").withColumn("score", F.lit(BONUS))
        out = out.unionByName(rank(new, scanned).withColumn("fallback_used", F.lit(True)).select(*columns))
    return out.select(*columns)
