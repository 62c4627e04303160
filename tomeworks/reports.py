"""Reports over written lists and judgments, as tables with the column names of the analysis files.

Lists and judgments are short by nature (a list for each query and model).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks.operators import evalkit

MEASURES = {"p_at_k": "P@{k}", "p_at_k_partial": "P@{k}_partial", "ap": "AP@{k}", "ndcg": "NDCG@{k}"}


def four(col: str) -> Column:
    return F.format_string("%.4f", F.col(col))


def with_text(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """rows with the text of each query, empty where it is not known; in order of query and model."""
    texts = queries.select(F.col("query_nr").cast("string").alias("query_nr"), F.col("raw").alias("query_text"))
    return rows.withColumn("query_nr", F.col("query_nr").cast("string")).join(F.broadcast(texts), "query_nr", "left").fillna("", ["query_text"])


def metrics_by_list(judgments: DataFrame, queries: DataFrame, k: int = evalkit.K) -> DataFrame:
    """query_nr, query_text, model, P@k, P@k_partial, AP@k, NDCG@k, result_count."""
    rows = with_text(evalkit.metrics(judgments, k), queries)
    return rows.select(
        "query_nr", "query_text", "model", *(four(c).alias(n.format(k=k)) for c, n in MEASURES.items()), "result_count"
    ).orderBy(F.col("query_nr").try_cast("int"), "query_nr", "model")


def metrics_by_model(judgments: DataFrame, models: tuple[str, ...], k: int = evalkit.K) -> DataFrame:
    """model, the means of the measures, queries_judged, in the order of models."""
    rows = evalkit.summary(evalkit.metrics(judgments, k))
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    return rows.orderBy(place, "model").select(
        "model", *(four(f"mean_{c}").alias("mean_" + n.format(k=k)) for c, n in MEASURES.items()), "queries_judged"
    )


def comparison(ranked: DataFrame, queries: DataFrame, k: int = evalkit.K) -> DataFrame:
    """query_nr, query_text, model_1, model_2, both result counts, overlap and Jaccard of the first k."""
    rows = with_text(evalkit.overlap(ranked, queries.select(F.col("query_nr").cast("string").alias("query_nr")), k), queries)
    place = F.array_position(F.array(*(F.lit(f"{a} {b}") for a, b in evalkit.PAIRS)), F.concat_ws(" ", "model_1", "model_2"))
    rows = rows.orderBy(F.col("query_nr").cast("int"), place)
    return rows.select(
        "query_nr",
        "query_text",
        "model_1",
        "model_2",
        "result_count_1",
        "result_count_2",
        F.col("overlap").alias(f"overlap_top{k}"),
        four("jaccard").alias(f"jaccard_top{k}")
    )


def pair_overlap(ranked: DataFrame, queries: DataFrame, k: int = evalkit.K) -> DataFrame:
    """query_nr, pair, overlap and Jaccard of the first k."""
    return comparison(ranked, queries, k).select(
        "query_nr", F.concat_ws("_vs_", "model_1", "model_2").alias("pair"), f"overlap_top{k}", f"jaccard_top{k}"
    )


def first_ids(ranked: DataFrame, k: int = evalkit.K) -> dict[str, dict[str, dict[str, object]]]:
    """By query and model: the number of results and the first k ids."""
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "gutenberg_id")))), lambda x: x["gutenberg_id"])
    out: dict[str, dict[str, dict[str, object]]] = {}
    for r in ranked.groupBy("query_nr", "model").agg(F.count("*").alias("n"), ids.alias("ids")).orderBy("query_nr", "model").collect():
        out.setdefault(str(r["query_nr"]), {})[r["model"]] = {"result_count": r["n"], f"top{k}_ids": list(r["ids"])}
    return out


def score_spread(ranked: DataFrame, queries: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """query_nr, model, result_count and the quartiles of the scores; lists without rows are kept, with blanks."""
    stats = evalkit.score_quantiles(ranked, queries.select(F.col("query_nr").cast("string").alias("query_nr")), models)
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    numbers = ("min_score", "p25", "median", "p75", "max_score")
    return stats.orderBy(F.col("query_nr").cast("int"), place).select(
        "query_nr", "model", "result_count", *(F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c))).alias(c) for c in numbers)
    )
