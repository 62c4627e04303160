"""Evaluation: precision, average precision, NDCG, overlap, quantiles, validation of ranked output.

Judgments have query_nr, model, rank, gutenberg_id, label (1 relevant, 2 partly, 0 not). Ranked
lists are short by nature (a list a query and model), so windows run per list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 10
PAIRS = (("structured", "vsm"), ("structured", "bm25"), ("vsm", "bm25"))
KEYS = ("query_nr", "model")


def _hits(partial: float) -> Column:
    return F.sum(F.when(F.col("label") == 1, 1.0).when(F.col("label") == 2, partial).otherwise(0.0))


def precision(judgments: DataFrame, k: int = K) -> DataFrame:
    """p_at_k and p_at_k_partial over k places, filled or not; 0 for a k of 0."""
    top = judgments.where(F.col("rank") <= k).groupBy(*KEYS)
    return top.agg(*((_hits(w) / k if k else F.lit(0.0)).alias(n) for w, n in ((0.0, "p_at_k"), (0.5, "p_at_k_partial"))))


def judged_precision(judgments: DataFrame) -> DataFrame:
    """Precision over the labels given."""
    return judgments.groupBy(*KEYS).agg((_hits(0.0) / F.count("*")).alias("p"), (_hits(0.5) / F.count("*")).alias("p_partial"))


def average_precision(judgments: DataFrame, k: int = K) -> DataFrame:
    """Mean precision at the relevant places of the first k, over those found."""
    order = W.partitionBy(*KEYS).orderBy("rank")
    relevant = F.when(F.col("label") == 1, 1).otherwise(0)
    top = judgments.where(F.col("rank") <= k).withColumns(
        {"i": F.row_number().over(order), "rel": F.sum(relevant).over(order.rowsBetween(W.unboundedPreceding, 0))}
    )
    return top.groupBy(*KEYS).agg(F.coalesce(F.avg(F.when(F.col("label") == 1, F.col("rel") / F.col("i"))), F.lit(0.0)).alias("ap"))


def ndcg(judgments: DataFrame, k: int = K) -> DataFrame:
    """Against the best order of the same k labels; gain 1 for relevant, 0.5 for partly."""
    gain = F.when(F.col("label") == 1, 1.0).when(F.col("label") == 2, 0.5).otherwise(0.0)
    top = judgments.where(F.col("rank") <= k).withColumn("gain", gain)
    top = top.withColumns(
        {
            "i": F.row_number().over(W.partitionBy(*KEYS).orderBy("rank")),
            "j": F.row_number().over(W.partitionBy(*KEYS).orderBy(F.col("gain").desc(), "rank"))
        }
    )
    sums = top.groupBy(*KEYS).agg(
        F.sum(F.col("gain") / F.log2(F.col("i") + 1)).alias("dcg"), F.sum(F.col("gain") / F.log2(F.col("j") + 1)).alias("ideal")
    )
    return sums.select(*KEYS, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def metrics(judgments: DataFrame, k: int = K) -> DataFrame:
    """All of them per query and model, to four places, with the number of results."""
    count = judgments.groupBy(*KEYS).agg(F.count("*").alias("result_count"))
    parts = [precision(judgments, k), average_precision(judgments, k), ndcg(judgments, k)]
    out = reduce(lambda a, b: a.join(b, [*KEYS]), parts, count)
    return out.select(*KEYS, *(F.round(c, 4).alias(c) for c in ("p_at_k", "p_at_k_partial", "ap", "ndcg")), "result_count")


def summary(per_query: DataFrame) -> DataFrame:
    """Means per model of the rounded values."""
    means = [F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("p_at_k", "p_at_k_partial", "ap", "ndcg")]
    return per_query.groupBy("model").agg(*means, F.count("*").alias("queries_judged"))


def overlap(ranked: DataFrame, queries: DataFrame, k: int = K, pairs: tuple[tuple[str, str], ...] = PAIRS) -> DataFrame:
    """For each query and pair of models: result counts, shared ids in the first k, Jaccard (0 if both are empty)."""
    grid = queries.select(
        "query_nr", F.explode(F.array(*(F.struct(F.lit(a).alias("model_1"), F.lit(b).alias("model_2")) for a, b in pairs))).alias("p")
    ).select("query_nr", "p.*")
    ids = ranked.groupBy(*KEYS).agg(F.collect_set(F.when(F.col("rank") <= k, F.col("gutenberg_id"))).alias("ids"), F.count("*").alias("n"))
    for i in (1, 2):
        one = ids.select("query_nr", F.col("model").alias(f"model_{i}"), F.col("ids").alias(f"ids_{i}"), F.col("n").alias(f"result_count_{i}"))
        grid = grid.join(one, ["query_nr", f"model_{i}"], "left")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("ids_1", none), F.coalesce("ids_2", none)
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return grid.select(
        "query_nr", "model_1", "model_2", F.coalesce("result_count_1", F.lit(0)).alias("result_count_1"), F.coalesce("result_count_2", F.lit(0)).alias("result_count_2"),
        both.alias("overlap"), F.when(either > 0, F.round(both / either, 4)).otherwise(0.0).alias("jaccard"),
    )


def score_quantiles(ranked: DataFrame, queries: DataFrame, models: tuple[str, ...] = ("structured", "vsm", "bm25")) -> DataFrame:
    """Least, quartiles and greatest score by linear interpolation, to eight places (a quartile of six-place scores has no more); lists without rows are kept, with nulls."""
    grid = queries.select("query_nr", F.explode(F.array(*map(F.lit, models))).alias("model"))
    q = F.percentile("score", [0.25, 0.5, 0.75])
    stats = ranked.groupBy(*KEYS).agg(
        F.count("*").alias("result_count"), F.min("score").alias("min_score"), q.alias("q"), F.max("score").alias("max_score")
    )
    out = grid.join(stats, [*KEYS], "left").fillna(0, ["result_count"])
    return out.select(
        *KEYS,
        "result_count",
        *(
            F.round(c, 8).alias(n) for c,
            n in (
                (F.col("min_score"), "min_score"),
                (F.col("q")[0], "p25"),
                (F.col("q")[1], "median"),
                (F.col("q")[2], "p75"),
                (F.col("max_score"), "max_score")
            )
        )
    )


def validate_lists(lines: DataFrame, expected: DataFrame | None = None, most: int = 100) -> DataFrame:
    """query_nr, model, line, failure of lists read as text (query_nr, model, line, value).

    Checks: the list exists, has at most so many rows of 5 fields, ranks count from 1, scores do not
    rise, and equal scores have ascending ids.
    """
    cols = F.split("value", "\t", -1)
    rows = lines.select(
        *KEYS,
        "line",
        F.size(cols).alias("n"),
        F.try_element_at(cols, F.lit(1)).alias("r"),
        F.try_element_at(cols, F.lit(2)).alias("id"),
        F.try_element_at(cols, F.lit(3)).alias("s")
    )
    rows = rows.withColumns({"rank": F.when(F.trim("r").rlike(r"^[+-]?\d+$"), F.trim("r").try_cast("long")), "score": F.col("s").try_cast("double")})
    whole = rows.where(F.col("n") == 5)
    order = W.partitionBy(*KEYS).orderBy("line")
    good = whole.where(F.col("rank").isNotNull() & F.col("score").isNotNull()).withColumns(
        {"before": F.lag("score").over(order), "id_before": F.lag("id").over(order)}
    )

    def failing(df: DataFrame, condition: Column, name: str) -> DataFrame:
        return df.where(condition).select(*KEYS, F.col("line").cast("long").alias("line"), F.lit(name).alias("failure"))

    found = [
        failing(rows, F.col("n") != 5, "columns"),
        failing(whole, F.col("rank").isNull(), "rank not a number"),
        failing(whole, F.col("rank") != F.col("line"), "rank not in sequence"),
        failing(whole, F.col("rank").isNotNull() & F.col("score").isNull(), "score not a number"),
        failing(good, F.col("score") > F.col("before"), "score rises"),
        failing(good, (F.col("score") == F.col("before")) & (F.col("id") < F.col("id_before")), "ids of a tie descend"),
        failing(lines.groupBy(*KEYS).agg(F.count("*").alias("line")), F.col("line") > most, "too many rows"),
    ]
    if expected is not None:
        absent = expected.select(*KEYS).join(lines.select(*KEYS).distinct(), [*KEYS], "left_anti").withColumn("line", F.lit(0))
        found.append(failing(absent, F.lit(True), "missing"))
    return reduce(DataFrame.unionByName, found)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one run that the other lacks, with repeats."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))
