"""Query-biased snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomeworks.functions import scoring, text
from tomeworks.operators.index import Index
from tomeworks.operators.rank import Asked, terms_in_lexicon
from tomeworks.session import materialize

WINDOW = 250


def best_tokens(index: Index, q: Asked, results: DataFrame) -> DataFrame:
    """query_nr, gutenberg_id, token: of the query's tokens in the record the one of highest idf, the earliest in the query on a tie."""
    terms = terms_in_lexicon(index, q).select("query_nr", "term", "first_pos", scoring.cosine_idf(F.col("df"), F.lit(index.n)).alias("idf"))
    held = index.postings.join(q.sent(terms), "term").join(
        results.select("query_nr", "gutenberg_id").distinct(), ["query_nr", "gutenberg_id"], "left_semi"
    )
    best = W.partitionBy("query_nr", "gutenberg_id").orderBy(F.col("idf").desc(), "first_pos")
    return held.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("query_nr", "gutenberg_id", F.col("term").alias("token"))


def windows(texts: DataFrame, size: int = WINDOW) -> DataFrame:
    """Columns raw, folded and token of texts become snippet, start_line and absent: the text around the token's
    first place in the folded text, and its line; the first characters if it is absent."""
    keys = [c for c in texts.columns if c not in ("raw", "folded", "token")]
    n = F.length("raw")
    placed = texts.select(*keys, "raw", "token", (F.instr("folded", F.col("token")) - 1).alias("at"))
    first = F.greatest(F.lit(0), F.col("at") + F.floor(F.length("token") / 2) - size // 2)
    start = F.when(F.col("at") < 0, 0).when(n - first < size, F.greatest(F.lit(0), n - size)).otherwise(first)
    spans = placed.select(*keys, "raw", "at", start.cast("int").alias("start"))
    before = F.substring(F.col("raw"), F.lit(1), F.col("start"))
    line = F.when(F.col("at") < 0, 1).otherwise(1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))))
    return spans.select(
        *keys,
        text.squeeze(F.substring(F.col("raw"), F.col("start") + 1, F.lit(size))).alias("snippet"),
        line.cast("string").alias("start_line"),
        (F.col("at") < 0).alias("absent")
    )


def snippets(index: Index, docs: DataFrame, q: Asked, results: DataFrame, metadata: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """results with snippet and start_line, both empty where there is no text, no token or has_text is 0.

    Of a record's several texts the first that holds the token gives the snippet, else its first one,
    in the order of the given column. A text is folded once, however many queries ask for it.
    """
    tokens = best_tokens(index, q, results)
    if metadata is not None:
        absent = metadata.where("has_text = 0").select("gutenberg_id")
        tokens = tokens.join(absent, "gutenberg_id", "left_anti")
    # Written, so that its size is known and the texts need not be shuffled where it is small.
    asked = materialize(tokens.groupBy("gutenberg_id").agg(F.collect_list(F.struct("query_nr", "token")).alias("asked")), "snippets-asked")
    texts = docs.select("gutenberg_id", text.newlines(F.col("text")).alias("raw"), (F.col(order) if order else F.lit(0)).alias("_order"))
    texts = texts.join(asked, "gutenberg_id").withColumn("folded", text.fold(F.col("raw")))
    cut = windows(texts.select("gutenberg_id", "_order", "raw", "folded", F.inline("asked")))
    cut = cut.groupBy("query_nr", "gutenberg_id").agg(
        F.min_by(F.struct("snippet", "start_line"), F.struct("absent", "_order")).alias("s")
    ).select("query_nr", "gutenberg_id", "s.*")
    return results.join(cut, ["query_nr", "gutenberg_id"], "left").fillna("", ["snippet", "start_line"])
