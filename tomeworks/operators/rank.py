"""Ranking: BM25, cosine and structured search, for many queries in one job.

Up to FEW queries of at most TOKENS tokens are a small, checked set: their terms are cut in the driver
and broadcast. More are cut like texts and joined like any table. Results have query_nr,
gutenberg_id, score; rank() adds the place. Scores are rounded to six places before ordering; ties go
to the smaller id as a string. Null and empty queries give no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomeworks.functions import scoring, text
from tomeworks.operators.index import Index
from tomeworks.session import materialize, small_or_none

TRIGGER_TERMS, TRIGGER_SHARE = 4, 0.6
FEW, TOKENS = 1000, 50_000


def query_frame(spark: SparkSession, queries: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(sorted(queries.items()), "query_nr int, raw string")


@dataclass
class Asked:
    """Queries, their terms (query_nr, term, tf_q, first_pos), and whether both are few enough to be sent to all tasks."""

    queries: DataFrame
    terms: DataFrame
    few: bool

    def sent(self, df: DataFrame) -> DataFrame:
        """df, which has no more rows than there are terms or queries, broadcast if they are few."""
        return F.broadcast(df) if self.few else df


def asked(queries: DataFrame) -> Asked:
    """The terms of each query: its tokens and aliases."""
    rows = small_or_none(queries.select("query_nr", "raw"), FEW)
    cut = None if rows is None or sum(len(r["raw"] or "") for r in rows) > TOKENS else [
        (r["query_nr"], text.python_query_tokens(r["raw"] or "")) for r in rows
    ]
    if cut is None:
        toks = queries.select("query_nr", F.posexplode(text.query_tokens(F.col("raw"))).alias("pos", "term"))
        return Asked(
            queries,
            materialize(toks.groupBy("query_nr", "term").agg(F.count("*").alias("tf_q"), F.min("pos").alias("first_pos")), "query-terms"),
            False
        )
    terms = [(nr, t, n, toks.index(t)) for nr, toks in cut for t, n in Counter(toks).items()]
    kind = queries.schema["query_nr"].dataType.simpleString()
    return Asked(queries, queries.sparkSession.createDataFrame(terms, f"query_nr {kind}, term string, tf_q long, first_pos int"), True)


def terms_in_lexicon(index: Index, q: Asked) -> DataFrame:
    """The queries' terms with df; terms that are not in the lexicon are left out."""
    return index.lexicon.join(q.sent(q.terms), "term")


def triggered(index: Index, q: Asked) -> DataFrame:
    """query_nr, raw, fallback: a quote sign, or four terms and more of which over 0.6 are in over 0.8 of the documents."""
    high = index.lexicon.where(
        F.col("df") / F.lit(max(index.n, 1)) > scoring.HIGH_DF
    ).join(q.sent(q.terms), "term").groupBy("query_nr").agg(F.count("*").alias("n_high"))
    sizes = q.terms.groupBy("query_nr").agg(F.count("*").alias("n_terms"))
    out = q.queries.join(sizes, "query_nr", "left").join(high, "query_nr", "left").fillna(0, ["n_terms", "n_high"])
    many = (F.lit(index.n) > 0) & (F.col("n_terms") >= TRIGGER_TERMS) & (F.col("n_high") / F.greatest(F.col("n_terms"), F.lit(1)) > TRIGGER_SHARE)
    return out.select("query_nr", "raw", (F.col("raw").contains('"') | many).alias("fallback"))


def bm25(index: Index, q: Asked) -> DataFrame:
    n = F.lit(index.n)
    idf = scoring.bm25_idf(F.col("df"), n)
    terms = terms_in_lexicon(index, q).where((idf > 0) & (F.col("df") / n <= scoring.HIGH_DF)).select("query_nr", "term", idf.alias("idf"))
    part = F.col("idf") * scoring.bm25_part(F.col("tf"), F.col("doc_len"), F.lit(index.avgdl), index.k1, index.b)
    hits = index.postings.where("tf > 0").join(q.sent(terms), "term")
    return hits.groupBy("query_nr", "gutenberg_id").agg(F.round(F.sum(part), 6).alias("score"))


def cosine(index: Index, q: Asked) -> DataFrame:
    """Queries that trigger the fallback give no rows."""
    calm = triggered(index, q).where(~F.col("fallback")).select("query_nr")
    terms = terms_in_lexicon(index, q).join(q.sent(calm), "query_nr", "left_semi").withColumn("idf", scoring.cosine_idf(F.col("df"), F.lit(index.n)))
    terms = terms.select("query_nr", "term", "idf", (scoring.log_tf(F.col("tf_q")) * F.col("idf")).alias("w_q"))
    norms = terms.groupBy("query_nr").agg(F.sqrt(F.sum(F.col("w_q") * F.col("w_q"))).alias("norm_q")).where("norm_q > 0")
    hits = index.postings.where("tf > 0").join(q.sent(terms), "term")
    dots = hits.groupBy("query_nr", "gutenberg_id").agg(F.sum(F.col("w_q") * scoring.log_tf(F.col("tf")) * F.col("idf")).alias("dot"))
    scored = dots.join(q.sent(norms), "query_nr").join(index.docstats.where("doc_norm > 0"), "gutenberg_id")
    return scored.select("query_nr", "gutenberg_id", F.round(F.col("dot") / (F.col("norm_q") * F.col("doc_norm")), 6).alias("score"))


def searchable(metadata: DataFrame) -> DataFrame:
    """The merged catalogue with what structured search compares, folded once a row; written where it is searched often."""
    own = {c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "authors", "language", "bookshelf", "rights")}
    other = F.concat_ws(" ", own["language"], own["bookshelf"], own["rights"])

    def weighed(col: Column, weight: int, near: bool) -> Column:
        return F.transform(
            F.array_distinct(text.tokens(col)), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight"), F.lit(near).alias("near"))
        )

    weights = F.concat(weighed(own["title"], 2, True), weighed(own["authors"], 1, True), weighed(other, 1, False))
    return metadata.select(
        "gutenberg_id",
        F.coalesce("has_text", F.lit(0)).alias("has_text"),
        text.metadata_form(own["title"]).alias("title_form"),
        text.author_keys(own["authors"]).alias("author_keys"),
        weights.alias("terms")
    )


def structured(catalogue: DataFrame, q: Asked, include_missing_text: bool = False) -> DataFrame:
    """Weighted matches of title, authors and the other fields of a searchable catalogue.

    Tokens and whole authors meet by hash join; only the title's substrings need a nested loop over
    titles and queries. Candidates of a query are the rows that share a token with it in title or
    authors; a query with no candidate at all (or without tokens) takes all rows.
    """
    raw = q.queries.select(
        "query_nr", text.metadata_form(F.col("raw")).alias("q_form"), text.sorted_key(F.col("raw")).alias("q_key")
    ).where("q_form <> ''")
    # Written, as folding would be repeated in each of the joins.
    raw = q.queries.sparkSession.createDataFrame(raw.collect(), raw.schema) if q.few else materialize(raw, "query-forms")
    ids = ("query_nr", "gutenberg_id", "has_text")
    by_term = catalogue.select("gutenberg_id", "has_text", F.inline("terms")).join(
        q.sent(q.terms.select("query_nr", "term")), "term"
    ).select(*ids, "weight", "near")
    authors = catalogue.select(
        "gutenberg_id", "has_text", F.explode(F.array_distinct("author_keys")).alias("q_key")
    ).join(q.sent(raw.where("q_key <> ''").select("query_nr", "q_key")), "q_key")
    titles = catalogue.select("gutenberg_id", "has_text", "title_form").join(
        q.sent(raw.select("query_nr", "q_form")), F.col("title_form").contains(F.col("q_form"))
    )
    rows = by_term.unionByName(
        authors.select(*ids, F.lit(5).alias("weight"), F.lit(False).alias("near"))
    ).unionByName(titles.select(*ids, F.lit(10).alias("weight"), F.lit(False).alias("near")))
    scored = rows.groupBy(*ids).agg(F.sum("weight").cast("double").alias("score"), F.max("near").alias("candidate"))
    narrow = by_term.where("near").select("query_nr").distinct().withColumn("narrow", F.lit(True))
    scored = scored.join(q.sent(narrow), "query_nr", "left").where(F.col("candidate") | F.col("narrow").isNull())
    if not include_missing_text:
        scored = scored.where("has_text = 1")
    return scored.select("query_nr", "gutenberg_id", "score")


def rank(results: DataFrame, k: int | None = None, by: tuple[str, ...] = ("query_nr",)) -> DataFrame:
    """Results with rank from 1, of the best k of each group. The limit applies before the shuffle too."""
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("gutenberg_id").cast("string").asc())
    out = results.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k else out
