"""The engine's queries over the driver's tables, one for each operator.

Records are books, in one space of ids: a book's texts are the documents of its number, the catalogue
is metadata with its duplicate rows merged. Index, catalogue and ranked lists are built once a session
and state of the tables they are made of.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks import reports
from tomeworks.functions import codec, scoring, text
from tomeworks.operators import evalkit, index, metadata, phrase, rank, snippet
from tomeworks.operators.skew import live_postings
from tomeworks.session import materialize, scratch, table, version
from tomeworks.sources import readers, sinks

EVALUATED = {
    1: "the that his our",
    2: "dark cellar ledger",
    3: "Förster grüßte das Schloß",
    4: "a brief history of une lanterne",
    5: '"the mill pond"',
    6: '"antern"',
}
CATALOGUE = {
    1: "A Brief History",
    2: "Kekinost Historical Society",
    3: "Blaise",
    4: "public domain",
    5: "Poetry",
    6: "château devant",
    7: "Tivodover, Matilda Dunmore",
}
EMPTY = {1: "", 2: "   ", 3: "zzzz", 4: ":"}
MODELS = ("structured", "vsm", "bm25")
TOP = 100
_CACHE: dict[tuple, object] = {}


def cached(name: str, spark: SparkSession, sf_dir: str, make):
    """What make gives, kept for as long as the tables are not written anew."""
    key = (spark.sparkContext.applicationId, sf_dir, name, *(version(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "metadata")))
    if key not in _CACHE:
        _CACHE[key] = make()
    return _CACHE[key]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gutenberg_id, text, doc_id: the texts of each book."""
    return table(spark, sf_dir, "documents").select("gutenberg_id", "text", "doc_id").where("gutenberg_id is not null")


def corpus_index(spark: SparkSession, sf_dir: str) -> index.Index:
    return cached("index", spark, sf_dir, lambda: index.build(corpus(spark, sf_dir)))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cached("catalogue", spark, sf_dir, lambda: materialize(metadata_flagged(spark, sf_dir), "catalogue"))


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cached("searchable", spark, sf_dir, lambda: materialize(rank.searchable(catalogue(spark, sf_dir)), "searchable"))


def preprocess_tokens(spark, sf_dir):
    d = index.tokenised(texts(spark, sf_dir), "doc_id")
    return d.select("doc_id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


def query_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "metadata").select("rec_id", F.coalesce("title", F.lit("")).alias("raw"))
    return t.select("rec_id", F.array_join(F.array_sort(text.query_tokens(F.col("raw"))), " ").alias("tokens"))


def accent_alias(spark, sf_dir):
    terms = corpus_index(spark, sf_dir).lexicon
    return terms.withColumn("alias", text.strip_accents(F.col("term"))).where("alias <> term").select("term", "alias")


def boilerplate_strip(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", text.strip_boilerplate(text.newlines(F.col("text"))).alias("content"))


def phrase_normalize(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", text.phrase_form(text.newlines(F.col("text"))).alias("phrase"))


def metadata_normalize(spark, sf_dir):
    m = table(spark, sf_dir, "metadata")
    return m.select("rec_id", *(text.metadata_form(F.col(c)).alias(c) for c in ("title", "authors")))


def sorted_token_key(spark, sf_dir):
    m = table(spark, sf_dir, "metadata")
    return m.select("rec_id", text.sorted_key(F.coalesce("authors", F.lit(""))).alias("author_key"))


def term_freq(spark, sf_dir):
    return index.term_frequencies(index.counted(corpus(spark, sf_dir))).select("gutenberg_id", "term", "tf")


def alias_postings(spark, sf_dir):
    return index.alias_postings(term_freq(spark, sf_dir)).select("gutenberg_id", "term", "tf")


def lexicon_df(spark, sf_dir):
    return corpus_index(spark, sf_dir).lexicon


def doc_len(spark, sf_dir):
    return corpus_index(spark, sf_dir).docstats.select("gutenberg_id", "doc_len")


def corpus_globals(spark, sf_dir):
    return corpus_index(spark, sf_dir).globals().select("n", F.round("avgdl", 6).alias("avgdl"), "k1", "b")


def idf_both(spark, sf_dir):
    i = corpus_index(spark, sf_dir)
    n = F.lit(i.n)
    return i.lexicon.select(
        "term",
        "df",
        F.round(scoring.cosine_idf(F.col("df"), n), 6).alias("idf_cosine"),
        F.round(scoring.bm25_idf(F.col("df"), n), 6).alias("idf_bm25")
    )


def doc_norm(spark, sf_dir):
    return corpus_index(spark, sf_dir).docstats.select("gutenberg_id", F.round("doc_norm", 6).alias("doc_norm"))


def dense_docid(spark, sf_dir):
    return index.dense_ids(corpus(spark, sf_dir), "gutenberg_id")


def postings_gaps(spark, sf_dir):
    return codec.posting_gaps(live_postings(table(spark, sf_dir, "postings")).select("term", "docid").distinct())


def gap_roundtrip(spark, sf_dir):
    return codec.gap_sums(postings_gaps(spark, sf_dir))


def index_validate(spark, sf_dir):
    return index.validate(corpus_index(spark, sf_dir))


def queries_of(spark: SparkSession, wanted: dict[int, str]) -> rank.Asked:
    return rank.asked(rank.query_frame(spark, wanted))


def bm25_batch(spark, sf_dir, numbers=tuple(EVALUATED)):
    q = queries_of(spark, {n: EVALUATED[n] for n in numbers})
    return rank.rank(rank.bm25(corpus_index(spark, sf_dir), q), TOP)


def vsm_batch(spark, sf_dir, numbers=tuple(EVALUATED)):
    q = queries_of(spark, {n: EVALUATED[n] for n in numbers})
    return rank.rank(rank.cosine(corpus_index(spark, sf_dir), q), TOP)


def structured_batch(spark, sf_dir, numbers=tuple(CATALOGUE)):
    q = queries_of(spark, {n: CATALOGUE[n] for n in numbers})
    return rank.rank(rank.structured(searchable(spark, sf_dir), q), TOP)


def phrase_trigger(spark, sf_dir):
    return rank.triggered(corpus_index(spark, sf_dir), queries_of(spark, EVALUATED)).select("query_nr", "fallback")


def bm25_fallback(spark, sf_dir, numbers=tuple(EVALUATED)):
    q = queries_of(spark, {n: EVALUATED[n] for n in numbers})
    return rank.rank(phrase.bm25_with_fallback(corpus_index(spark, sf_dir), corpus(spark, sf_dir), q), TOP)


def make_lists(spark: SparkSession, sf_dir: str, i: index.Index) -> DataFrame:
    """query_nr, model, rank, gutenberg_id, score of all queries and models."""
    q = queries_of(spark, EVALUATED)
    parts = (rank.structured(searchable(spark, sf_dir), q), rank.cosine(i, q), phrase.bm25_with_fallback(i, corpus(spark, sf_dir), q))
    out = None
    for model, df in zip(MODELS, parts, strict=True):
        df = rank.rank(df, TOP).select("query_nr", F.lit(model).alias("model"), "rank", "gutenberg_id", "score")
        out = df if out is None else out.unionByName(df)
    return materialize(out, "ranked")


def ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cached("ranked", spark, sf_dir, lambda: make_lists(spark, sf_dir, corpus_index(spark, sf_dir)))


def results_topk(spark, sf_dir):
    return ranked_lists(spark, sf_dir).where("rank <= 10")


def best_token(spark, sf_dir):
    i = corpus_index(spark, sf_dir)
    return snippet.best_tokens(i, queries_of(spark, EVALUATED), ranked_lists(spark, sf_dir))


def snippets(spark, sf_dir):
    i = corpus_index(spark, sf_dir)
    lists = ranked_lists(spark, sf_dir).drop("score")
    return snippet.snippets(
        i, corpus(spark, sf_dir), queries_of(spark, EVALUATED), lists, catalogue(spark, sf_dir), "doc_id"
    ).select("query_nr", "model", "rank", "gutenberg_id", "snippet", "start_line")


def tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snippets(spark, sf_dir).join(ranked_lists(spark, sf_dir).select("query_nr", "model", "rank", "score"), ["query_nr", "model", "rank"])
    return sinks.list_lines(s).withColumnRenamed("rank", "line")


def tsv_rows(spark, sf_dir):
    return tsv_lines(spark, sf_dir)


def tsv_validate(spark, sf_dir):
    """The lists of all queries and models, with one injected fault of each kind; lists without rows are missing."""
    lines = tsv_lines(spark, sf_dir)
    broken = F.when((F.col("line") == 2) & (F.col("query_nr") == 2) & (F.col("model") == "bm25"), F.lit("two\tcolumns"))
    broken = broken.when((F.col("line") == 3) & (F.col("query_nr") == 2) & (F.col("model") == "vsm"), F.lit("x\t1\t0.5\t\t"))
    broken = broken.when((F.col("line") == 2) & (F.col("query_nr") == 4) & (F.col("model") == "bm25"), F.lit("2\t1\t99999.0\t\t"))
    broken = broken.when((F.col("line") == 3) & (F.col("query_nr") == 4) & (F.col("model") == "vsm"), F.lit("7\t1\tnone\t\t"))
    expected = spark.createDataFrame([(q, m) for q in EVALUATED for m in MODELS], "query_nr int, model string")
    return evalkit.validate_lists(lines.withColumn("value", F.coalesce(broken, "value")), expected)


def determinism_diff(spark, sf_dir):
    """All lists of two runs, each with an index of its own; no row is expected."""
    again = make_lists(spark, sf_dir, index.build(corpus(spark, sf_dir)))
    return evalkit.differences(ranked_lists(spark, sf_dir), again).select("query_nr", "model", "gutenberg_id", "score", "rank", "only_in")


def metadata_dedup(spark, sf_dir):
    return metadata.merge(table(spark, sf_dir, "metadata"))


def metadata_flagged(spark, sf_dir):
    return metadata.flag_text(metadata_dedup(spark, sf_dir), table(spark, sf_dir, "documents"))


def has_text_flag(spark, sf_dir):
    return metadata_flagged(spark, sf_dir).select("gutenberg_id", "has_text")


def missing_ids(spark, sf_dir):
    return metadata.missing(metadata_flagged(spark, sf_dir))


def dataset_report(spark, sf_dir):
    return metadata.report(table(spark, sf_dir, "metadata"), metadata_flagged(spark, sf_dir))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in labels of the first ten results: books of much text count as relevant, of a middling amount as partly."""
    size = table(spark, sf_dir, "documents").groupBy("gutenberg_id").agg(F.sum("n_chars").alias("n_chars"))
    label = F.when(F.col("n_chars") >= 6000, 1).when(F.col("n_chars") >= 3000, 2).otherwise(0)
    return results_topk(spark, sf_dir).join(size, "gutenberg_id", "left").select("query_nr", "model", "rank", "gutenberg_id", label.alias("label"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in names else c for c in df.columns))


def precision_at_k(spark, sf_dir):
    return rounded(evalkit.precision(judgments(spark, sf_dir)), "p_at_k", "p_at_k_partial")


def judge_precision(spark, sf_dir):
    return rounded(evalkit.judged_precision(judgments(spark, sf_dir)), "p", "p_partial")


def average_precision(spark, sf_dir):
    return rounded(evalkit.average_precision(judgments(spark, sf_dir)), "ap")


def ndcg(spark, sf_dir):
    return rounded(evalkit.ndcg(judgments(spark, sf_dir)), "ndcg")


def metrics_report(spark, sf_dir):
    return evalkit.metrics(judgments(spark, sf_dir))


def metrics_summary(spark, sf_dir):
    return evalkit.summary(metrics_report(spark, sf_dir))


def overlap_jaccard(spark, sf_dir):
    return evalkit.overlap(ranked_lists(spark, sf_dir), queries_of(spark, EVALUATED).queries)


def score_quantiles(spark, sf_dir):
    return evalkit.score_quantiles(ranked_lists(spark, sf_dir), queries_of(spark, EVALUATED).queries)


def build_report(spark, sf_dir):
    """The build report, written and read, of what does not depend on the clock or the store."""
    i = corpus_index(spark, sf_dir)
    size = corpus(spark, sf_dir).agg(F.sum(F.octet_length("text")).alias("b")).first()["b"]
    path = scratch(spark, "build-report")
    sinks.write_report(spark, path, {"N": i.n, "total_text_bytes_read": size, "final_vocab_size": i.lexicon.count(), "avgdl": i.avgdl})
    return sinks.performance_rows(readers.build_metrics(spark, path))


def latency_report(spark, sf_dir):
    """The query log, written and read, with stand-in times: a list's greatest score."""
    lists = ranked_lists(spark, sf_dir).groupBy("query_nr", "model").agg(F.count("*").alias("n"), F.max("score").alias("s")).collect()
    path = scratch(spark, "log")
    entries = [
        {
            "query": EVALUATED[r["query_nr"]], "model": r["model"], "topk": r["n"], "candidates_scored": r["n"],
            "elapsed_ms": r["s"] / 8, "phrase_fallback_used": '"' in EVALUATED[r["query_nr"]],
        }
        for r in lists
    ]
    sinks.append_log(spark, path, entries[:5])
    sinks.append_log(spark, path, entries[5:])
    return sinks.latency_rows(readers.query_log(spark, path))


def catalogue_csv(spark, sf_dir):
    """The catalogue written as CSV under the columns' outer names, with one column too many, and read again."""
    names = {b: a for a, b in readers.CATALOGUE_COLUMNS.items()}
    path = scratch(spark, "catalogue-csv")
    rows = table(spark, sf_dir, "metadata").select(F.col("feed").alias("other"), *(F.col(b).alias(a) for b, a in names.items()))
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.catalogue_csv(spark, path)


def index_reload(spark, sf_dir):
    """Statistics of the index after it was saved and loaded."""
    path = scratch(spark, "index-saved")
    index.save(corpus_index(spark, sf_dir), path)
    i = index.load(spark, path)
    one = i.globals().select("n", F.round("avgdl", 6).alias("avgdl"))
    return i.docstats.select("gutenberg_id", "doc_len", F.round("doc_norm", 6).alias("doc_norm")).join(F.broadcast(one), F.lit(True))


def byte_lists(spark, sf_dir):
    """Live postings by record, encoded to byte lists and decoded again."""
    live = live_postings(table(spark, sf_dir, "postings")).distinct().groupBy("term", "docid").agg(F.sum("tf").alias("tf"))
    return codec.decode_lists(codec.encode_lists(live))


def lists_reread(spark, sf_dir):
    """The files of all lists, read again: fields of their lines."""
    s = snippets(spark, sf_dir).join(ranked_lists(spark, sf_dir).select("query_nr", "model", "rank", "score"), ["query_nr", "model", "rank"])
    folder = scratch(spark, "lists")
    sinks.write_list_files(s, folder, [(n, m) for n in EVALUATED for m in MODELS])
    return readers.ranked_lists(readers.list_lines(spark, folder))


def judgments_reread(spark, sf_dir):
    """Stand-in labels appended in two parts and read again; a label that is none is left out."""
    rows = [(str(r["query_nr"]), *tuple(r)[1:]) for r in judgments(spark, sf_dir).collect()]
    path = scratch(spark, "judgments")
    sinks.append_judgments(spark, path, rows[:70])
    sinks.append_judgments(spark, path, [*rows[70:], ("1", "bm25", 99, "0", 7)])
    return readers.judgments_csv(spark, path)


def results_titles(spark, sf_dir):
    return readers.titles(results_topk(spark, sf_dir), catalogue(spark, sf_dir)).select("query_nr", "model", "rank", "gutenberg_id", "title", "authors")


def bm25_no_scan(spark, sf_dir):
    """The fallback without a full scan: a query without BM25 results is refused."""
    q = queries_of(spark, EVALUATED)
    return rank.rank(phrase.bm25_with_fallback(corpus_index(spark, sf_dir), corpus(spark, sf_dir), q, allow_full_scan=False), TOP)


def phrase_caps(spark, sf_dir):
    """The fallback with caps that these tables reach."""
    q = queries_of(spark, EVALUATED)
    return phrase.bm25_with_fallback(corpus_index(spark, sf_dir), corpus(spark, sf_dir), q, reranked=20, scanned=30)


def empty_queries(spark, sf_dir):
    """Queries without tokens, in all models; the catalogue is searched for their signs as they stand."""
    q = queries_of(spark, EMPTY)
    i = corpus_index(spark, sf_dir)
    parts = {"structured": rank.structured(searchable(spark, sf_dir), q), "vsm": rank.cosine(i, q), "bm25": rank.bm25(i, q)}
    out = None
    for model, df in parts.items():
        df = df.select("query_nr", F.lit(model).alias("model"), "gutenberg_id", "score")
        out = df if out is None else out.unionByName(df)
    return out


def report_metrics(spark, sf_dir):
    return reports.metrics_by_list(judgments(spark, sf_dir), queries_of(spark, EVALUATED).queries)


def report_overlap(spark, sf_dir):
    return reports.pair_overlap(ranked_lists(spark, sf_dir), queries_of(spark, EVALUATED).queries)


def report_scores(spark, sf_dir):
    ranked = ranked_lists(spark, sf_dir).withColumn("query_nr", F.col("query_nr").cast("string"))
    return reports.score_spread(ranked, queries_of(spark, EVALUATED).queries, MODELS)


QUERIES = {
    f.__name__: f
    for f in (
        preprocess_tokens, query_tokens, accent_alias, boilerplate_strip, phrase_normalize, metadata_normalize, sorted_token_key, term_freq, alias_postings, lexicon_df, doc_len, corpus_globals,
        idf_both, doc_norm, dense_docid, postings_gaps, gap_roundtrip, index_validate, bm25_batch, vsm_batch, structured_batch, phrase_trigger, bm25_fallback, best_token, snippets, results_topk,
        tsv_rows, tsv_validate, determinism_diff, metadata_dedup, has_text_flag, missing_ids, dataset_report, precision_at_k, judge_precision, average_precision, ndcg, metrics_report, metrics_summary,
        overlap_jaccard, score_quantiles, build_report, latency_report, report_metrics, report_overlap, report_scores,
        catalogue_csv, index_reload, byte_lists, lists_reread, judgments_reread, results_titles, bm25_no_scan, phrase_caps, empty_queries,
    )
} | {
    "bm25_single": partial(bm25_batch, numbers=(2,)),
    "bm25_stopword_empty": partial(bm25_batch, numbers=(1,)),
    "vsm_single": partial(vsm_batch, numbers=(4,)),
    "vsm_abort": partial(vsm_batch, numbers=(5,)),
    "structured_title": partial(structured_batch, numbers=(1,)),
    "structured_author": partial(structured_batch, numbers=(7,)),
    "structured_other_fallback": partial(structured_batch, numbers=(4,)),
    "phrase_rerank": partial(bm25_fallback, numbers=(5,)),
    "phrase_full_scan": partial(bm25_fallback, numbers=(6,)),
}
