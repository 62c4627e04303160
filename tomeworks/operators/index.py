"""The inverted index: postings, lexicon, document statistics, globals.

Postings carry the record's length, so BM25 needs no join for it. A record (gutenberg_id) may have several
texts; their counts add up. Accent-free aliases are added as
rows of their own and are not merged with a posting of the same term, as df, scores and norms count both.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks.functions import scoring, text
from tomeworks.operators.skew import shard_join
from tomeworks.session import delete, materialize, spread


@dataclass
class Index:
    postings: DataFrame  # term, gutenberg_id, tf, doc_len
    lexicon: DataFrame  # term, df
    docstats: DataFrame  # gutenberg_id, doc_len, doc_norm
    n: int
    avgdl: float
    k1: float = scoring.K1
    b: float = scoring.B

    def globals(self) -> DataFrame:
        spark = self.docstats.sparkSession
        return spark.createDataFrame([(self.n, self.avgdl, self.k1, self.b)], "n long, avgdl double, k1 double, b double")


def counted(docs: DataFrame) -> DataFrame:
    """gutenberg_id, term, tf, text_len of each text of docs(gutenberg_id, text), and a row with a null term for each text.

    A text is in one row, so its terms are counted where it is read and no shuffle is needed.
    """
    source = spread(docs.select("gutenberg_id", "text"), "gutenberg_id")
    source = source.select("gutenberg_id", text.strip_boilerplate(text.newlines(F.col("text"))).alias("content"))
    names = ["gutenberg_id", "term", "tf", "text_len"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in text.slices_of(batch.column(1)):
                rows, terms, tfs, sizes = [], [], [], []
                for i, content in enumerate(part.to_pylist(), at):
                    counts = Counter(text.python_tokens(content)) if content else Counter()
                    rows += [i] * (len(counts) + 1)
                    terms += [None, *counts]
                    tfs += [None, *counts.values()]
                    sizes += [counts.total()] * (len(counts) + 1)
                at += len(part)
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, "gutenberg_id string, term string, tf long, text_len long")


def tokenised(docs: DataFrame, key: str) -> DataFrame:
    """key, toks: the tokens of each text of docs(key, text), in order."""
    source = docs.select(F.col(key).alias("row_key"), text.strip_boilerplate(text.newlines(F.col("text"))).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), text.in_slices(batch.column(1), text.python_tokens, pa.list_(pa.string())).fill_null([])], ["row_key", "toks"]
            )

    return source.mapInArrow(run, f"row_key {docs.schema[key].dataType.simpleString()}, toks array<string>").withColumnRenamed("row_key", key)


def lengths_of(raw: DataFrame) -> DataFrame:
    """gutenberg_id, doc_len, n_texts of each record in counted rows."""
    return raw.where("term is null").groupBy("gutenberg_id").agg(F.sum("text_len").alias("doc_len"), F.count("*").alias("n_texts"))


def term_frequencies(raw: DataFrame) -> DataFrame:
    """gutenberg_id, term, tf of each record in counted rows."""
    return raw.where("term is not null").groupBy("term", "gutenberg_id").agg(F.sum("tf").cast("int").alias("tf"))


def alias_postings(tfs: DataFrame) -> DataFrame:
    """The accent-free spelling of each term that differs from it, with the term's tf."""
    marked = tfs.where(~text.is_ascii(F.col("term")))
    return marked.withColumn("_alias", text.strip_accents(F.col("term"))).where("_alias <> term").withColumn("term", F.col("_alias")).drop("_alias")


def lexicon_of(postings: DataFrame) -> DataFrame:
    """df is the number of posting rows."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def document_norms(postings: DataFrame, lexicon: DataFrame, n: int) -> DataFrame:
    """gutenberg_id, doc_norm over all its postings; terms are split by df in the join."""
    weight = scoring.log_tf(F.col("tf")) * scoring.cosine_idf(F.col("df"), F.lit(n))
    joined = shard_join(postings.select("term", "gutenberg_id", "tf").where("tf > 0"), lexicon, ["term"], ["gutenberg_id"], "df")
    return joined.groupBy("gutenberg_id").agg(F.sqrt(F.sum(weight * weight)).alias("doc_norm"))


def of_counts(raw: DataFrame, k1: float = scoring.K1, b: float = scoring.B) -> Index:
    """The index of counted rows, which should be written ones; postings are written sorted by term, so a lookup reads few row groups."""
    columns = ("term", "gutenberg_id", "tf", "doc_len")
    lengths = materialize(lengths_of(raw), "index-lengths")
    terms = raw.where("term is not null")
    # Only records of several texts need a join for their length.
    several = lengths.where("n_texts > 1").select("gutenberg_id", "doc_len")
    terms = terms.withColumn("doc_len", F.col("text_len")) if several.isEmpty() else terms.join(several, "gutenberg_id", "left").withColumn("doc_len", F.coalesce("doc_len", "text_len"))
    # Ranges of term and record keep a record's rows of a term together, so summing them needs no other
    # exchange, and a term of many records lies in many ranges.
    ranged = terms.repartitionByRange("term", "gutenberg_id").groupBy("term", "gutenberg_id")
    base = ranged.agg(F.sum("tf").cast("int").alias("tf"), F.max("doc_len").alias("doc_len")).select(*columns)
    base = materialize(base.sortWithinPartitions("term", "gutenberg_id"), "index-base")
    alias = alias_postings(base).repartitionByRange("term", "gutenberg_id").sortWithinPartitions("term", "gutenberg_id")
    postings = base.unionByName(materialize(alias.select(*columns), "index-alias"))
    lexicon = materialize(lexicon_of(postings), "index-lexicon")
    one = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl")).first()
    norms = document_norms(postings, lexicon, one["n"])
    docstats = lengths.drop("n_texts").join(norms, "gutenberg_id", "left").withColumn("doc_norm", F.coalesce("doc_norm", F.lit(0.0)))
    return Index(postings, lexicon, materialize(docstats, "index-docstats"), one["n"], one["avgdl"], k1, b)


def build(docs: DataFrame, k1: float = scoring.K1, b: float = scoring.B) -> Index:
    """Index docs(gutenberg_id, text)."""
    # The slow tokeniser runs once: what it gives is written before the sort samples it.
    return of_counts(materialize(counted(docs.where("gutenberg_id is not null")), "index-counted"), k1, b)


def save(index: Index, path: str) -> None:
    """Write the index. The globals mark it as whole: they are removed before anything else is replaced and written last."""
    delete(index.docstats.sparkSession, f"{path}/globals")
    for name in ("postings", "lexicon", "docstats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    index.globals().coalesce(1).write.mode("overwrite").parquet(f"{path}/globals")


def load(spark: SparkSession, path: str) -> Index:
    """Read a saved index; one without globals is not whole and is refused."""
    try:
        g = spark.read.parquet(f"{path}/globals").first()
    except Exception as e:
        raise ValueError(f"{path} holds no finished index") from e
    if g is None:
        raise ValueError(f"{path} holds no finished index")
    return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "lexicon", "docstats")), g["n"], g["avgdl"], g["k1"], g["b"])


def validate(index: Index) -> DataFrame:
    """failure, term or document, over all terms: df against rows, tf of at least 1, and lengths.

    Two rows for a term and document are not a failure: an alias may meet a term of that spelling.
    """
    p = index.postings
    counted = p.groupBy("term").agg(F.count("*").alias("n"), F.min("tf").alias("least"))
    joined = counted.join(index.lexicon, "term", "full")
    bad_df = joined.where(~F.col("n").eqNullSafe(F.col("df"))).select(F.lit("df").alias("failure"), F.col("term").alias("of"))
    bad_tf = counted.where("least < 1").select(F.lit("tf").alias("failure"), F.col("term").alias("of"))
    orphans = p.select("gutenberg_id").distinct().join(index.docstats, "gutenberg_id", "left_anti").select(
        F.lit("document").alias("failure"), F.col("gutenberg_id").alias("of")
    )
    return reduce(DataFrame.unionByName, (bad_df, bad_tf, orphans))


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """key, docid: the position of each distinct key in sorted order, from 0.

    Sorted by range; only the row count of each partition goes to the driver.
    """
    spark = df.sparkSession
    # Written once, so counts and numbers come from the same partitions.
    ordered = df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).sortWithinPartitions(key)
    placed = materialize(ordered.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "dense-ids")
    sizes = {r["_part"]: (r["n"], r["first"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("first")).collect()}
    offset, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, offset - sizes[part][1]))
        offset += sizes[part][0]
    shift = spark.createDataFrame(rows, "_part int, _shift long")
    return placed.join(F.broadcast(shift), "_part").select(key, (F.col("_row") + F.col("_shift")).alias("docid"))
