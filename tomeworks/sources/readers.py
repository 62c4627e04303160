"""Sources: catalogue CSV, text files, ranked TSV lists, judgments, logs. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeworks.functions.text import newlines

# Column names and keys of the files.
CATALOGUE_COLUMNS = {
    "gutenberg_id": "gutenberg_id",
    "title": "title",
    "author": "authors",
    "language": "language",
    "gutenberg_bookshelf": "bookshelf",
    "rights": "rights"
}
LOG_DEFAULTS = {"query": "", "model": "", "elapsed_ms": 0.0, "topk": 0, "candidates_scored": 0, "phrase_fallback_used": False}
LOG_SCHEMA = "timestamp string, model string, query string, topk long, elapsed_ms double, postings_accessed long, candidates_scored long, phrase_fallback_used boolean"
BUILD_SCHEMA = "N long, total_text_bytes_read long, elapsed_seconds double, docs_per_second double, mb_per_second double, peak_tracemalloc_mb double, blocks_written long, final_vocab_size long, avgdl double, postings_bytes long, sqlite_bytes long"


def catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """The six known columns, found by the header's names and all read as strings; others are dropped, absent ones are null."""
    names = spark.read.option("header", True).csv(path).columns  # reads the first line only
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    return rows.select(*((F.col(a) if a in rows.columns else F.lit(None).cast("string")).alias(b) for a, b in CATALOGUE_COLUMNS.items()))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """gutenberg_id, text of every <id>.txt; bad bytes are replaced, line ends become line feeds."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("gutenberg_id"), newlines(F.col("content").cast("string")).alias("text"))


def file_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids that have a text file; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("gutenberg_id"))


def list_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """query_nr, model, line, value of TSV lists named <query>_<model>.tsv; any other name is a query of its own with the model unknown."""
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")
    )
    stem = F.regexp_replace("f", r"\.[^.]*$", "")
    named = stem.rlike(r"^\d+_.+$")
    query = F.when(named, F.regexp_extract(stem, r"^(\d+)_", 1)).otherwise(stem)
    model = F.when(named, F.regexp_extract(stem, r"^\d+_(.+)$", 1)).otherwise("unknown")
    lines = lines.select(query.alias("query_nr"), model.alias("model"), "b", "i", "value")
    order = W.partitionBy("query_nr", "model").orderBy("b", "i")
    return lines.withColumn("line", F.row_number().over(order)).select("query_nr", "model", "line", "value")


def ranked_lists(lines: DataFrame, k: int | None = None) -> DataFrame:
    """Rows of lists; the first k lines of each, of which lines with fewer than five fields are left out. No quoting is known."""
    c = F.split("value", "\t", -1)
    rows = lines.where(F.col("line") <= k) if k else lines
    return rows.where(F.size(c) >= 5).select(
        "query_nr",
        "model",
        c[0].try_cast("int").alias("rank"),
        c[1].alias("gutenberg_id"),
        c[2].try_cast("double").alias("score"),
        c[3].alias("snippet"),
        c[4].alias("start_line")
    )


def judgments_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns are taken by the header's names, in whatever order they stand; labels other than 0, 1, 2 are left out."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        "query_nr", "model", F.col("rank").cast("int").alias("rank"), "gutenberg_id", F.col("label").cast("int").alias("label")
    ).where(F.col("label").isin(0, 1, 2))


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """The query log with defaults for absent values; blank lines are skipped."""
    return spark.read.schema(LOG_SCHEMA).json(path).na.drop("all").fillna(LOG_DEFAULTS)


def build_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUILD_SCHEMA).json(path, multiLine=True)


def titles(results: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Results with title and authors, empty where the catalogue has none or there is no catalogue."""
    if metadata is None:
        return results.withColumns({"title": F.lit(""), "authors": F.lit("")})
    own = metadata.select("gutenberg_id", "title", "authors")
    return results.join(own, "gutenberg_id", "left").fillna("", ["title", "authors"])
