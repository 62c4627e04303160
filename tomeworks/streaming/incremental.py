"""Postings from a stream of new texts.

The tokenising part of the index needs no state, so it runs on a stream as it does on a table; each
batch is appended under its number, and a batch that is tried again replaces what it wrote. Counts
over all documents (df, norms, mean length) change with every batch and are taken from the appended
rows when an index is finished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tomeworks.functions import scoring
from tomeworks.operators import index


def start(docs: DataFrame, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append the counted terms of streamed docs(gutenberg_id, text) below folder."""

    def each(batch: DataFrame, number: int) -> None:
        index.counted(batch.where("gutenberg_id is not null")).write.mode("overwrite").parquet(f"{folder}/counted/batch={number}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def finish(spark: SparkSession, folder: str, k1: float = scoring.K1, b: float = scoring.B) -> index.Index:
    """The index of all batches so far; texts of one record may have come in several."""
    return index.of_counts(spark.read.parquet(f"{folder}/counted").drop("batch"), k1, b)
