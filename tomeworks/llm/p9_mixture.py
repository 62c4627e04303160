"""Problem 9: mixing sources to target weights.

Sizes are tokens of a public tokenizer. The total is the largest at which every source that has
documents meets its share (of the shares that can be met at all) within its repeats. Each source
has a weight schedule over the course of training, a line whose mean is its share; the integrated
schedule is the source's cumulative demand, which is inverted at each document's token offset to
give its training position in [0, 1). The documents are range-sorted by position.

Offsets are prefix sums in hash order: sums per source and hash range first, then within a range,
so no source is one task's work.

Defined results: a source name counts without case and outer blanks; documents of no source, or of
one without target, are not mixed and stand in the report with a target of 0; null or empty texts
have no tokens and take a position of their own; a source without documents reaches a share of 0;
empty tables give no rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomeworks.llm.codepoints import slices
from tomeworks.session import materialize, table

RANGES = 16  # hash ranges of the documents, at least; as many as documents in one range, so that neither is one task's burden
TILT = 0.8
SMALL = 10_000  # sources up to which the plan is broadcast


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def clean_source(col):
    return F.nullif(F.lower(F.trim(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))), F.lit(""))


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str | None = None) -> DataFrame:
    """row_key, source, tokens of each document."""
    path = str(vocabulary or default_vocabulary())
    rows = documents.select(
        F.col(key).alias("row_key"), clean_source(F.col(source)).alias("source"), F.make_valid_utf8(F.col(text)).alias("row_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary  # one by one: the batch call takes half as long again
        for batch in batches:
            for part in slices(batch, "row_text"):
                sizes = [len(encode(x or "")) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64())], ["row_key", "source", "tokens"])

    return rows.mapInArrow(run, f"row_key {documents.schema[key].dataType.simpleString()}, source string, tokens long")


def plan(tokens: DataFrame, targets: DataFrame, total: float | None = None, tilt: float = TILT) -> DataFrame:
    """source, target_share, max_repeats, n_docs, available, share, demand, tilt of each source that can be mixed.

    share: the target among sources with tokens. tilt: a source that is repeated more comes later.
    """
    spark = tokens.sparkSession
    have = tokens.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("n_docs"))
    want = targets.select(
        clean_source(F.col("source")).alias("source"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")
    )
    want = want.where("source is not null").groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    both = want.join(have, "source").where("available > 0 and target_share > 0 and max_repeats > 0")
    one = both.agg(F.sum("target_share").alias("s"), F.min(F.col("max_repeats") * F.col("available") / F.col("target_share")).alias("m")).first()
    reach = one["s"] or 1.0
    size = min(float(total), one["m"] * reach) if total and one["m"] else (one["m"] or 0.0) * reach
    both = both.withColumn("share", F.col("target_share") / reach).withColumn("demand", F.col("share") * size)
    epochs = F.col("demand") / F.col("available")
    most = both.agg(F.max(epochs).alias("e"), F.sum(F.col("share") * epochs).alias("m")).first()
    return both.withColumn("tilt", F.lit(tilt) * (F.lit(most["m"] or 0.0) - epochs) / F.lit(most["e"] or 1.0))


def mixture(tokens: DataFrame, planned: DataFrame, seed: int = 1) -> DataFrame:
    """position, source, row_key, epoch, tokens, in order of position."""
    rows = planned.count()
    p = planned.select("source", "available", "max_repeats", "demand", "tilt")
    n_docs = tokens.count()
    ranges = max(RANGES, math.isqrt(n_docs))
    digits = F.substring(F.md5(F.concat_ws(":", F.col("row_key").cast("string"), F.lit(str(seed)))), 1, 15)
    at = tokens.withColumn("_h", F.conv(digits, 16, 10).cast("long"))
    at = at.withColumn("_range", F.least(F.floor(F.col("_h") / F.lit(2.0**60) * ranges), F.lit(ranges - 1)))
    sums = at.where("source is not null").groupBy("source", "_range").agg(F.sum("tokens").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("source", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("tokens").over(W.partitionBy("source", "_range").orderBy("_h", "row_key").rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")
    at = at.where("source is not null").withColumn("_within", within).join(sums, ["source", "_range"])
    at = at.select("row_key", "source", "tokens", (F.col("_before") + F.col("_within")).alias("_start"))
    at = at.join(F.broadcast(p) if rows <= SMALL else p, "source")
    last = F.least(F.ceil(F.col("demand") / F.col("available")), F.col("max_repeats").cast("long")) - 1
    at = at.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long")))))
    offset = F.col("_start") + F.col("epoch") * F.col("available")
    at = at.withColumn("_u", offset / F.col("demand")).where("_u < 1")
    steep = 1 + F.col("tilt")
    position = 2 * F.col("_u") / (steep + F.sqrt(F.greatest(steep * steep - 4 * F.col("tilt") * F.col("_u"), F.lit(0.0))))
    return at.select(
        position.alias("position"), "source", "row_key", F.col("epoch").cast("int").alias("epoch"), "tokens"
    ).orderBy("position", "source", "row_key", "epoch")


def shares(mixed: DataFrame, tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target and reached share, tokens and documents at hand and mixed, and repeats."""
    have = tokens.groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(
        F.sum("tokens").alias("available_tokens"), F.count("*").alias("n_docs")
    )
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("mixed_docs"), (F.max("epoch") + 1).alias("repeats"))
    want = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    want = want.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = want.join(have, "source", "full").join(got, "source", "left").fillna(
        0, ["max_repeats", "available_tokens", "n_docs", "mixed_tokens", "mixed_docs", "repeats"]
    ).fillna(0.0, ["target_share"])
    whole = got.agg(F.sum("mixed_tokens").alias("whole"))
    share = F.round(F.col("mixed_tokens") / F.nullif(F.coalesce("whole", F.lit(0)), F.lit(0)), 6)
    return out.join(F.broadcast(whole), F.lit(True)).select(
        "source",
        "target_share",
        "max_repeats",
        "n_docs",
        "available_tokens",
        "mixed_docs",
        "mixed_tokens",
        "repeats",
        F.coalesce(share, F.lit(0.0)).alias("share")
    )


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tokens = materialize(token_counts(table(spark, sf_dir, "documents")), "p9-tokens")
    targets = table(spark, sf_dir, "mix_targets")
    return tokens, targets, mixture(tokens, plan(tokens, targets))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in training order."""
    return _parts(spark, sf_dir)[2].withColumnRenamed("row_key", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached."""
    tokens, targets, mixed = _parts(spark, sf_dir)
    return shares(mixed, tokens, targets)


def _by_characters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("row_key"), clean_source(F.col("source")).alias("source"), F.coalesce("n_chars", F.lit(0)).alias("tokens")
    ), table(spark, sf_dir, "mix_targets")


def p9_mixture_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with sizes in characters, which SQL can count too."""
    sizes, targets = _by_characters(spark, sf_dir)
    mixed = mixture(sizes, plan(sizes, targets)).withColumn("position", F.round("position", 9))
    return mixed.withColumnsRenamed({"row_key": "doc_id", "tokens": "n_chars"})


def p9_shares_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _by_characters(spark, sf_dir)
    return shares(mixture(sizes, plan(sizes, targets)), sizes, targets)


def p9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("row_key", "doc_id")
