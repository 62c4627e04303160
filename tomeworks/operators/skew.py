"""Per-key work without imbalance: fragment-replicate by estimated load.

Loads are counted per key with a map-side-combined aggregate. Keys above a share of the mean task
load are split into proportionate shards by a spread column; all other keys are hashed to a fixed
number of buckets. Shards and buckets are bin-packed to tasks, largest first. What reaches the
driver is bounded whatever the data: the bucket sums and at most tasks / GRAIN split keys.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeworks.session import materialize, parallelism

BUCKETS = 1024
GRAIN = 0.25


@dataclass
class Fragments:
    """Where the rows of each key go."""

    keys: list[str]
    tasks: int
    heavy: DataFrame  # keys, _slots: the tasks of its shards; bounded by tasks / GRAIN rows
    light: DataFrame  # _b, _light: the task of each bucket of all other keys; bounded by buckets
    buckets: int
    loads: list[float]  # planned rows of each task

    def _with_slots(self, df: DataFrame) -> DataFrame:
        heavy = self.heavy.select(*(F.col(k).alias(f"_h_{k}") for k in self.keys), "_slots")
        cond = F.lit(True)
        for k in self.keys:
            cond = cond & df[k].eqNullSafe(heavy[f"_h_{k}"])
        df = df.join(F.broadcast(heavy), cond, "left").drop(*(f"_h_{k}" for k in self.keys))
        return df.withColumn("_b", bucket_of(self.keys, self.buckets)).join(F.broadcast(self.light), "_b", "left").drop("_b")

    @staticmethod
    def _placed(df: DataFrame) -> DataFrame:
        slot = F.when(F.col("_slots").isNull(), F.col("_light")).otherwise(F.element_at("_slots", F.col("_shard") + 1))
        return df.withColumn("_slot", slot).drop("_slots", "_light")

    def fragment(self, df: DataFrame, spread: list[str]) -> DataFrame:
        """df with _shard and _slot: rows of a split key are dealt to its shards by the spread columns."""
        shard = F.when(F.col("_slots").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.size("_slots"))).cast("int")
        return self._placed(self._with_slots(df).withColumn("_shard", shard))

    def replicate(self, df: DataFrame) -> DataFrame:
        """df with _shard and _slot: rows of a split key once for each of its shards, all others once."""
        shards = F.when(F.col("_slots").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("_slots") - 1))
        return self._placed(self._with_slots(df).withColumn("_shard", F.explode(shards)))


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def pack(weights: list[float], tasks: int) -> tuple[list[int], list[float]]:
    """Task of each weight, the largest placed first on the least loaded task; and the loads."""
    heap = [(0.0, t) for t in range(tasks)]
    place = [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        load, t = heapq.heappop(heap)
        place[i] = t
        heapq.heappush(heap, (load + weights[i], t))
    loads = [0.0] * tasks
    for w, t in zip(weights, place, strict=True):
        loads[t] += w
    return place, loads


def plan_fragments(loads: DataFrame, keys: list[str], load: str, tasks: int | None = None) -> Fragments:
    """Plan from a frame with one row per key and its load.

    Null keys are keys like any other. An empty frame plans everything to buckets.
    """
    spark = loads.sparkSession
    tasks = tasks or parallelism(spark)
    buckets = max(BUCKETS, 16 * tasks)
    sums = {r["_b"]: r["_l"] for r in loads.groupBy(bucket_of(keys, buckets).alias("_b")).agg(F.sum(load).alias("_l")).collect()}
    grain = max(1.0, GRAIN * sum(sums.values()) / tasks)
    split = loads.where(F.col(load) > grain).select(*keys, F.col(load).alias("_l"), bucket_of(keys, buckets).alias("_b")).collect()
    for r in split:
        sums[r["_b"]] -= r["_l"]
    shards = [-(-int(r["_l"]) // max(1, int(grain))) for r in split]
    weights = [sums.get(b, 0) for b in range(buckets)] + [r["_l"] / n for r, n in zip(split, shards, strict=True) for _ in range(n)]
    place, planned = pack(weights, tasks)
    rows, at = [], buckets
    for r, n in zip(split, shards, strict=True):
        rows.append((*(r[k] for k in keys), place[at : at + n]))
        at += n
    schema = T.StructType([T.StructField(k, loads.schema[k].dataType) for k in keys] + [T.StructField("_slots", T.ArrayType(T.IntegerType()))])
    light = spark.createDataFrame(list(enumerate(place[:buckets])), "_b int, _light int")
    return Fragments(keys, tasks, spark.createDataFrame(rows, schema), light, buckets, planned)


def to_tasks(df: DataFrame, tasks: int) -> DataFrame:
    """Rows moved to the task named in _slot.

    The slot is replaced by a number that hash partitioning sends to that very task, so later
    grouping by _slot needs no other exchange.
    """
    spark = df.sparkSession
    ids = spark.range(tasks * 64).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("t"))
    first = {r["t"]: r["v"] for r in ids.groupBy("t").agg(F.min("id").alias("v")).collect()}
    numbers = F.array(*(F.lit(first.get(t, t)).cast("long") for t in range(tasks)))
    return df.withColumn("_slot", F.element_at(numbers, F.col("_slot") + 1)).repartition(tasks, "_slot")


def shard_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], load: str, how: str = "inner") -> DataFrame:
    """Join of big with small (one row per key, its column load telling the key's rows in big) with large keys split."""
    plan = plan_fragments(small, keys, load)
    left, right = plan.fragment(big, spread).drop("_slot"), plan.replicate(small).drop("_slot")
    return left.join(right, [*keys, "_shard"], how).drop("_shard")


def live_postings(postings: DataFrame) -> DataFrame:
    """Rows with a term, a record and tf of at least 1."""
    cols = ("term", "docid", "passage_no", "tf", "block_no")
    return postings.select(*cols).where(F.col("term").isNotNull() & F.col("docid").isNotNull() & (F.col("tf") >= 1))


def term_counts(postings: DataFrame, lexicon: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per term and block: distinct records, passages and total tf of live rows, beside the lexicon's df.

    Rows alike in all columns count once. A term only in the lexicon has counts of 0; one without
    lexicon row has null df. A null df counts in null_df. A null term in the lexicon has no live rows.
    Empty tables give no rows.
    """
    keys = ["term", "block_no"]
    live = live_postings(postings)
    loads = materialize(live.groupBy(*keys).agg(F.count("*").alias("_n")), "p6-loads")
    plan = plan_fragments(loads, keys, "_n", tasks)
    rows = plan.fragment(live, ["docid"]).withColumns({"_lex": F.lit(False), "df": F.lit(None).cast("long")})
    terms = lexicon.select(
        "term", F.col("df").cast("long").alias("df"), F.col("block_no").cast(live.schema["block_no"].dataType).alias("block_no")
    ).distinct()
    terms = plan.replicate(terms).withColumns(
        {
            "_lex": F.lit(True),
            "docid": F.lit(None).cast(live.schema["docid"].dataType),
            "passage_no": F.lit(None).cast(live.schema["passage_no"].dataType),
            "tf": F.lit(None).cast(live.schema["tf"].dataType)
        }
    )
    one = to_tasks(rows.unionByName(terms), plan.tasks)
    shard = ["_slot", "_shard", *keys]
    in_record = one.groupBy(*shard, "_lex", "docid", "passage_no", "tf", "df").agg(F.lit(1).alias("_one")).groupBy(*shard, "_lex", "docid")
    in_record = in_record.agg(
        F.count("tf").alias("_p"),
        F.sum("tf").alias("_tf"),
        F.min("df").alias("_min"),
        F.max("df").alias("_max"),
        F.count(F.when(F.col("df").isNull(), 1)).alias("_null")
    )
    counted = in_record.groupBy(*shard).agg(
        F.count("docid").alias("_docs"), F.sum("_p").alias("_p"), F.sum("_tf").alias("_tf"), F.min("_min").alias("_min"), F.max("_max").alias("_max"),
        F.max(F.when(F.col("_lex"), F.col("_null"))).alias("_null"), F.max("_lex").alias("_lex"),
    )
    return counted.groupBy(*keys).agg(
        F.sum("_docs").alias("n_records"), F.sum("_p").alias("n_passages"), F.coalesce(F.sum("_tf"), F.lit(0)).cast("long").alias("total_tf"),
        F.min("_min").alias("min_df"), F.max("_max").alias("max_df"), (F.coalesce(F.max("_null"), F.lit(0)) > 0).alias("null_df"), F.max("_lex").alias("in_lexicon"),
    )


def wrong_df(counts: DataFrame) -> DataFrame:
    """Terms and blocks with a lexicon row whose df is not the number of live records."""
    off = (F.col("min_df") != F.col("n_records")) | (F.col("max_df") != F.col("n_records"))
    return counts.where(F.col("in_lexicon") & (F.col("null_df") | F.coalesce(off, F.lit(False)))).select("term", "block_no")
