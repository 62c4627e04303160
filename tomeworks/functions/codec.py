"""Variable-length integers and gap lists, for reading and writing the byte form of postings.

Stored postings are Parquet, which has its own encodings; these serve exchange with byte lists.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST = 5
PAIRS = T.ArrayType(T.StructType([T.StructField("docid", T.LongType()), T.StructField("tf", T.LongType())]))
SPREAD = 1 << 16  # record ids per window


def encode_number(n: int) -> bytes:
    """Seven bits a byte, the low ones first, the high bit set on all but the last."""
    if n < 0:
        raise ValueError("a number below 0 has no code")
    size = max(1, -(-n.bit_length() // 7))
    return bytes((n >> 7 * i & 127) | (128 if i < size - 1 else 0) for i in range(size))


def decode_number(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number that begins at a place, and the place after it."""
    for size in range(1, LONGEST + 1):
        if data[at + size - 1] < 128:
            return sum((b & 127) << 7 * i for i, b in enumerate(data[at : at + size])), at + size
    raise ValueError(f"a code is longer than {LONGEST} bytes")


def gaps(ids: list[int]) -> list[int]:
    return ids[:1] + [b - a for a, b in pairwise(ids)]


def ungaps(differences: list[int]) -> list[int]:
    return list(accumulate(differences))


def encode_postings(pairs: list[tuple[int, int]]) -> bytes:
    """Number of pairs, then the gap of each id and its count."""
    out = [encode_number(len(pairs))]
    for gap, (_, tf) in zip(gaps([d for d, _ in pairs]), pairs, strict=True):
        out += [encode_number(gap), encode_number(tf)]
    return b"".join(out)


def decode_postings(data: bytes) -> list[tuple[int, int]]:
    n, at = decode_number(data)
    flat = []
    for _ in range(2 * n):
        value, at = decode_number(data, at)
        flat.append(value)
    return list(zip(ungaps(flat[::2]), flat[1::2], strict=True))


@F.arrow_udf(T.BinaryType())
def _encoded(lists: pa.Array) -> pa.Array:
    return pa.array([encode_postings([(p["docid"], p["tf"]) for p in x]) for x in lists.to_pylist()], pa.binary())


@F.arrow_udf(PAIRS)
def _decoded(data: pa.Array) -> pa.Array:
    pairs = [[{"docid": d, "tf": n} for d, n in decode_postings(x)] for x in data.to_pylist()]
    return pa.array(pairs, pa.list_(pa.struct([("docid", pa.int64()), ("tf", pa.int64())])))


def encode_lists(postings: DataFrame, spread: int = SPREAD) -> DataFrame:
    """term, part, df, data: byte lists of each term, one for each range of record ids, so that no list is larger than a range."""
    pairs = F.array_sort(F.collect_list(F.struct("docid", F.col("tf").cast("long").alias("tf"))))
    parts = postings.groupBy("term", F.floor(F.col("docid") / spread).alias("part")).agg(pairs.alias("pairs"))
    return parts.select("term", "part", F.size("pairs").alias("df"), _encoded("pairs").alias("data"))


def decode_lists(lists: DataFrame) -> DataFrame:
    """term, docid, tf of byte lists."""
    return lists.select("term", _decoded("data").alias("pairs")).select("term", F.inline("pairs"))


def write_postings(path: str, lists: Iterable[tuple[str, list[tuple[int, int]]]]) -> list[tuple[str, int, int, int]]:
    """A file of byte lists one after the other; term, df, byte_offset, length of each."""
    out, at = [], 0
    with open(path, "wb") as f:
        for term, pairs in lists:
            data = encode_postings(sorted(pairs))
            f.write(data)
            out.append((term, len(pairs), at, len(data)))
            at += len(data)
    return out


class PostingsFile:
    """A file of byte lists, read by offset and length. It is opened at the first reading; lists once read are kept until it is closed."""

    def __init__(self, path: str):
        self.path = path
        self._file = None
        self._kept: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def read(self, offset: int, length: int) -> list[tuple[int, int]]:
        if (offset, length) not in self._kept:
            if self._file is None:
                self._file = open(self.path, "rb")
            self._file.seek(offset)
            data = self._file.read(length)
            if len(data) < length:
                raise OSError(f"{self.path} ends {length - len(data)} bytes before a list at {offset} does")
            self._kept[offset, length] = decode_postings(data)
        return self._kept[offset, length]

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
        self._file = None
        self._kept.clear()

    def __enter__(self) -> PostingsFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def posting_gaps(postings: DataFrame, spread: int = SPREAD) -> DataFrame:
    """term, docid, gap: the difference to the term's previous record, the first keeps its id.

    Windows run within ranges of ids, the ends of which are carried over from one row per range, so
    a term in a third of all records is not one task's work.
    """
    ranged = postings.select("term", "docid").withColumn("_r", F.floor(F.col("docid") / spread))
    ends = ranged.groupBy("term", "_r").agg(F.max("docid").alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(W.partitionBy("term").orderBy("_r"))).drop("_end")
    within = F.lag("docid").over(W.partitionBy("term", "_r").orderBy("docid"))
    out = ranged.withColumn("_lag", within).join(ends, ["term", "_r"])
    return out.select("term", "docid", (F.col("docid") - F.coalesce("_lag", "_before", F.lit(0))).alias("gap"))


def gap_sums(gapped: DataFrame, spread: int = SPREAD) -> DataFrame:
    """term, docid, restored: running sums of gaps, in ranges of ids as above."""
    ranged = gapped.withColumn("_r", F.floor(F.col("docid") / spread))
    sums = ranged.groupBy("term", "_r").agg(F.sum("gap").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy("term").orderBy("_r").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.withColumn("_before", before).drop("_sum")
    within = F.sum("gap").over(W.partitionBy("term", "_r").orderBy("docid").rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn("_own", within).join(sums, ["term", "_r"]).select(
        "term", "docid", (F.col("_own") + F.coalesce("_before", F.lit(0))).alias("restored")
    )
