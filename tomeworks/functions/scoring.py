"""Weights of terms and documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
HIGH_DF = 0.8


def cosine_idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def bm25_idf(df: Column, n: Column) -> Column:
    """0 where the term is in half of the documents or more, or counted more often than there are documents."""
    return F.when(n - df + 0.5 > 0, F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(0.0))).otherwise(0.0)


def bm25_part(tf: Column, doc_len: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avgdl))


def log_tf(tf: Column) -> Column:
    return 1 + F.log(tf)
