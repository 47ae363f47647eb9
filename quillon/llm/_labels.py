"""Labelled ids for training, within a bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, label of at most so many labelled ids, those of least hash; small enough to be broadcast."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    return y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def held_out(doc_id: str, mod: int, value: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; never for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == value, F.lit(False))
