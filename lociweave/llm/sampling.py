"""Labelled rows to learn from: a split by a checksum of the key, and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds (null for a null key)."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of at most ``most`` labelled rows outside the held-out fold, the first by a hash of the key.

    The bound on keys is what lets the labels be broadcast, the one on rows what lets them be collected where a key
    is repeated; rows without label or key don't count.  Other columns of docs don't matter."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).filter("_key is not null and label in (0, 1)")
    known = known.filter(remainder(F.col("_key"), folds) != held_out).groupBy("_key").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("_key"), "_key").limit(most)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), F.col("key") == F.col("_key")).drop("_key")
    return rows.orderBy(F.xxhash64("key"), "key", F.xxhash64("text")).limit(most)
