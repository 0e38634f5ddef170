"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storing import stored as stored

#: Rows and bytes of one Arrow batch; rows hold whole texts or sets, so the defaults (10,000 and 64 MB) would be too much for a Python worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets smaller Arrow batches, unless the session has its own size."""
    for name, default, smaller in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, str(smaller))


#: Keys that are sent to all executors at most; beyond, both sides are shuffled.
BROADCAST_KEYS = 1_000_000


def having(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the keys (stored, distinct): by broadcast if they are few, else by a shuffled semi join."""
    few = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, key, "left_semi")


#: Names of the columns of ``identity``.
IDENTITY = ("_identity_1", "_identity_2")


def identity(df: DataFrame) -> list[Column]:
    """128 bits that tell rows apart by all their columns (rows equal in all of them agree)."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    columns += [c.isNull() for c in columns]  # a hash passes over nulls
    return [F.xxhash64(*([F.lit(k)] * k), *columns).alias(name) for k, name in enumerate(IDENTITY)]
