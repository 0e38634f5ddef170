"""Coords files as a stream: each micro-batch of new files becomes match metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import match_metrics
from ..sources.readers import at_least_identity, parse_coords


def stream_segments(spark: SparkSession, folder: str, min_identity: float = 0.0) -> DataFrame:
    """Segments of all coords files that appear in a folder, with their file."""
    lines = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    return at_least_identity(parse_coords(lines), min_identity)


def stream_metrics(segments: DataFrame, contigs: DataFrame, refs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that gives sink the match metrics of each batch; contigs and refs: (name, length)."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("ord", F.monotonically_increasing_id())
        sink(match_metrics(rows, contigs, refs), number)

    return segments.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
