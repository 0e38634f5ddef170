"""Query blocks: alignment segments of a contig merged while reference and strand stay the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import half_open_0


def segment_blocks(segments: DataFrame, min_bp: int = 10_000, min_identity: float = 0.0, requested: DataFrame | None = None) -> DataFrame:
    """One block a segment that is long and similar enough; requested: (name) to keep only those contigs."""
    s = segments.filter(~(F.col("identity") < F.lit(float(min_identity)))).filter(F.col("len_query") >= min_bp)
    if requested is not None:
        s = s.join(requested.select(F.col("name").alias("query")).distinct(), "query", "left_semi")
    q0, q1 = half_open_0(F.col("query_start"), F.col("query_end"))
    r0, r1 = half_open_0(F.col("ref_start"), F.col("ref_end"))
    span = q1 - q0
    return s.select(F.col("query").alias("contig"), "ord", "ref", "orientation", q0.alias("query_start"), q1.alias("query_end"), r0.alias("ref_start"), r1.alias("ref_end"), span.alias("aligned_bp"), (F.col("identity") * span).alias("identity_bp"), F.lit(1).cast("bigint").alias("segment_count"))


def merge_blocks(blocks: DataFrame, max_gap: int = 1000) -> DataFrame:
    """Blocks numbered by place in their contig (block_no from 0).

    In order of place a block joins the one before it if reference and strand agree and it starts within max_gap
    of that one's end.  First runs of one signature, then breaks within a run; a run's largest end decides as
    well as a block's, for after a break all later starts lie beyond both."""
    by = Window.partitionBy("contig").orderBy("query_start", "query_end", "ref", "ord")
    changed = (F.lag("ref").over(by) != F.col("ref")) | (F.lag("orientation").over(by) != F.col("orientation"))
    runs = blocks.withColumn("run", F.sum(F.when(changed, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("contig", "run").orderBy("query_start", "query_end", "ref", "ord")
    before = F.max("query_end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    parts = runs.withColumn("part", F.sum(F.when(F.col("query_start") > before + max_gap, 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("query_start", "query_end", "ord", "identity_bp"))), lambda x: x["identity_bp"]), F.lit(0.0), lambda a, x: a + x)
    merged = parts.groupBy("contig", "run", "part").agg(
        F.first("ref").alias("ref"),
        F.first("orientation").alias("orientation"),
        F.min("query_start").alias("query_start"),
        F.max("query_end").alias("query_end"),
        F.min("ref_start").alias("ref_start"),
        F.max("ref_end").alias("ref_end"),
        F.sum("aligned_bp").alias("aligned_bp"),
        total.alias("identity_bp"),
        F.sum("segment_count").alias("segment_count"),
    )
    numbered = Window.partitionBy("contig").orderBy("run", "part")
    return merged.withColumn("block_no", (F.row_number().over(numbered) - 1).cast("int")).drop("run", "part")


def collect_blocks(segments: DataFrame, min_bp: int = 10_000, min_identity: float = 0.0, max_gap: int = 1000, requested: DataFrame | None = None) -> DataFrame:
    return merge_blocks(segment_blocks(segments, min_bp, min_identity, requested), max_gap)


def split_signals(blocks: DataFrame) -> DataFrame:
    """(contig, n_blocks, has_signal): whether a contig has several blocks that disagree on reference or strand."""
    signature = F.struct("ref", "orientation")
    return blocks.groupBy("contig").agg(F.count(F.lit(1)).alias("n_blocks"), (F.min(signature) != F.max(signature)).alias("has_signal"))
