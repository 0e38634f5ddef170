"""Match metrics: one row for each contig and reference that share segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import half_open_1, ratio
from . import intervals


def unknown_query_count(segments: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row: how many segments name a contig that the assembly doesn't have."""
    return segments.join(contigs.select(F.col("name").alias("query")).distinct(), "query", "left_anti").agg(F.count(F.lit(1)).alias("skipped"))


def match_metrics(segments: DataFrame, contigs: DataFrame, refs: DataFrame) -> DataFrame:
    """Metrics by (query, ref) with first_ord (where the pair first came) and ref_intervals.

    contigs and refs: (name, length), a name once.  Sums of identities are exact decimals, so no result
    depends on the order of rows."""
    s = segments.join(contigs.select(F.col("name").alias("query"), F.col("length").alias("q_length")), "query")
    start, end = half_open_1(F.col("ref_start"), F.col("ref_end"))
    q_start, q_end = half_open_1(F.col("query_start"), F.col("query_end"))
    s = s.withColumn("r0", start).withColumn("r1", end).withColumn("q0", q_start).withColumn("q1", q_end)
    exact = F.sum(F.col("identity").try_cast("decimal(18,8)") * F.col("len_query").cast("decimal(18,0)")).cast("double")
    odd = F.bool_or(F.isnan("identity") | (F.abs("identity") > 1e9))
    keys = ["query", "ref"]
    sums = s.groupBy(*keys).agg(
        F.min("ord").alias("first_ord"),
        F.first("q_length").alias("query_length"),
        F.max(F.struct("ord", "ref_length"))["ref_length"].alias("coords_ref_length"),
        F.count(F.lit(1)).alias("segment_count"),
        F.sum("len_query").alias("raw_query_bp"),
        F.sum("len_ref").alias("raw_ref_bp"),
        F.when(odd, F.sum(F.col("identity") * F.col("len_query"))).otherwise(exact).alias("identity_bp"),
        F.sum((F.col("r0") + F.col("r1") - 1) * F.col("len_query")).alias("twice_midpoint"),
        F.sum(F.when(F.col("orientation") == "-", F.col("len_query")).otherwise(-F.col("len_query"))).alias("minus_excess"),
        F.min("r0").alias("ref_start"),
        (F.max("r1") - 1).alias("ref_end"),
    )
    sides = s.select(*keys, F.explode(F.array(F.struct(F.lit("r").alias("side"), F.col("r0").alias("start"), F.col("r1").alias("end")), F.struct(F.lit("q").alias("side"), F.col("q0").alias("start"), F.col("q1").alias("end")))).alias("i")).select(*keys, "i.*")
    merged = intervals.union(sides, [*keys, "side"])
    length = F.col("end") - F.col("start")
    covered = merged.groupBy(*keys).agg(
        F.sum(F.when(F.col("side") == "q", length).otherwise(0)).alias("merged_query_bp"),
        F.sum(F.when(F.col("side") == "r", length).otherwise(0)).alias("merged_ref_bp"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "r", F.struct("start", "end")))).alias("ref_intervals"),
    )
    m = sums.join(covered, keys).join(refs.select(F.col("name").alias("ref"), F.col("length").alias("known_ref_length")), "ref", "left")
    m = m.withColumn("ref_length", F.coalesce("known_ref_length", "coords_ref_length"))
    return m.select(
        "query",
        "ref",
        "first_ord",
        "query_length",
        "ref_length",
        "segment_count",
        "raw_query_bp",
        "raw_ref_bp",
        "merged_query_bp",
        ratio(F.col("merged_query_bp"), F.col("query_length")).alias("query_cov"),
        "merged_ref_bp",
        ratio(F.col("merged_ref_bp"), F.col("ref_length")).alias("ref_cov"),
        "ref_start",
        "ref_end",
        ratio(F.col("twice_midpoint") / 2, F.col("raw_query_bp")).alias("ref_midpoint"),
        F.when(F.col("minus_excess") > 0, F.lit("-")).otherwise(F.lit("+")).alias("orientation"),
        ratio(F.col("identity_bp"), F.col("raw_query_bp")).alias("avg_identity"),
        "ref_intervals",
    )
