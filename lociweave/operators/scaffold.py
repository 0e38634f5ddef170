"""Joining ordered contigs of a reference into scaffolds, with gaps of N."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import gap_run


def members(records: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assigned records, in FASTA order (ord), with their reference range."""
    a = assignments.select(F.col("new_name").alias("name"), "ref", "ref_start", "ref_end")
    return records.join(a, "name")


def unassigned(records: DataFrame, assignments: DataFrame) -> DataFrame:
    return records.join(assignments.select(F.col("new_name").alias("name")), "name", "left_anti")


def missing_names(records: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assigned names without record, in the report's order."""
    return assignments.select("ord", F.col("new_name").alias("name")).join(records.select("name"), "name", "left_anti").orderBy("ord")


def gaps(m: DataFrame, fixed: int | None = None) -> DataFrame:
    """Gaps between neighbours of a reference; an inferred gap is never below 0."""
    by = Window.partitionBy("ref").orderBy("ord")
    raw = F.col("ref_start") - F.col("left_ref_end") - 1
    g = m.select("ref", "ord", "ref_start", F.col("name").alias("right_contig"), F.lag("name").over(by).alias("left_contig"), F.lag("ref_end").over(by).alias("left_ref_end")).filter("left_contig is not null")
    gap = F.greatest(F.lit(0), raw) if fixed is None else F.lit(fixed)
    return g.select(F.col("ref").alias("scaffold"), "ord", "left_contig", "right_contig", "left_ref_end", F.col("ref_start").alias("right_ref_start"), raw.cast("bigint").alias("raw_inferred_gap_bp"), gap.cast("bigint").alias("gap_bp"), F.lit("inferred" if fixed is None else "fixed").alias("gap_mode"))


def offsets(m: DataFrame, fixed: int | None = None) -> DataFrame:
    """(ord, s_ord, offset, gap_bp): where each member (with its length) starts in its scaffold, and the gap before it; s_ord is the scaffold's first member's ord."""
    g = gaps(m, fixed).select(F.col("scaffold").alias("ref"), "ord", "gap_bp")
    rows = m.select("ref", "ord", "length").join(g, ["ref", "ord"], "left").withColumn("gap_bp", F.coalesce("gap_bp", F.lit(0).cast("bigint")))
    by = Window.partitionBy("ref").orderBy("ord")
    before = F.coalesce(F.sum(F.col("gap_bp") + F.col("length")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("ord", F.first("ord").over(by).alias("s_ord"), (before + F.col("gap_bp")).alias("offset"), "gap_bp")


def scaffolds(m: DataFrame, fixed: int | None = None, with_sequence: bool = True) -> DataFrame:
    """One row a reference: (scaffold, ord, contigs, sequence_bp, gap_bp, gaps, first and last positions, names[, seq]).

    With sequences (column seq of m) a scaffold's is one value; the command writes it from pieces instead."""
    g = gaps(m, fixed).select(F.col("scaffold").alias("ref"), "ord", "gap_bp")
    rows = m.join(g, ["ref", "ord"], "left")
    part = F.concat(gap_run(F.coalesce("gap_bp", F.lit(0))), "seq") if with_sequence else F.lit("")
    item = F.struct("ord", "name", "ref_start", "ref_end", part.alias("seq"))
    n = F.col("length") if "length" in m.columns else F.length("seq")
    s = rows.groupBy("ref").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("contigs"), F.sum(n).alias("sequence_bp"), F.coalesce(F.sum("gap_bp"), F.lit(0)).alias("gap_bp"), F.array_sort(F.collect_list(item)).alias("m"))
    names = F.array_join(F.transform("m", lambda x: x["name"]), ",")
    columns = [F.col("ref").alias("scaffold"), "ord", "contigs", (F.col("sequence_bp") + F.col("gap_bp")).alias("scaffold_bp"), "sequence_bp", "gap_bp", (F.col("contigs") - 1).alias("gaps"), F.element_at("m", 1)["ref_start"].alias("first_ref_start"), F.element_at("m", -1)["ref_end"].alias("last_ref_end"), names.alias("ordered_contigs")]
    return s.select(*columns, *([F.array_join(F.transform("m", lambda x: x["seq"]), "").alias("seq")] if with_sequence else []))
