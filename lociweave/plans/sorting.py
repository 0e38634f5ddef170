"""The sort command: assign contigs to references, drop redundant ones, order and write them."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import make_parents, write_text
from ..functions.sequence import reverse_complement
from ..operators import assign, intervals, metrics
from ..operators.assign import SortOptions
from ..sinks import decimals, fasta_lines, or_dot, write_records, write_table
from ..sources import readers

# The columns of the reports.
ASSIGNMENT_COLUMNS = ["contig", "length", "status", "kept", "new_name", "assigned_ref", "order_in_ref", "ref_start", "ref_end", "ref_midpoint", "orientation", "reverse_complemented", "raw_aligned_bp", "merged_query_bp", "query_cov", "merged_ref_bp", "ref_cov", "avg_identity", "best_ref_share", "novel_ref_bp", "novel_ref_frac", "overlap_best_contig", "overlap_best_new_name", "overlap_best_bp", "second_ref", "second_merged_query_bp", "second_query_cov", "total_refs_matched"]
MATCH_COLUMNS = ["contig", "ref", "query_length", "ref_length", "segment_count", "raw_query_aligned_bp", "raw_ref_aligned_bp", "merged_query_bp", "query_cov", "merged_ref_bp", "ref_cov", "ref_start", "ref_end", "ref_midpoint", "orientation", "avg_identity"]
SUMMARY_COLUMNS = ["ref", "ref_length", "kept_contigs", "covered_ref_bp", "ref_cov", "first_ref_start", "last_ref_end", "ordered_new_names", "ordered_original_contigs"]
NOTE = "Bases under several alignment rows count once: coverage and order come from merged intervals. With the overlap filter a contig goes when stronger contigs of its reference already cover nearly all that it would add."


def assign_contigs(contigs: DataFrame, refs: DataFrame, m: DataFrame, o: SortOptions) -> DataFrame:
    """Placed assignments of all contigs from their match metrics."""
    return assign.place(assign.resolve_overlaps(assign.choose(contigs, m, o), o), refs, o)


def _assignment_line(r) -> list:
    b, s = r["best"], r["second"]
    yes = lambda x: "yes" if x else "no"
    if b is None:
        middle = [".", ".", ".", ".", ".", "."]
        numbers = [0, 0, "0.0000", 0, "0.0000", "0.000"]
    else:
        middle = [b["ref"], or_dot(r["order_in_ref"]), b["ref_start"], b["ref_end"], decimals(b["ref_midpoint"], 1), b["orientation"]]
        numbers = [b["raw_query_bp"], b["merged_query_bp"], decimals(b["query_cov"]), b["merged_ref_bp"], decimals(b["ref_cov"]), decimals(b["avg_identity"], 3)]
    second = [s["ref"], s["merged_query_bp"], decimals(s["query_cov"])] if s else [".", ".", "."]
    novelty = [decimals(r["best_ref_share"]), or_dot(r["novel_ref_bp"]), decimals(r["novel_ref_frac"]), r["overlap_best_contig"], or_dot(r["overlap_best_new_name"]), or_dot(r["overlap_best_bp"])]
    return [r["query"], r["record_length"], r["status"], yes(r["kept"]), r["new_name"], *middle, yes(r["reverse_complemented"]), *numbers, *novelty, *second, r["total_refs_matched"]]


def _match_line(r) -> list:
    return [r["query"], r["ref"], r["query_length"], r["ref_length"], r["segment_count"], r["raw_query_bp"], r["raw_ref_bp"], r["merged_query_bp"], decimals(r["query_cov"]), r["merged_ref_bp"], decimals(r["ref_cov"]), r["ref_start"], r["ref_end"], decimals(r["ref_midpoint"], 1), r["orientation"], decimals(r["avg_identity"], 3)]


def _summary_line(r) -> list:
    return [r["ref"], r["ref_length"], r["kept_contigs"], r["covered_ref_bp"], decimals(r["ref_cov"]), or_dot(r["first_ref_start"]), or_dot(r["last_ref_end"]), or_dot(r["ordered_new_names"]), or_dot(r["ordered_original_contigs"])]


def ordered_header(simple: bool):
    """The FASTA header of a kept assignment, made in Python as its decimals round like Python's."""

    def header(r) -> str:
        b = r["best"]
        if simple:
            return f">{r['new_name']}"
        turned = "yes" if r["reverse_complemented"] else "no"
        return f">{r['new_name']} original={r['query']} ref={b['ref']} ref_start={b['ref_start']} ref_end={b['ref_end']} orientation={b['orientation']} reverse_complemented={turned} query_cov={b['query_cov']:.4f} avg_identity={b['avg_identity']:.3f}"

    return F.udf(header, "string", useArrow=True)


def ordered_headers(kept: DataFrame, simple: bool) -> DataFrame:
    """kept (placed assignments) with its FASTA header."""
    match = F.struct(*[F.col("best")[k].alias(k) for k in ("ref", "ref_start", "ref_end", "orientation", "query_cov", "avg_identity")])
    return kept.withColumn("header", ordered_header(simple)(F.struct("new_name", "query", "reverse_complemented", match.alias("best"))))


def assignment_report(records: DataFrame, placed: DataFrame) -> DataFrame:
    """A row for each record (ord, name, length), with its assignment and the new name of the contig it overlaps most."""
    other = placed.select(F.col("query").alias("overlap_best_contig"), F.when(F.col("kept"), F.col("new_name")).alias("overlap_best_new_name"))
    narrow = placed.withColumn("best", _without_intervals("best")).withColumn("second", _without_intervals("second"))
    return records.select("name", F.col("ord").alias("record_ord"), F.col("length").alias("record_length")).join(narrow, F.col("name") == F.col("query")).join(other, "overlap_best_contig", "left")


def _without_intervals(match: str):
    """The match's printed fields; its intervals would be sent to Python for nothing."""
    return F.when(F.col(match).isNotNull(), F.struct(*[F.col(match)[k].alias(k) for k in assign.MATCH_FIELDS]))


def _run_summary(spark: SparkSession, path: str, args, o: SortOptions, outputs: dict, counts: dict) -> None:
    lines = ["lociweave sort", "", "Inputs", *(f"{k}\t{getattr(args, k)}" for k in ("ref_fasta", "assembly_fasta", "coords")), "", "Thresholds"]
    lines += [f"{k}\t{getattr(o, k)}" for k in ("min_aligned_bp", "min_query_cov", "min_best_ref_share", "min_segment_idy")]
    lines += [f"overlap_filter_enabled\t{not o.no_overlap_filter}", f"min_novel_ref_bp\t{o.min_novel_ref_bp}", f"min_novel_ref_frac\t{o.min_novel_ref_frac}", f"orient_to_reference\t{o.orient_to_reference}", "", "Outputs", *(f"{k}\t{v}" for k, v in outputs.items()), "", "Summary"]
    lines += [f"reference_sequences\t{counts['refs']}", f"assembly_contigs\t{counts['records']}", f"kept_contigs\t{counts['kept']}", f"discarded_contigs\t{counts['records'] - counts['kept']}", f"coords_rows_skipped_unknown_query\t{counts['skipped']}"]
    lines += [f"status_{s}\t{n}" for s, n in sorted(counts["status"].items())]
    write_text(spark, path, "\n".join([*lines, "", f"Note\t{NOTE}"]) + "\n")


def run(spark: SparkSession, args) -> dict[str, str]:
    """Reads, assigns and writes everything; args as parsed by the command line."""
    o = SortOptions(**{k: getattr(args, k) for k in SortOptions.__dataclass_fields__})
    prefix = str(args.output_prefix)
    outputs = {"ordered_fasta": prefix + ".ordered.fa", "contig_assignments": prefix + ".contig_assignments.tsv", "contig_ref_matches": prefix + ".contig_ref_matches.tsv", "chromosome_summary": prefix + ".chromosome_summary.tsv", "run_summary": prefix + ".run_summary.txt"}
    if args.discarded_fasta:
        outputs["discarded_fasta"] = str(args.discarded_fasta)
    make_parents(spark, outputs.values())
    ref_records = readers.fasta_lengths(spark, args.ref_fasta, args.ref_fai)
    records = readers.fasta_lengths(spark, args.assembly_fasta, args.assembly_fai)
    refs, contigs = readers.by_name(ref_records), readers.by_name(records)
    segments = readers.read_coords(spark, args.coords, o.min_segment_idy)
    m = metrics.match_metrics(segments, contigs, refs).cache()
    placed = assign_contigs(contigs, refs, m, o).cache()
    report = assignment_report(records, placed)
    write_table(report, outputs["contig_assignments"], ASSIGNMENT_COLUMNS, _assignment_line, ["record_ord"], args.parts)
    write_table(m.drop("ref_intervals").withColumn("less", -F.col("merged_query_bp")), outputs["contig_ref_matches"], MATCH_COLUMNS, _match_line, ["query", "less", "ref"], args.parts)
    many = placed.filter("kept").groupBy(F.col("best")["ref"]).agg(F.sum(F.size(F.col("best")["ref_intervals"])).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    summary = assign.chromosome_summary(placed, ref_records.join(refs.select("name"), "name", "left_semi"), spread=many > intervals.ONE_TASK)
    write_table(summary, outputs["chromosome_summary"], SUMMARY_COLUMNS, _summary_line, ["ord"], args.parts)
    status = {r["status"]: r["count"] for r in placed.groupBy("status").count().collect()}
    counts = {"status": status, "kept": status.get("kept", 0), "refs": ref_records.count(), "records": records.count(), "skipped": metrics.unknown_query_count(segments, contigs).first()["skipped"]}
    _run_summary(spark, outputs["run_summary"], args, o, outputs, counts)
    if not args.reports_only:
        keys = ["k1", "k2", "k3", "query"]
        kept = ordered_headers(placed.filter("kept"), args.simple_headers)
        kept = kept.select(F.coalesce("ref_ord", F.lit((1 << 63) - 1)).alias("k1"), F.col("best")["ref_start"].alias("k2"), F.col("best")["ref_end"].alias("k3"), "query", "reverse_complemented", "header")
        pieces = readers.sequences(spark, kept.select(F.col("query").alias("name")), args.assembly_fasta, args.assembly_fai)
        pieces = pieces.join(kept.drop("header"), F.col("name") == F.col("query"))
        turned = F.col("reverse_complemented")
        start = F.when(turned, F.col("length") - F.col("start") - F.length("seq")).otherwise(F.col("start"))
        pieces = pieces.select(*keys, start.alias("start"), F.when(turned, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
        write_records(fasta_lines(kept, pieces, keys), outputs["ordered_fasta"], [*keys, "line"], args.parts)
        if args.discarded_fasta:
            lost = placed.filter("not kept").select("ord", "query", F.concat(F.lit(">"), "query", F.lit(" status="), "status").alias("header"))
            pieces = readers.sequences(spark, lost.select(F.col("query").alias("name")), args.assembly_fasta, args.assembly_fai)
            pieces = pieces.join(lost.select("ord", "query"), F.col("name") == F.col("query")).select("ord", "start", "seq")
            write_records(fasta_lines(lost, pieces, ["ord"]), outputs["discarded_fasta"], ["ord", "line"], args.parts)
    said = [f"{counts['kept']} of {counts['records']} contigs found a place on {counts['refs']} references"]
    said += [f"  {s}: {n}" for s, n in sorted(status.items())] + [f"reports: {prefix}.*"]
    said.append("no FASTA written, as asked" if args.reports_only else f"ordered contigs: {outputs['ordered_fasta']}")
    sys.stderr.write("\n".join(said) + "\n")
    m.unpersist()
    placed.unpersist()
    return outputs
