"""The fix command: split chimeric contigs at breakpoints."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..files import make_parents
from ..functions.sequence import reverse_complement, slice_of
from ..operators import blocks as block_ops
from ..operators import segment
from ..operators.segment import FixOptions
from ..sinks import decimals, fasta_lines, write_records, write_table
from ..sources import chunked, readers

# The columns of the report.
COLUMNS = ["original_contig", "status", "new_contig", "part_index", "dominant_ref", "slice_start", "slice_end", "piece_bp", "alignment_query_start", "alignment_query_end", "orientation", "reverse_complemented", "avg_identity", "segment_count", "reason"]


def piece_header(simple: bool):
    def header(p) -> str:
        if simple:
            return f">{p['new_name']}"
        turned = "yes" if p["reverse_complemented"] else "no"
        return f">{p['new_name']} original={p['contig']} ref={p['ref']} slice={p['slice_start'] + 1}-{p['slice_end']} alignment={p['align_start'] + 1}-{p['align_end']} orientation={p['orientation']} reverse_complemented={turned} avg_identity={p['avg_identity']:.3f}"

    return F.udf(header, "string", useArrow=True)


def report_line(o: FixOptions):
    def line(r) -> list:
        if r["status"] != "split":
            return [r["name"], r["status"], *["."] * 12, segment.reason(r, o)]
        turned = "yes" if r["reverse_complemented"] else "no"
        return [r["name"], r["status"], r["new_name"], r["part_index"], r["ref"], r["slice_start"] + 1, r["slice_end"], r["slice_end"] - r["slice_start"], r["align_start"] + 1, r["align_end"], r["orientation"], turned, decimals(r["avg_identity"], 3), r["segment_count"], segment.reason(r, o)]

    return line


def run(spark: SparkSession, args) -> None:
    o = FixOptions(**{k: getattr(args, k) for k in FixOptions.__dataclass_fields__})
    explicit = readers.requested_names(spark, args.contigs, args.contigs_file).cache()
    if not o.auto and not explicit.limit(1).count():
        sys.stderr.write("ERROR: no contig is named (--contigs, --contigs-file) and --auto is off\n")
        sys.exit(2)
    make_parents(spark, [args.output_fasta, args.report])
    fasta = chunked.read_chunks(spark, args.assembly_fasta)
    lengths = readers.by_name(fasta.records.select("ord", "name", "length"))
    segments = readers.parse_coords(readers.numbered_lines(spark, args.coords))
    blocks = block_ops.collect_blocks(segments, o.min_segment_bp, o.min_segment_idy, o.max_merge_gap, None if o.auto else explicit).cache()
    requested = segment.requested_contigs(explicit, lengths, blocks, o)
    plans, pieces = segment.plan_splits(requested, lengths.select(F.col("name").alias("contig"), "length"), blocks, o)
    plans, pieces = plans.cache(), pieces.cache()
    split = plans.filter("status = 'split'").select("name")
    keys = ["ord", "part_index"]
    whole = fasta.records if not args.pieces_only else fasta.records.filter(F.lit(False))
    copied = whole.join(split, "name", "left_anti").select("ord", F.lit(0).alias("part_index"), "header")
    header = piece_header(args.simple_headers)(F.struct("new_name", "contig", "ref", "slice_start", "slice_end", "align_start", "align_end", "orientation", "reverse_complemented", "avg_identity"))
    cut = fasta.records.select("ord", "name").join(pieces, F.col("name") == F.col("contig"))
    heads = copied.unionByName(cut.select("ord", "part_index", header.alias("header")))
    ranges = copied.select(*keys, F.lit(0).cast("bigint").alias("low"), F.lit((1 << 62)).alias("high"), F.lit(False).alias("turned"))
    ranges = ranges.unionByName(cut.select(*keys, F.col("slice_start").alias("low"), F.col("slice_end").alias("high"), F.col("reverse_complemented").alias("turned")))
    # what each chunk has of each slice
    low, high = F.greatest("low", "start"), F.least(F.col("high"), F.col("start") + F.length("seq"))
    met = fasta.pieces.join(ranges, "ord").withColumn("a", low).withColumn("z", high).filter("a < z")
    seq = slice_of(F.col("seq"), F.col("a") - F.col("start"), F.col("z") - F.col("start"))
    met = met.select(*keys, F.when(F.col("turned"), F.col("high") - F.col("z")).otherwise(F.col("a") - F.col("low")).alias("start"), F.when(F.col("turned"), reverse_complement(seq)).otherwise(seq).alias("seq"))
    write_records(fasta_lines(heads, met, keys), args.output_fasta, [*keys, "line"], args.parts)
    write_table(plans.join(pieces, F.col("name") == F.col("contig"), "left"), args.report, COLUMNS, report_line(o), ["part", "ord", "part_index"], args.parts)
    status = {r["status"]: r["count"] for r in plans.groupBy("status").count().collect()}
    said = [f"{sum(status.values())} contigs looked at"] + [f"  {s}: {n}" for s, n in sorted(status.items())]
    sys.stderr.write("\n".join([*said, f"contigs: {args.output_fasta}", f"report: {args.report}"]) + "\n")
    for cached in (explicit, blocks, plans, pieces):
        cached.unpersist()
