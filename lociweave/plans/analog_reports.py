"""Readers, reports and FASTA records as queries over the shared test tables, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import assign, scaffold, segment
from ..operators.assign import SortOptions
from ..sinks import formatted
from ..sources import readers
from ..storing import stored
from . import fixing, scaffolding, sorting
from .analog import _GREEDY, _ORDERS, _PLANS, _RANKED, _SEGMENTATION, BLOCK_SQL, CHOICE, CONTIG_LENGTH, FIX, METRICS, NAMED, OPTIONS, PLAIN, UNION, _chosen, _metrics, _orders, _plans, _recursive, _sql, contigs, query, references, table


def _fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', cast({x} as double))"


def _dot(x: str) -> str:
    return f"coalesce(cast({x} as varchar), '.')"


_REPORT = f"""fin as (
  select c.*, w.novel, w.merged_ref_bp as claimed, o.other, case when w.query is null then null else coalesce(o.bp, 0) end as other_bp, case when w.accepted = false then 'duplicate_overlap' else c.status end as final
  from chosen c left join walk w on w.query = c.query left join over o on o.query = c.query and o.n = 1),
named as (select *, case when final = 'kept' then ref || '_' || query end as new_name, case when final = 'kept' then row_number() over (partition by final, ref order by ref_start, ref_end, query) end as order_in_ref from fin),
report as (
  select n.query as contig, '{CONTIG_LENGTH}' as length, n.final as status, case when n.final = 'kept' then 'yes' else 'no' end as kept, {_dot("n.new_name")} as new_name, {_dot("n.ref")} as assigned_ref, {_dot("n.order_in_ref")} as order_in_ref,
    {_dot("n.ref_start")} as ref_start, {_dot("n.ref_end")} as ref_end, coalesce({_fixed("m.ref_midpoint", 1)}, '.') as ref_midpoint, {_dot("n.orientation")} as orientation,
    case when n.final = 'kept' and n.orientation = '-' then 'yes' else 'no' end as reverse_complemented, cast(coalesce(m.raw_query_bp, 0) as varchar) as raw_aligned_bp, cast(coalesce(n.merged_query_bp, 0) as varchar) as merged_query_bp,
    {_fixed("coalesce(n.query_cov, 0)", 4)} as query_cov, cast(coalesce(n.merged_ref_bp, 0) as varchar) as merged_ref_bp, {_fixed("coalesce(m.ref_cov, 0)", 4)} as ref_cov, {_fixed("coalesce(n.avg_identity, 0)", 3)} as avg_identity,
    {_fixed("coalesce(n.share, 0)", 4)} as best_ref_share, {_dot("n.novel")} as novel_ref_bp, coalesce({_fixed("n.novel / cast(n.claimed as double)", 4)}, '.') as novel_ref_frac, {_dot("n.other")} as overlap_best_contig,
    {_dot("x.new_name")} as overlap_best_new_name, {_dot("n.other_bp")} as overlap_best_bp, {_dot("n.second_ref")} as second_ref, {_dot("n.second_merged_query_bp")} as second_merged_query_bp,
    case when n.second_ref is null then '.' else {_fixed(f"n.second_merged_query_bp / {CONTIG_LENGTH}.0", 4)} end as second_query_cov, cast(coalesce(n.refs_n, 0) as varchar) as total_refs_matched
  from named n left join metrics m on m.query = n.query and m.ref = n.ref left join named x on x.query = n.other)"""


@query(_recursive(_sql(UNION, METRICS, CHOICE, _RANKED, _GREEDY, _REPORT, select=f"select {', '.join(sorting.ASSIGNMENT_COLUMNS)} from report")))
def assignment_report(spark, sf_dir):
    """The assignment report's fields, as written."""
    c = contigs(spark, sf_dir)
    placed = stored(assign.place(assign.resolve_overlaps(_chosen(spark, sf_dir), OPTIONS), references(spark, sf_dir), OPTIONS), "placed")
    return formatted(sorting.assignment_report(c, placed), sorting.ASSIGNMENT_COLUMNS, sorting._assignment_line)


@query(
    _sql(
        UNION,
        METRICS,
        select=f"""select query as contig, ref, '{CONTIG_LENGTH}' as query_length, '20100' as ref_length, cast(segment_count as varchar) as segment_count, cast(raw_query_bp as varchar) as raw_query_aligned_bp, cast(raw_ref_bp as varchar) as raw_ref_aligned_bp,
  cast(merged_query_bp as varchar) as merged_query_bp, {_fixed("query_cov", 4)} as query_cov, cast(merged_ref_bp as varchar) as merged_ref_bp, {_fixed("ref_cov", 4)} as ref_cov, cast(ref_start as varchar) as ref_start, cast(ref_end as varchar) as ref_end,
  {_fixed("ref_midpoint", 1)} as ref_midpoint, orientation, {_fixed("avg_identity", 3)} as avg_identity from metrics""",
    )
)
def match_report(spark, sf_dir):
    """The match report's fields, as written."""
    return formatted(_metrics(spark, sf_dir).drop("ref_intervals"), sorting.MATCH_COLUMNS, sorting._match_line)


@query(
    _sql(
        UNION,
        METRICS,
        CHOICE,
        NAMED,
        select=f"""select p.query, '>' || p.ref || '_' || p.query || ' original=' || p.query || ' ref=' || p.ref || ' ref_start=' || p.ref_start || ' ref_end=' || p.ref_end || ' orientation=' || p.orientation || ' reverse_complemented=' ||
  case when p.orientation = '-' then 'yes' else 'no' end || ' query_cov=' || {_fixed("p.query_cov", 4)} || ' avg_identity=' || {_fixed("p.avg_identity", 3)} as header from placed p""",
    )
)
def ordered_headers(spark, sf_dir):
    """FASTA headers of the kept contigs."""
    p = assign.place(assign.resolve_overlaps(_chosen(spark, sf_dir), PLAIN), references(spark, sf_dir), PLAIN)
    return sorting.ordered_headers(p.filter("kept"), False).select("query", "header")


_LABEL = "case when part < 26 then chr(cast(97 + part as integer)) else chr(cast(97 + (part - 26) // 26 as integer)) || chr(cast(97 + (part - 26) % 26 as integer)) end"
_FIX_COLUMNS = [c for c in fixing.COLUMNS if c != "reason"]


@query(
    _recursive(
        _sql(
            BLOCK_SQL,
            _SEGMENTATION,
            _PLANS,
            f"""ps as (select *, ref || '-' || contig || '-' || {_LABEL} as new_name from gs where z - a >= {FIX.min_piece_bp})""",
            select=f"""select p.name as original_contig, p.status, {_dot("new_name")} as new_contig, {_dot("s.part + 1")} as part_index, {_dot("ref")} as dominant_ref, {_dot("a + 1")} as slice_start, {_dot("z")} as slice_end, {_dot("z - a")} as piece_bp,
  {_dot("query_start + 1")} as alignment_query_start, {_dot("query_end")} as alignment_query_end, {_dot("orientation")} as orientation, case when s.contig is null then '.' else 'no' end as reverse_complemented,
  coalesce({_fixed("avg_identity", 3)}, '.') as avg_identity, {_dot("segment_count")} as segment_count from plans p left join ps s on s.contig = p.name and p.status = 'split'""",
        )
    )
)
def fix_report(spark, sf_dir):
    """The fields of the split report but for its reasons, as written."""
    plans, pieces = _plans(spark, sf_dir)
    rows = plans.join(pieces, F.col("name") == F.col("contig"), "left")
    return formatted(rows, fixing.COLUMNS, fixing.report_line(FIX)).select(*_FIX_COLUMNS)


_SHORT = SortOptions(name_separator="")


@query(
    """with o as (select 'r' || cast(o_custkey % 20 as varchar) as ref, cast(o_orderkey as varchar) as query, o_custkey % 20 as ref_ord, o_custkey as s, o_custkey + o_orderkey % 7 as e from orders)
select query, row_number() over (partition by ref order by s, e, query) as order_in_ref, case when n = 1 then ref || query else ref || query || cast(n as varchar) end as new_name
from (select *, row_number() over (partition by ref || query order by ref_ord, s, e, query) as n from o)"""
)
def name_collisions(spark, sf_dir):
    """Names of kept contigs without a separator, so that many collide and get a number."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_custkey") % 20
    best = F.struct(F.concat(F.lit("r"), n.cast("string")).alias("ref"), F.col("o_custkey").alias("ref_start"), (F.col("o_custkey") + F.col("o_orderkey") % 7).alias("ref_end"), F.lit("+").alias("orientation"))
    a = o.select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("query"), best.alias("best"), F.lit("kept").alias("status"))
    refs = o.select(n.alias("ord"), F.concat(F.lit("r"), n.cast("string")).alias("name")).distinct()
    return assign.place(a, refs, _SHORT).select("query", F.col("order_in_ref").cast("bigint").alias("order_in_ref"), "new_name")


@query("select item.doc_id as item, md5(d.text) as seq from labels item join documents d using (doc_id)")
def fetched_sequences(spark, sf_dir):
    """Sequences by name: the texts of all labelled documents."""
    fasta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("name"), F.col("text").alias("seq"))
    return readers.fetch(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item")), fasta, "item").select("item", F.md5("seq").alias("seq"))


@query(
    r"""select doc_id as ord, cast(doc_id as varchar) as name, '>' || cast(doc_id as varchar) || ' ' || lang as header,
  md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ 	

]+|[ 	

]+$', '', 'g')), '')) as seq from documents"""
)
def fasta_records(spark, sf_dir):
    """Documents as FASTA records, parsed."""
    d = table(spark, sf_dir, "documents")
    value = F.concat(F.when(F.col("doc_id") == 0, F.lit(">")).otherwise(F.lit("")), F.col("doc_id").cast("string"), F.lit(" "), "lang", F.lit("\n"), "text")
    return readers.parse_fasta(d.select(F.col("doc_id").alias("ord"), value.alias("value"))).select("ord", "name", "header", F.md5("seq").alias("seq"))


@query("select p_partkey as ord, p_name as name, p_partkey * 3 as length, p_partkey * 7 as offset, cast(p_size as bigint) as line_bases, cast(p_size + 1 as bigint) as line_width from part")
def index_lines(spark, sf_dir):
    """Parts as lines of a FASTA index, parsed; a blank line after each drops out."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    lines = p.select(key.alias("ord"), F.concat_ws("\t", "p_name", key * 3, key * 7, "p_size", F.col("p_size") + 1).alias("value"))
    return readers.parse_fai(lines.unionByName(p.select(key.alias("ord"), F.lit("  ").alias("value"))))


@query("select s_suppkey as ord, s_name as contig, case when s_nationkey % 3 = 0 then s_name else s_name || '_new' end as new_name from supplier where s_nationkey % 4 in (0, 1, 2) and s_nationkey % 5 > 1")
def kept_assignments(spark, sf_dir):
    """Suppliers as rows of an assignment report: marks in all spellings, blank and dotted names."""
    n = F.col("s_nationkey")
    mark = F.element_at(F.array(*map(F.lit, ("yes", " TRUE", "1 ", "no"))), n % 4 + 1)
    name = F.when(n % 5 == 0, F.lit(" ")).when(n % 5 == 1, F.lit(".")).when(n % 3 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit("_new ")))
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("contig"), mark.alias("kept"), name.alias("new_name"), *[F.lit("1").alias(c) for c in ("assigned_ref", "order_in_ref", "ref_start", "ref_end")])
    return readers.kept_assignments(t).select("ord", "contig", "new_name")


def _said(template: str, *values: str) -> str:
    """SQL for a report text with values in its places."""
    texts = re.split(r"\{[^}]*\}", template)
    parts = [f"'{texts[0]}'"]
    for value, text in zip(values, texts[1:], strict=True):
        parts += [value, f"'{text}'"]
    return " || ".join(parts)


_PENALTY = f"'{FIX.auto_breakpoint_penalty_bp:.1f}'"
_REASON = f"""case when status = 'target_missing' then '{segment.MISSING}' when status = 'not_split_no_alignment' then '{segment.NO_ALIGNMENT}' when status = 'not_split_single_block' then '{segment.SINGLE_BLOCK}'
  when status = 'not_split_single_target' then '{segment.SINGLE_TARGET}' when status = 'not_split_short_piece' then case when smooth then '{segment.SHORT_AUTO}' else '{segment.SHORT}' end
  when status = 'not_split_auto_smooth' then case when n_groups < 2 then {_said(segment.SMOOTH, _fixed("discordant", 1), _PENALTY)} else {_said(segment.WEAK, "weakest", f"'{FIX.auto_min_piece_aligned_bp}'")} end
  when smooth then {_said(segment.SPLIT_AUTO, "n_pieces", "n_blocks", "changes", _PENALTY)} else {_said(segment.SPLIT, "n_pieces", "n_blocks")} end"""


@query(
    _recursive(
        _sql(
            BLOCK_SQL,
            _SEGMENTATION,
            _PLANS,
            f"""wk as (select contig, min(aligned_bp) as weakest from gs where smooth and (aligned_bp < {FIX.auto_min_piece_aligned_bp} or (query_end - query_start) / {CONTIG_LENGTH}.0 < {FIX.auto_min_piece_query_frac}) group by contig),
dc as (select contig, sum(w) - max(w) as discordant from (select contig, ref, orientation, sum(identity_bp) / 100 as w from blk group by all) group by contig)""",
            select=f"select p.name, p.part, p.ord, p.status, {_REASON} as reason from plans p left join wk on wk.contig = p.name left join dc on dc.contig = p.name",
        )
    )
)
def fix_reasons(spark, sf_dir):
    """Why each contig was split or not, as the report says it."""
    plans, _ = _plans(spark, sf_dir)
    names = ["name", "part", "ord", "status", "reason"]
    told = formatted(plans, names, lambda r: [r["name"], r["part"], r["ord"], r["status"], segment.reason(r, FIX)])
    return told.select("name", F.col("part").cast("int"), F.col("ord").cast("bigint"), "status", "reason")


@query(
    _sql(
        _ORDERS,
        select="""select ref as scaffold, count(*) as contigs, cast(sum(length(seq) + case when left_name is null then 0 else greatest(0, ref_start - left_end - 1) end) as bigint) as scaffold_bp, cast(sum(length(seq)) as bigint) as sequence_bp,
  cast(sum(case when left_name is null then 0 else greatest(0, ref_start - left_end - 1) end) as bigint) as gap_bp, count(*) - 1 as gaps, arg_min(ref_start, ord) as first_ref_start, arg_max(ref_start + 2, ord) as last_ref_end, string_agg(name, ',' order by ord) as ordered_contigs from l group by ref""",
    )
)
def scaffold_summary(spark, sf_dir):
    """The summary's rows, with inferred gaps."""
    m = _orders(spark, sf_dir).withColumn("length", F.length("seq").cast("bigint"))
    return scaffold.scaffolds(m, None, with_sequence=False).select(*scaffolding.SUMMARY_COLUMNS)


_LINES = """pos as (select part, s_ord, off + i as place, substr(seq, i + 1, 1) as c from (
    select 0 as part, min(ord) over (partition by ref) as s_ord, seq, case when left_name is null then 0 else 3 end + coalesce(sum(length(seq) + case when left_name is null then 0 else 3 end) over (partition by ref order by ord rows between unbounded preceding and 1 preceding), 0) as off from l), lateral (select unnest(generate_series(0, length(seq) - 1)) as i)
  union all select 0, s_ord, off + i, 'N' from (
    select min(ord) over (partition by ref) as s_ord, left_name, coalesce(sum(length(seq) + case when left_name is null then 0 else 3 end) over (partition by ref order by ord rows between unbounded preceding and 1 preceding), 0) as off from l), lateral (select unnest(generate_series(0, 2)) as i) where left_name is not null),
heads as (select ref, min(ord) as s_ord, count(*) as n, sum(length(seq)) as bp, count(left_name) * 3 as gap from l group by ref)"""


@query(
    _sql(
        _ORDERS,
        _LINES,
        select="""select s_ord as ord, cast(-1 as bigint) as line, '>' || ref || ' contigs=' || n || ' sequence_bp=' || cast(bp as bigint) || ' gap_bp=' || gap || ' gap_mode=fixed' as text from heads
  union all select s_ord, cast(place // 80 as bigint), string_agg(c, '' order by place) from pos group by s_ord, place // 80""",
    )
)
def scaffold_lines(spark, sf_dir):
    """The lines of all scaffolds' records, made of pieces of their contigs and gaps."""
    o = _orders(spark, sf_dir)
    m = o.withColumn("length", F.length("seq").cast("bigint"))
    rest = m.filter(F.lit(False)).withColumn("header", F.lit(""))
    pieces = o.select("ord", F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("start"), F.substring("seq", k + 1, 1 if k < 2 else 1 << 30).alias("seq")) for k in range(3)])).alias("p")).select("ord", "p.*").filter("seq != ''")
    lines = scaffolding.scaffold_lines(m, rest, pieces, 3)
    return lines.select("ord", "line", F.explode(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("text")))).alias("x")).select("ord", (F.col("line") + F.col("x.i")).alias("line"), "x.text")


@query(
    f"""with {_ORDERS},
m as (select o.*, l.left_name from (select *, o_orderstatus from o join orders on o_orderkey = ord) o join (select ref, ord, lag(name) over (partition by ref order by ord) as left_name from o join orders on o_orderkey = ord where o_orderstatus <> 'O') l using (ref, ord)),
s as (select ref, count(*) as n, sum(length(seq)) as bp, count(left_name) * 3 as gap, string_agg(case when left_name is null then '' else 'NNN' end || seq, '' order by ord) as seq, min(ord) as ord from m group by ref)
select 0 as part, ord, rtrim('>' || ref || ' contigs=' || n || ' sequence_bp=' || cast(bp as bigint) || ' gap_bp=' || gap || ' gap_mode=fixed' || chr(10) || regexp_replace(seq, '(.{{1,80}})', '\\1' || chr(10), 'g'), chr(10)) as text from s
union all select 1, ord, '>' || name || chr(10) || o.seq from o join orders on o_orderkey = ord where o_orderstatus = 'O'"""
)
def scaffold_records(spark, sf_dir):
    """Orders as ordered contigs: those not open are assigned and joined by customer, the others follow as they are."""
    records = _orders(spark, sf_dir).select("ord", "name", "seq", F.concat(F.lit(">"), "name").alias("header"))
    o = _orders(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), "o_orderstatus"), "ord").filter("o_orderstatus <> 'O'")
    assignments = o.select("ord", F.col("name").alias("new_name"), "ref", "ref_start", "ref_end")
    m = scaffold.members(records, assignments.drop("ord"))
    return scaffolding.scaffold_records(m, scaffold.unassigned(records, assignments), 3)
