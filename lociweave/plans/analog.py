"""The engine's operators as queries over the shared test tables, each with its SQL.

Segments are derived from lineitem and contigs from supplier, so that every
query works on whole tables and grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as fn
from ..operators import assign, blocks, intervals, metrics, scaffold, segment
from ..operators.assign import SortOptions
from ..operators.segment import FixOptions
from ..storing import stored

OPTIONS = SortOptions(min_aligned_bp=3500, min_query_cov=0.45, min_best_ref_share=0.5, min_novel_ref_bp=300, min_novel_ref_frac=0.1, orient_to_reference=True)
FIX = FixOptions(min_segment_bp=40, max_merge_gap=200, min_piece_bp=30, auto=True, auto_breakpoint_penalty_bp=60.0, auto_min_piece_aligned_bp=40, auto_min_piece_query_frac=0.0)
CONTIG_LENGTH, REF_LENGTH = 9050, 20100
#: Where the places of contigs without segments start.
UNALIGNED = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments from all of lineitem.  ord is made of the key columns, which tell rows apart; equal rows tie and are alike."""
    li = table(spark, sf_dir, "lineitem")
    length = F.col("l_quantity").cast("bigint")
    ref = F.when(F.col("l_linenumber") <= 1 + F.col("l_suppkey") % 6, F.col("l_suppkey") % 6).otherwise(F.col("l_partkey") % 6)
    r0, q0 = 1 + (F.col("l_orderkey") * 7) % 20000, 1 + (F.col("l_partkey") * 11) % 9000
    back = F.col("l_returnflag") == "R"
    s = li.select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).cast("bigint").alias("ord"),
        F.concat(F.lit("r"), ref.cast("string")).alias("ref"),
        F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("query"),
        r0.alias("ref_start"),
        (r0 + length - 1).alias("ref_end"),
        F.when(back, q0 + length - 1).otherwise(q0).alias("query_start"),
        F.when(back, q0).otherwise(q0 + length - 1).alias("query_end"),
        length.alias("len_ref"),
        length.alias("len_query"),
        (100 - F.round(F.col("l_discount") * 100)).cast("double").alias("identity"),
        F.lit(REF_LENGTH).cast("bigint").alias("ref_length"),
        F.lit(CONTIG_LENGTH).cast("bigint").alias("query_length"),
    )
    return s.withColumn("orientation", fn.orientation(*[F.col(c) for c in ("ref_start", "ref_end", "query_start", "query_end")]))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs from supplier, and from nation others, which no segment names."""
    length = F.lit(CONTIG_LENGTH).cast("bigint").alias("length")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("name"), length)
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + UNALIGNED).cast("bigint").alias("ord"), F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("name"), length)
    return s.unionByName(n)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references that segments name, plus one that none does."""
    used = segments(spark, sf_dir).select("ref").unionByName(table(spark, sf_dir, "region").select(F.lit("r9").alias("ref"))).distinct()
    return used.select(F.substring("ref", 2, 9).cast("bigint").alias("ord"), F.col("ref").alias("name"), F.lit(REF_LENGTH).cast("bigint").alias("length"))


# The same views in SQL.
VIEWS = f"""segs0 as (
  select *, cast(l_quantity as bigint) len, 1 + (l_orderkey * 7) % 20000 r0, 1 + (l_partkey * 11) % 9000 q0
  from lineitem),
segs as (
  select (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey as ord,
    'r' || cast(case when l_linenumber <= 1 + l_suppkey % 6 then l_suppkey % 6 else l_partkey % 6 end as varchar) as ref,
    'c' || cast(l_suppkey as varchar) as query, r0 as ref_start, r0 + len - 1 as ref_end,
    case when l_returnflag = 'R' then q0 + len - 1 else q0 end as query_start,
    case when l_returnflag = 'R' then q0 else q0 + len - 1 end as query_end,
    len as len_ref, len as len_query, cast(100 - round(l_discount * 100) as double) as identity,
    case when l_returnflag = 'R' and len > 1 then '-' else '+' end as orientation
  from segs0),
contigs as (select s_suppkey as ord, 'c' || cast(s_suppkey as varchar) as name, {CONTIG_LENGTH} as length from supplier
  union all select n_nationkey + {UNALIGNED}, 'u' || cast(n_nationkey as varchar), {CONTIG_LENGTH} from nation),
refs as (select cast(substr(ref, 2) as bigint) as ord, ref as name, {REF_LENGTH} as length from (select distinct ref from segs union select 'r9'))"""

UNION = """pts as (select query, ref, ref_start as s, ref_end + 1 as e from segs),
mx as (select *, max(e) over (partition by query, ref order by s, e rows between unbounded preceding and 1 preceding) as m from pts),
isl as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by query, ref order by s, e rows unbounded preceding) as g from mx),
runion as (select query, ref, cast(min(s) as bigint) as s, cast(max(e) as bigint) as e from isl group by query, ref, g),
qts as (select query, ref, least(query_start, query_end) as s, greatest(query_start, query_end) + 1 as e from segs),
qmx as (select *, max(e) over (partition by query, ref order by s, e rows between unbounded preceding and 1 preceding) as m from qts),
qisl as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by query, ref order by s, e rows unbounded preceding) as g from qmx),
qunion as (select query, ref, min(s) as s, max(e) as e from qisl group by query, ref, g)"""

METRICS = f"""rbp as (select query, ref, cast(sum(e - s) as bigint) as merged_ref_bp from runion group by all),
qbp as (select query, ref, cast(sum(e - s) as bigint) as merged_query_bp from qunion group by all),
mm as (
  select s.query, s.ref, min(s.ord) as first_ord, count(*) as segment_count, cast(sum(len_query) as bigint) as raw_query_bp,
    cast(sum(len_ref) as bigint) as raw_ref_bp, sum(identity * len_query) / sum(len_query) as avg_identity,
    sum((ref_start + ref_end) * len_query) / 2.0 / sum(len_query) as ref_midpoint,
    case when sum(case when orientation = '-' then len_query else -len_query end) > 0 then '-' else '+' end as orientation,
    min(ref_start) as ref_start, max(ref_end) as ref_end
  from segs s join contigs c on s.query = c.name group by s.query, s.ref),
metrics as (
  select mm.*, merged_query_bp, merged_ref_bp, merged_query_bp / {CONTIG_LENGTH}.0 as query_cov, merged_ref_bp / {REF_LENGTH}.0 as ref_cov
  from mm join qbp using (query, ref) join rbp using (query, ref))"""

CHOICE = f"""rk as (
  select *, row_number() over (partition by query order by merged_query_bp desc, raw_query_bp desc, avg_identity desc, first_ord) as rn,
    merged_query_bp / cast(sum(merged_query_bp) over (partition by query) as double) as share, count(*) over (partition by query) as refs_n
  from metrics),
best as (select * from rk where rn = 1),
second as (select query, ref as second_ref, merged_query_bp as second_merged_query_bp from rk where rn = 2),
chosen as (
  select c.ord, c.name as query, b.ref, b.share, b.refs_n, b.merged_query_bp, b.merged_ref_bp, b.query_cov, b.avg_identity, b.ref_start, b.ref_end, b.orientation, second_ref, second_merged_query_bp,
    case when b.query is null then 'no_alignment' when b.merged_query_bp < {OPTIONS.min_aligned_bp} then 'below_min_aligned_bp'
      when b.query_cov < {OPTIONS.min_query_cov} then 'below_min_query_cov' when b.share < {OPTIONS.min_best_ref_share} then 'ambiguous_ref_match' else 'kept' end as status
  from contigs c left join best b on c.name = b.query left join second s on c.name = s.query)"""

PLAIN = SortOptions(**{**OPTIONS.__dict__, "no_overlap_filter": True})

NAMED = """placed as (
  select c.*, r.ord as ref_ord, row_number() over (partition by c.ref order by c.ref_start, c.ref_end, c.query) as order_in_ref
  from chosen c left join refs r on c.ref = r.name where status = 'kept')"""

BLOCK_SQL = f"""qb as (
  select query as contig, ord, ref, orientation, least(query_start, query_end) - 1 as qs, greatest(query_start, query_end) as qe,
    ref_start - 1 as rs, ref_end as re, len_query as bp, identity * len_query as ibp
  from segs where len_query >= {FIX.min_segment_bp}),
ch as (select *, case when lag(ref) over w <> ref or lag(orientation) over w <> orientation then 1 else 0 end as c from qb window w as (partition by contig order by qs, qe, ref, ord)),
rn as (select *, sum(c) over (partition by contig order by qs, qe, ref, ord rows unbounded preceding) as run from ch),
mg as (select *, max(qe) over (partition by contig, run order by qs, qe, ref, ord rows between unbounded preceding and 1 preceding) as m from rn),
pt as (select *, sum(case when qs > m + {FIX.max_merge_gap} then 1 else 0 end) over (partition by contig, run order by qs, qe, ref, ord rows unbounded preceding) as part from mg),
blk0 as (select contig, run, part, min(ref) as ref, min(orientation) as orientation, min(qs) as query_start, max(qe) as query_end, min(rs) as ref_start, max(re) as ref_end,
    cast(sum(bp) as bigint) as aligned_bp, sum(ibp) as identity_bp, count(*) as segment_count from pt group by contig, run, part),
blk as (select *, cast(row_number() over (partition by contig order by run, part) - 1 as integer) as block_no from blk0)"""


def _sql(*parts: str, select: str) -> str:
    return f"with {', '.join((VIEWS, *parts))} {select}"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.match_metrics(segments(spark, sf_dir), contigs(spark, sf_dir), references(spark, sf_dir))


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.choose(contigs(spark, sf_dir), _metrics(spark, sf_dir), OPTIONS)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.collect_blocks(segments(spark, sf_dir), FIX.min_segment_bp, FIX.min_segment_idy, FIX.max_merge_gap)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(_sql(select="select ord, ref, query, ref_start, ref_end + 1 as ref_stop, least(query_start, query_end) as query_low, greatest(query_start, query_end) + 1 as query_stop, (ref_start + ref_end) / 2.0 as ref_midpoint, orientation from segs"))
def seg_project_orientation(spark, sf_dir):
    s = segments(spark, sf_dir)
    r0, r1 = fn.half_open_1(F.col("ref_start"), F.col("ref_end"))
    q0, q1 = fn.half_open_1(F.col("query_start"), F.col("query_end"))
    return s.select("ord", "ref", "query", r0.alias("ref_start"), r1.alias("ref_stop"), q0.alias("query_low"), q1.alias("query_stop"), ((r0 + r1 - 1) / 2).alias("ref_midpoint"), "orientation")


@query(_sql(select="select ord, query, ref, identity from segs where not (identity < 95)"))
def seg_filter_identity(spark, sf_dir):
    from ..sources.readers import at_least_identity

    return at_least_identity(segments(spark, sf_dir), 95.0).select("ord", "query", "ref", "identity")


@query(_sql(select="select count(*) as skipped from segs where query not in (select case when ord % 5 = 0 then name || '_renamed' else name end from contigs)"))
def seg_unknown_query_count(spark, sf_dir):
    renamed = F.when(F.col("ord") % 5 == 0, F.concat("name", F.lit("_renamed"))).otherwise(F.col("name"))
    return metrics.unknown_query_count(segments(spark, sf_dir), contigs(spark, sf_dir).withColumn("name", renamed))


@query(_sql(UNION, select='select query, ref, s as "start", e as "end" from runion'))
def interval_union(spark, sf_dir):
    s = segments(spark, sf_dir).select("query", "ref", F.col("ref_start").alias("start"), (F.col("ref_end") + 1).alias("end"))
    return intervals.union(s, ["query", "ref"])


@query(_sql(UNION, select="select query, ref, cast(sum(e - s) as bigint) as bp from runion group by query, ref"))
def interval_union_bp(spark, sf_dir):
    return intervals.covered_bp(interval_union(spark, sf_dir), ["query", "ref"])


def _halves(spark, sf_dir):
    """All segments, as two sides: those of even and those of odd place."""
    s = segments(spark, sf_dir).select("ref", "ord", F.col("ref_start").alias("start"), (F.col("ref_end") + 1).alias("end"))
    # a reference has few places for all its rows
    even, odd = (intervals.longest(s.filter(f"ord % 2 = {k}"), ["ref"]) for k in range(2))
    return intervals.union(even, ["ref"]), intervals.union(odd, ["ref"])


_HALVES = """hs as (select ref, ref_start as s, ref_end + 1 as e, case when ord % 2 = 0 then 'a' else 'b' end as side from segs),
hm as (select *, max(e) over (partition by side, ref order by s, e rows between unbounded preceding and 1 preceding) as m from hs),
hi as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by side, ref order by s, e rows unbounded preceding) as g from hm),
hu as (select side, ref, min(s) as s, max(e) as e from hi group by side, ref, g),
common as (select a.ref, sum(least(a.e, b.e) - greatest(a.s, b.s)) as bp from hu a join hu b on a.ref = b.ref and a.side = 'a' and b.side = 'b' and a.s < b.e and b.s < a.e group by a.ref)"""


@query(_sql(_HALVES, select="select ref, cast(bp as bigint) as bp from common"))
def interval_intersect_bp(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return intervals.intersect_bp(a, b, ["ref"])


@query(_sql(_HALVES, select="select h.ref, cast(sum(e - s) - coalesce(max(c.bp), 0) as bigint) as bp from hu h left join common c on h.ref = c.ref where side = 'a' group by h.ref having sum(e - s) - coalesce(max(c.bp), 0) > 0"))
def interval_subtract_bp(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return intervals.covered_bp(intervals.subtract(a, b, ["ref"]), ["ref"])


_METRIC_COLUMNS = ["query", "ref", "segment_count", "raw_query_bp", "raw_ref_bp", "merged_query_bp", "query_cov", "merged_ref_bp", "ref_cov", "ref_start", "ref_end", "ref_midpoint", "orientation", "avg_identity"]


@query(_sql(UNION, METRICS, select=f"select {', '.join(_METRIC_COLUMNS)} from metrics"))
def match_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select(*_METRIC_COLUMNS)


@query(_sql(UNION, METRICS, CHOICE, select="select query, ref as best_ref, merged_query_bp as best_bp, second_ref, second_merged_query_bp, share as best_ref_share, refs_n as total_refs_matched from chosen where ref is not null"))
def best_and_second_ref(spark, sf_dir):
    c = _chosen(spark, sf_dir).filter("best is not null")
    return c.select("query", F.col("best")["ref"].alias("best_ref"), F.col("best")["merged_query_bp"].alias("best_bp"), F.col("second")["ref"].alias("second_ref"), F.col("second")["merged_query_bp"].alias("second_merged_query_bp"), "best_ref_share", "total_refs_matched")


@query(_sql(UNION, METRICS, CHOICE, select="select query, status, coalesce(refs_n, 0) as total_refs_matched from chosen"))
def assignment_status(spark, sf_dir):
    return _chosen(spark, sf_dir).select("query", "status", "total_refs_matched")


@query(_sql(UNION, METRICS, CHOICE, select="select status, count(*) as contigs from chosen group by status"))
def status_counts(spark, sf_dir):
    return _chosen(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("contigs"))


_RANKED = """kept as (select *, row_number() over (partition by ref order by merged_ref_bp desc, merged_query_bp desc, query_cov desc, avg_identity desc, ord) as rank from chosen where status = 'kept'),
spans as (select k.query, k.ref, k.rank, u.s, u.e from kept k join runion u on k.query = u.query and k.ref = u.ref),
pairs as (select c.query, k.query as other, k.rank, sum(least(c.e, k.e) - greatest(c.s, k.s)) as bp from spans c join spans k on c.ref = k.ref and k.rank < c.rank and c.s < k.e and k.s < c.e group by c.query, k.query, k.rank)"""


# A contig's reference positions as bits; contigs of a reference claim theirs in order of rank.
_GREEDY = f"""kb as (
  select query, ref, rank, merged_ref_bp, bitstring_agg(p, 0, 21000) as bits
  from (select k.query, k.ref, k.rank, k.merged_ref_bp, unnest(generate_series(u.s, u.e - 1)) as p from kept k join runion u on k.query = u.query and k.ref = u.ref)
  group by query, ref, rank, merged_ref_bp),
walk as (
  select ref, rank, query, bits, bits as covered, merged_ref_bp, cast(merged_ref_bp as bigint) as novel, true as accepted from kb where rank = 1
  union all
  select ref, rank, query, bits, case when ok then covered | bits else covered end, merged_ref_bp, novel, ok
  from (select *, novel > 0 and (novel >= {OPTIONS.min_novel_ref_bp} or novel / cast(merged_ref_bp as double) >= {OPTIONS.min_novel_ref_frac}) as ok
    from (select k.ref, k.rank, k.query, k.bits, w.covered, k.merged_ref_bp, cast(bit_count(k.bits & ~w.covered) as bigint) as novel from walk w join kb k on k.ref = w.ref and k.rank = w.rank + 1))),
over as (
  select a.query, b.query as other, cast(bit_count(a.bits & b.bits) as bigint) as bp, row_number() over (partition by a.query order by bit_count(a.bits & b.bits) desc, b.rank) as n
  from walk a join walk b on a.ref = b.ref and b.rank < a.rank and b.accepted where bit_count(a.bits & b.bits) > 0)"""


@query(
    _sql(
        UNION,
        METRICS,
        CHOICE,
        _RANKED,
        _GREEDY,
        select="select w.query, case when accepted then 'kept' else 'duplicate_overlap' end as status, novel as novel_ref_bp, novel / cast(merged_ref_bp as double) as novel_ref_frac, coalesce(other, '.') as overlap_best_contig, coalesce(bp, 0) as overlap_best_bp from walk w left join over o on w.query = o.query and o.n = 1",
    ).replace("with ", "with recursive ", 1)
)
def greedy_overlap_filter(spark, sf_dir):
    a = assign.resolve_overlaps(_chosen(spark, sf_dir), OPTIONS)
    return a.filter("novel_ref_bp is not null").select("query", "status", "novel_ref_bp", "novel_ref_frac", "overlap_best_contig", "overlap_best_bp")


@query(_sql(UNION, METRICS, CHOICE, _RANKED, select="select query, other as overlap_best_contig, cast(bp as bigint) as overlap_best_bp from (select *, row_number() over (partition by query order by bp desc, rank) as n from pairs) where n = 1"))
def best_overlap_contig(spark, sf_dir):
    """Among all stronger candidates, accepted or not."""
    c = stored(assign.ranked_candidates(_chosen(spark, sf_dir)), "candidates")
    return assign.best_overlap(c, c.select("query"))


@query(_sql(UNION, METRICS, CHOICE, NAMED, select="select query, ref, order_in_ref, ref || '_' || query as new_name, orientation = '-' as reverse_complemented from placed"))
def ordered_names(spark, sf_dir):
    p = assign.place(assign.resolve_overlaps(_chosen(spark, sf_dir), PLAIN), references(spark, sf_dir), PLAIN)
    return p.filter("kept").select("query", F.col("best")["ref"].alias("ref"), F.col("order_in_ref").cast("bigint").alias("order_in_ref"), "new_name", "reverse_complemented")


@query(
    _sql(
        UNION,
        METRICS,
        CHOICE,
        NAMED,
        f"""cs as (select p.ref, u.s, u.e from placed p join runion u on p.query = u.query and p.ref = u.ref),
cm as (select *, max(e) over (partition by ref order by s, e rows between unbounded preceding and 1 preceding) as m from cs),
ci as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by ref order by s, e rows unbounded preceding) as g from cm),
cu as (select ref, max(e) - min(s) as bp from ci group by ref, g),
cov as (select ref, sum(bp) as bp from cu group by ref),
ks as (select ref, count(*) as n, min(ref_start) as a, max(ref_end) as z, string_agg(ref || '_' || query, ',' order by order_in_ref) as names from placed group by ref)""",
        select=f"select r.name as ref, coalesce(n, 0) as kept_contigs, cast(coalesce(bp, 0) as bigint) as covered_ref_bp, coalesce(bp, 0) / {REF_LENGTH}.0 as ref_cov, a as first_ref_start, z as last_ref_end, names as ordered_new_names from refs r left join ks on r.name = ks.ref left join cov on r.name = cov.ref",
    )
)
def chromosome_summary(spark, sf_dir):
    refs = references(spark, sf_dir)
    p = assign.place(assign.resolve_overlaps(_chosen(spark, sf_dir), PLAIN), refs, PLAIN)
    return assign.chromosome_summary(p, refs).select("ref", "kept_contigs", "covered_ref_bp", "ref_cov", "first_ref_start", "last_ref_end", "ordered_new_names")


_BLOCK_COLUMNS = ["contig", "block_no", "ref", "orientation", "query_start", "query_end", "ref_start", "ref_end", "aligned_bp", "identity_bp", "segment_count"]


@query(_sql(BLOCK_SQL, select=f"select {', '.join(_BLOCK_COLUMNS)} from blk"))
def query_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select(*_BLOCK_COLUMNS)


def _event_blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    one = F.lit(1).cast("bigint")
    return e.select(F.col("user_id").cast("string").alias("contig"), F.col("event_id").alias("ord"), F.col("event_type").alias("ref"), F.lit("+").alias("orientation"), at.alias("query_start"), (at + 1).alias("query_end"), at.alias("ref_start"), (at + 1).alias("ref_end"), one.alias("aligned_bp"), F.lit(100.0).alias("identity_bp"), one.alias("segment_count"))


@query(
    """with e as (select cast(user_id as varchar) as contig, event_id as ord, event_type as ref, cast(epoch(date_trunc('second', ts)) as bigint) as t from events),
c as (select *, case when lag(ref) over (partition by contig order by t, t + 1, ref, ord) <> ref then 1 else 0 end as ch from e),
r as (select *, sum(ch) over (partition by contig order by t, ref, ord rows unbounded preceding) as run from c),
m as (select *, max(t + 1) over (partition by contig, run order by t, ord rows between unbounded preceding and 1 preceding) as mx from r),
p as (select *, sum(case when t > mx + 1000 then 1 else 0 end) over (partition by contig, run order by t, ord rows unbounded preceding) as part from m),
g as (select contig, run, part, min(ref) as ref, min(t) as query_start, max(t) + 1 as query_end, count(*) as segment_count from p group by contig, run, part)
select contig, cast(row_number() over (partition by contig order by run, part) - 1 as integer) as block_no, ref, query_start, query_end, segment_count from g"""
)
def event_sessions(spark, sf_dir):
    return blocks.merge_blocks(_event_blocks(spark, sf_dir), 1000).select("contig", "block_no", "ref", "query_start", "query_end", "segment_count")


@query(_sql(BLOCK_SQL, select="select contig, count(*) as n_blocks, count(distinct ref || orientation) > 1 as has_signal from blk group by contig"))
def split_signal_contigs(spark, sf_dir):
    return blocks.split_signals(_blocks(spark, sf_dir))


_CUTS = f"""bd as (select *, lead(query_start) over (partition by contig order by block_no) as nxt from blk),
bc as (select *, greatest(0, (query_end + nxt) // 2) as cut from bd),
sl as (select contig, block_no, ref, orientation, query_start, query_end, identity_bp / aligned_bp as avg_identity, segment_count,
    greatest(0, least(coalesce(lag(cut) over (partition by contig order by block_no), 0), {CONTIG_LENGTH})) as slice_start,
    greatest(0, least(case when nxt is null then {CONTIG_LENGTH} else cut end, {CONTIG_LENGTH})) as slice_end from bc)"""


@query(_sql(BLOCK_SQL, _CUTS, select="select contig, block_no as part, cast(cut as bigint) as cut from bc where nxt is not null"))
def split_boundaries(spark, sf_dir):
    by = Window.partitionBy("contig").orderBy("block_no")
    b = _blocks(spark, sf_dir).withColumn("cut", fn.boundary(F.col("query_end"), F.lead("query_start").over(by)))
    return b.withColumn("more", F.lead("block_no").over(by)).filter("more is not null").select("contig", F.col("block_no").alias("part"), "cut")


@query(_sql(BLOCK_SQL, _CUTS, select=f"select contig, block_no + 1 as part_index, ref, cast(slice_start as bigint) as slice_start, cast(slice_end as bigint) as slice_end, orientation, avg_identity, segment_count from sl where slice_end - slice_start >= {FIX.min_piece_bp}"))
def direct_split_pieces(spark, sf_dir):
    lengths = contigs(spark, sf_dir).select(F.col("name").alias("contig"), "length")
    p = segment.pieces_of(segment.direct_groups(_blocks(spark, sf_dir)), lengths, FIX)
    return p.select("contig", "part_index", "ref", "slice_start", "slice_end", "orientation", "avg_identity", "segment_count")


@query(_sql(BLOCK_SQL, select="select contig, ref, orientation, sum(identity_bp) / 100 as weighted_bp, cast(sum(aligned_bp) as bigint) as aligned_bp from blk group by contig, ref, orientation"))
def group_support(spark, sf_dir):
    return segment.group_support(_blocks(spark, sf_dir))


# Sums of doubles are made in the library's order, as ties between places of a cut depend on their rounding.
_SEGMENTATION = f"""wb as materialized (select contig, block_no as i, ref, orientation, identity_bp / 100::double as w, identity_bp, aligned_bp, query_start, query_end, segment_count, count(*) over (partition by contig) as n from blk),
sup as (
  select a.contig, a.i as s, b.i as e, b.n, list_reduce(list(b.w) over g, lambda x, y: x + y) as one, first_value(b.i) over g as first, lead(b.i) over (partition by a.contig, a.i, b.ref, b.orientation order by b.i) as nxt
  from wb a join wb b on a.contig = b.contig and b.i >= a.i window g as (partition by a.contig, a.i, b.ref, b.orientation order by b.i rows unbounded preceding)),
cur as (select contig, s, unnest(range(e, coalesce(nxt, n))) as e, first, one from sup),
sums as (select contig, s, e, max(one) as most, list_reduce(list({{'t': one, 'c': 0::double}} order by first), lambda a, x: {{'t': a.t + x.t, 'c': a.c + case when abs(a.t) >= abs(x.t) then (a.t - (a.t + x.t)) + x.t else (x.t - (a.t + x.t)) + a.t end}}) as r
  from cur group by contig, s, e),
dl as materialized (select contig, e, list((r.t + r.c) - most order by s) as d from sums group by contig, e),
dp as (
  select contig, 0 as n, [{{'c': 0::double, 'k': 0::bigint, 's': 0::bigint}}] as b from wb group by contig
  union all
  select dp.contig, dp.n + 1, list_append(b, list_sort(list_transform(range(0, dp.n + 1), lambda s: {{'c': b[s + 1].c + dl.d[s + 1] + case when s > 0 then {FIX.auto_breakpoint_penalty_bp}::double else 0::double end,
    'k': b[s + 1].k + case when s > 0 then 1 else 0 end, 's': s}}))[1]) from dp join dl on dl.contig = dp.contig and dl.e = dp.n),
last as (select contig, n, b from dp where (contig, n) in (select contig, max(n) from dp group by contig)),
runs as (
  select contig, b, b[n + 1].s as a, cast(n as bigint) as z from last
  union all
  select contig, b, b[a + 1].s, a from runs where a > 0),
rb as (select r.contig, r.a, r.z, w.* exclude (contig), lead(ref || orientation) over (partition by r.contig, r.a order by i) as nxt from runs r join wb w on w.contig = r.contig and w.i >= r.a and w.i < r.z),
sg as (select contig, a, ref, orientation, row_number() over (partition by contig, a order by list_reduce(list(w order by i), lambda x, y: x + y) desc, sum(aligned_bp) desc, min(i)) as n, cast(sum(aligned_bp) as bigint) as aligned_bp, sum(identity_bp) / sum(aligned_bp) as avg_identity from rb group by contig, a, ref, orientation),
auto as (
  select contig, cast(row_number() over (partition by contig order by a) - 1 as integer) as part, sg.ref, sg.orientation, sg.avg_identity, x.query_start, x.query_end, sg.aligned_bp, x.segment_count, x.blocks, x.changes, x.first_start, x.last_end
  from (select contig, a, min(query_start) as query_start, max(query_end) as query_end, cast(sum(segment_count) as bigint) as segment_count, count(*) as blocks, count(*) filter (where nxt <> ref || orientation) as changes,
    arg_min(query_start, i) as first_start, arg_max(query_end, i) as last_end from rb group by contig, a) x join sg using (contig, a) where sg.n = 1)"""
_GROUP_COLUMNS = ["contig", "part", "ref", "orientation", "query_start", "query_end", "aligned_bp", "segment_count", "blocks", "changes"]


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@query(_recursive(_sql(BLOCK_SQL, _SEGMENTATION, select=f"select {', '.join(_GROUP_COLUMNS)} from auto")))
def auto_segmentation(spark, sf_dir):
    groups = segment.segment_groups(_blocks(spark, sf_dir), FIX.auto_breakpoint_penalty_bp)
    return groups.select(*_GROUP_COLUMNS)


def _explicit(spark, sf_dir):
    """Contigs asked for by name: some with segments, one that doesn't exist, and all without segments."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("ord"), F.concat(F.lit("c"), (F.col("r_regionkey") * 2).cast("string")).alias("name"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("ord"), F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("name"))
    return r.unionByName(n)


_PLANS = f"""given as (select cast(r_regionkey as bigint) as ord, 'c' || cast(r_regionkey * 2 as varchar) as name from region union all select n_nationkey + 100, 'u' || cast(n_nationkey as varchar) from nation),
signal as (select contig, count(*) as n_blocks, count(distinct ref || orientation) > 1 as has_signal from blk group by contig),
req as (select name, 0 as part, ord, false as smooth from given
  union all select c.name, 1, c.ord, true from contigs c join signal on signal.contig = c.name where has_signal and c.name not in (select name from given)),
r as (select req.*, c.length, coalesce(n_blocks, 0) as n_blocks, coalesce(has_signal, false) as has_signal from req left join contigs c on c.name = req.name left join signal on signal.contig = req.name),
grp as (
  select contig, part, r.smooth, ref, orientation, avg_identity, segment_count, aligned_bp, query_start, query_end, changes, first_start, last_end from auto join (select name, smooth from r where smooth and length is not null and n_blocks > 1) r on r.name = contig
  union all
  select contig, block_no, r.smooth, ref, orientation, identity_bp / aligned_bp, segment_count, aligned_bp, query_start, query_end, 0, query_start, query_end from blk join (select name, smooth from r where not smooth and length is not null and n_blocks > 1 and has_signal) r on r.name = contig),
gc as (select *, greatest(0, (last_end + lead(first_start) over (partition by contig order by part)) // 2) as cut, lead(part) over (partition by contig order by part) as nxt from grp),
gs as (select *, greatest(0, least(coalesce(lag(cut) over (partition by contig order by part), 0), {CONTIG_LENGTH})) as a, greatest(0, least(case when nxt is null then {CONTIG_LENGTH} else cut end, {CONTIG_LENGTH})) as z from gc),
gsum as (select contig, count(*) as n_groups, cast(sum(changes) as bigint) as changes, count(*) filter (where z - a >= {FIX.min_piece_bp}) as n_pieces,
  bool_or(smooth and (aligned_bp < {FIX.auto_min_piece_aligned_bp} or (query_end - query_start) / {CONTIG_LENGTH}.0 < {FIX.auto_min_piece_query_frac})) as weak from gs group by contig),
plans as (select r.*, n_groups, changes, coalesce(n_pieces, 0) as n_pieces,
  case when length is null then 'target_missing' when n_blocks = 0 then 'not_split_no_alignment' when n_blocks = 1 then 'not_split_single_block' when not has_signal then 'not_split_single_target'
    when smooth and (n_groups < 2 or weak) then 'not_split_auto_smooth' when coalesce(n_pieces, 0) < 2 then 'not_split_short_piece' else 'split' end as status
  from r left join gsum on gsum.contig = r.name)"""


def _plans(spark, sf_dir):
    c, b = contigs(spark, sf_dir), stored(_blocks(spark, sf_dir), "blocks")
    requested = segment.requested_contigs(_explicit(spark, sf_dir), c, b, FIX)
    return segment.plan_splits(requested, c.select(F.col("name").alias("contig"), "length"), b, FIX)


@query(_recursive(_sql(BLOCK_SQL, _SEGMENTATION, _PLANS, select="select name, part, ord, status, n_pieces, n_blocks, n_groups, changes from plans")))
def auto_split_plans(spark, sf_dir):
    return _plans(spark, sf_dir)[0].select("name", "part", "ord", "status", "n_pieces", "n_blocks", "n_groups", "changes")


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.unix_date(F.to_date("o_orderdate"))
    return o.select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("ref"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("name"), day.cast("bigint").alias("ref_start"), (day + 2).cast("bigint").alias("ref_end"), F.substring("o_orderpriority", 3, 4).alias("seq"))


_ORDERS = "o as (select 'k' || cast(o_custkey as varchar) as ref, o_orderkey as ord, cast(o_orderkey as varchar) as name, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as ref_start, substr(o_orderpriority, 3, 4) as seq from orders), l as (select *, lag(ref_start) over (partition by ref order by ord) + 2 as left_end, lag(name) over (partition by ref order by ord) as left_name from o)"


@query(_sql(_ORDERS, select="select ref as scaffold, left_name as left_contig, name as right_contig, ref_start - left_end - 1 as raw_inferred_gap_bp, greatest(0, ref_start - left_end - 1) as gap_bp from l where left_name is not null"))
def scaffold_gaps(spark, sf_dir):
    return scaffold.gaps(_orders(spark, sf_dir)).select("scaffold", "left_contig", "right_contig", "raw_inferred_gap_bp", "gap_bp")


@query(_sql(_ORDERS, select="select ref as scaffold, count(*) as contigs, cast(sum(length(seq)) as bigint) as sequence_bp, string_agg(case when left_name is null then '' else 'NNN' end || seq, '' order by ord) as seq, string_agg(name, ',' order by ord) as ordered_contigs from l group by ref"))
def scaffold_sequence(spark, sf_dir):
    return scaffold.scaffolds(_orders(spark, sf_dir), fixed=3).select("scaffold", "contigs", "sequence_bp", "seq", "ordered_contigs")


@query("select cast(o_orderkey as varchar) as name from orders where o_orderkey not in (select l_orderkey from lineitem)")
def scaffold_anti_checks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("name"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("new_name"))
    return scaffold.missing_names(li, wanted).select("name")


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"select doc_id, reverse(translate(regexp_replace(text, '[^ -~\\n]', '', 'g'), '{fn.IUPAC}', '{fn.COMPLEMENT}')) as seq from documents")
def reverse_complement(spark, sf_dir):
    plain = F.regexp_replace("text", r"[^ -~\n]", "")
    return _texts(spark, sf_dir).select("doc_id", fn.reverse_complement(plain).alias("seq"))


@query("select doc_id, substring(text, length(text) // 4 + 1, length(text) - length(text) // 2) as part from documents")
def slices(spark, sf_dir):
    """Each text from its first quarter on, half as long as it is."""
    n = F.length("text")
    start = F.floor(n / 4)
    return _texts(spark, sf_dir).select("doc_id", fn.slice_of(F.col("text"), start, start + n - F.floor(n / 2)).alias("part"))


@query("select doc_id, regexp_replace(replace(text, chr(10), ' '), '(.{1,80})', '\\1' || chr(10), 'g') as wrapped from documents")
def wrap80(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", fn.wrapped(F.replace("text", F.lit("\n"), F.lit(" "))).alias("wrapped"))


@query("select p_partkey, case when i < 26 then chr(cast(97 + i as integer)) when i < 702 then chr(cast(97 + (i - 26) // 26 as integer)) || chr(cast(97 + (i - 26) % 26 as integer)) else chr(cast(97 + (i - 702) // 676 as integer)) || chr(cast(97 + ((i - 702) // 26) % 26 as integer)) || chr(cast(97 + (i - 702) % 26 as integer)) end as label from (select p_partkey, p_partkey % 18000 as i from part)")
def piece_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.alpha_label(F.col("p_partkey") % 18000).alias("label"))


@query("select trim(role) as name, min(conv_id * 1000 + turn) as ord from conversations where trim(role) <> '' group by trim(role)")
def requested_dedup(spark, sf_dir):
    """Names asked for, in the order of their first place; here the roles of all turns."""
    from ..sources.readers import distinct_names

    return distinct_names(table(spark, sf_dir, "conversations").select(F.col("role").alias("value"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord")))


@query("select 0 as part, n_nationkey as ord, n_name as name from nation union all select 1, r_regionkey, r_name from region")
def ordered_union(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.lit(0).alias("part"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"))
    return n.unionByName(table(spark, sf_dir, "region").select(F.lit(1).alias("part"), F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name")))


@query("""with t as (select (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey as ord, l_orderkey as a, l_partkey as b, cast(l_quantity as bigint) as q from lineitem)
select ord, 'r' || cast(b % 7 as varchar) as ref, 'c' || cast(a % 50 as varchar) as query, a + 1 as ref_start, a + q as ref_end, b + 1 as query_start, b + q as query_end, '+' as orientation, 99.5 as identity from t""")
def parsed_coords(spark, sf_dir):
    """Coords lines in both layouts, written from lineitem and parsed again; every seventh is damaged on its way in a copy that must drop out."""
    from ..sources.readers import parse_coords

    q, a, b = F.col("l_quantity").cast("bigint"), F.col("l_orderkey"), F.col("l_partkey")
    li = table(spark, sf_dir, "lineitem")
    names = [F.concat(F.lit("r"), (b % 7).cast("string")), F.concat(F.lit("c"), (a % 50).cast("string"))]
    bar = F.lit("|")
    piped = F.concat_ws("  ", a + 1, a + q, bar, b + 1, b + q, bar, q, q, bar, F.lit("99.50"), bar, F.lit(30000), F.lit(9000), bar, F.lit("1.0"), F.lit("2.0"), bar, *names)
    plain = F.concat_ws("\t", a + 1, a + q, b + 1, b + q, q, q, F.lit("99.50"), F.lit(30000), F.lit(9000), *names)
    line = F.when(F.col("l_linenumber") % 2 == 0, piped).otherwise(plain)
    ord_ = ((a * 8 + F.col("l_linenumber")) * 1_000_000 + b).cast("bigint")
    lines = li.select(ord_.alias("ord"), line.alias("value"))
    damaged = lines.filter("ord % 7 = 0").select("ord", F.concat(F.lit("x"), "value").alias("value"))
    return parse_coords(lines.unionByName(damaged)).select("ord", "ref", "query", "ref_start", "ref_end", "query_start", "query_end", "orientation", "identity")
