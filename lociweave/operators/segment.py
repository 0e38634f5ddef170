"""Splitting contigs: groups of blocks by penalised segmentation, then pieces and plans."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.sequence import alpha_label, boundary, ratio
from .blocks import split_signals


@dataclass(frozen=True)
class FixOptions:
    min_segment_bp: int = 10_000
    min_segment_idy: float = 0.0
    max_merge_gap: int = 1_000
    min_piece_bp: int = 1
    auto: bool = False
    auto_sensitive: bool = False
    auto_breakpoint_penalty_bp: float = 50_000.0
    auto_min_piece_aligned_bp: int = 50_000
    auto_min_piece_query_frac: float = 0.01
    name_separator: str = "-"
    orient_to_reference: bool = False


class Support:
    """Weight of each (reference, strand) among consecutive blocks, added one by one."""

    def __init__(self) -> None:
        self.by: dict[tuple[str, str], list] = {}  # weighted, aligned, identity, first block
        self.n = 0

    def add(self, b) -> None:
        s = self.by.setdefault((b.ref, b.orientation), [0.0, 0, 0.0, self.n])
        s[0] += b.identity_bp / 100.0
        s[1] += int(b.aligned_bp)
        s[2] += b.identity_bp
        self.n += 1

    def dominant(self) -> tuple[str, str]:
        return max(self.by, key=lambda k: (self.by[k][0], self.by[k][1], -self.by[k][3]))

    def discordant(self) -> float:
        return sum(s[0] for s in self.by.values()) - self.by[self.dominant()][0]


#: Costs are first compared in whole millionths of a base.
UNIT = 1_000_000


def _whole(x: float) -> int:
    return round(min(x * UNIT, 1e18))


class Level:
    """Signatures that stand alike: what the best segmentation costs if one of them is the last run's dominant one, and where that run may start."""

    __slots__ = ("cost", "starts", "members", "into")

    def __init__(self, cost: int, starts: list[int], members: int):
        self.cost, self.starts, self.members = cost, starts, members
        self.into: Level | None = None

    def now(self) -> Level:
        """The level that this one has been merged into."""
        level = self
        while level.into is not None:
            level = level.into
        if self.into is not None and self.into is not level:
            self.into = level
        return level


class Weights:
    """Weight of each signature from a start on, in the blocks' order; added up when it is asked for."""

    __slots__ = ("sums", "upto", "levels")

    def __init__(self, start: int) -> None:
        self.sums: dict[int, float] = {}
        self.upto = start
        self.levels = 0  # that hold the start

    def discordant(self, signatures: list[int], weights: list[float]) -> float:
        sums, n = self.sums, len(signatures)
        for k in range(self.upto, n):
            h = signatures[k]
            sums[h] = sums.get(h, 0.0) + weights[k]
        self.upto = n
        return sum(sums.values()) - max(sums.values())


class RunningCuts:
    """Runs of blocks with the least discordant weight plus a penalty for each cut, block by block.

    A run costs its weight less its heaviest signature's, so the best cost at an end is the least, over signatures,
    of what it costs if that one is the last run's.  A block adds its weight to all of these but its own signature's,
    and none is ever more than the best with a new cut.  So levels are kept in order of cost, less the weight of all
    blocks; a block moves its signature to a level of its own, and the levels above the best with a new cut become
    one.  A block adds two levels at most, and merging takes away what was added before.

    Whole numbers tell which starts come into question; of starts that cost the same but for rounding, decimals added
    up in the blocks' order decide, then fewer cuts, then the earliest start."""

    def __init__(self, penalty: float, slack: int):
        self.penalty, self.whole_penalty, self.slack = penalty, _whole(penalty), slack
        self.rest = Level(0, [0], 1)  # of all signatures that haven't come
        self.levels, self.of = [self.rest], {}
        self.came, self.cuts, self.cost = [0], [0], [0.0]
        self.blocks: tuple[list[int], list[float]] = ([], [])
        self.weights = {0: Weights(0)}
        self.weights[0].levels = 1

    def _hold(self, level: Level, start: int) -> None:
        level.starts.append(start)
        self.weights.setdefault(start, Weights(start)).levels += 1

    def _drop(self, level: Level) -> None:
        for s in level.starts:
            w = self.weights[s]
            w.levels -= 1
            if not w.levels:
                del self.weights[s]

    def add(self, signature: int, weight: float) -> None:
        whole = _whole(weight)
        self.blocks[0].append(signature)
        self.blocks[1].append(weight)
        before = self.of.get(signature, self.rest).now()
        own = Level(before.cost - whole, list(before.starts), 1)
        for s in own.starts:
            self.weights[s].levels += 1
        if signature in self.of:
            before.members -= 1
            if not before.members:
                self.levels.remove(before)
                self._drop(before)
        self.of[signature] = own
        insort(self.levels, own, key=lambda x: x.cost)
        end = len(self.came)
        least = self.levels[0].cost
        best = None
        near = [x for x in takewhile(lambda x: x.cost <= least + self.slack, self.levels)]
        for start in near[0].starts if len(near) == 1 else sorted({s for x in near for s in x.starts}):
            found = (self.cost[start] + self.weights[start].discordant(*self.blocks) + (self.penalty if start else 0.0), self.cuts[start] + (1 if start else 0), start)
            if best is None or found < best:
                best = found
        self.cost.append(best[0])
        self.cuts.append(best[1])
        self.came.append(best[2])
        limit = least + self.whole_penalty
        merged = None
        while self.levels and self.levels[-1].cost > limit + self.slack:
            level = self.levels.pop()
            merged = merged or Level(limit, [], 0)
            merged.members += level.members
            level.into = merged
            self._drop(level)
        for level in reversed(self.levels):
            if level.cost < limit - self.slack:
                break
            self._hold(level, end)
        if merged is not None:
            self._hold(merged, end)
            insort(self.levels, merged, key=lambda x: x.cost)


def least_cuts(signature: list[int], weight: list[float], penalty: float) -> np.ndarray:
    """For each end of a run of blocks where the last run of its best segmentation starts (index 0 is unused)."""
    # what the rounding of weights to whole numbers comes to at most, and that of sums with all likelihood
    slack = len(weight) + 2 + _whole(sum(weight) * (len(weight) ** 0.5 + 16) * 2.0**-51)
    cuts = RunningCuts(penalty, slack)
    for h, w in zip(signature, weight, strict=True):
        cuts.add(h, w)
    return np.array(cuts.came)


def runs_of(came: np.ndarray) -> list[tuple[int, int]]:
    """The runs [start, end) of the whole's best segmentation."""
    runs, end = [], len(came) - 1
    while end:
        runs.append((int(came[end]), end))
        end = int(came[end])
    return runs[::-1]


def best_cuts(blocks: list, penalty: float) -> list[tuple[int, int]]:
    """Runs [start, end) of blocks with the least discordant weight plus penalty for each cut."""
    codes: dict[tuple[str, str], int] = {}
    signature = [codes.setdefault((b.ref, b.orientation), len(codes)) for b in blocks]
    return runs_of(least_cuts(signature, [b.identity_bp / 100.0 for b in blocks], penalty))


class ContigBlocks:
    """The blocks of one contig, as they come: a few numbers each."""

    def __init__(self, contig: str):
        self.contig = contig
        self.codes: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        refs, strands = batch.column("ref").to_pylist(), batch.column("orientation").to_pylist()
        signature = np.array([self.codes.setdefault(k, len(self.codes)) for k in zip(refs, strands, strict=True)], np.int64)
        self.parts.append((signature, *(batch.column(c).to_numpy(zero_copy_only=False) for c in _NUMBERS)))

    def groups(self, penalty: float) -> pa.RecordBatch:
        """A row of schemas.GROUPS for each run: ranges over all its blocks, support of its dominant signature."""
        signature, start, end, aligned, identity, segments = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        edges = runs_of(least_cuts(signature.tolist(), (identity / 100.0).tolist(), penalty))
        first = np.array([a for a, _ in edges])
        run = np.repeat(np.arange(len(edges)), [z - a for a, z in edges])
        # supports of each run's signatures, in the order in which they come; sums go from block to block
        key = run * len(self.codes) + signature
        seen, at, of = np.unique(key, return_index=True, return_inverse=True)
        weighted, identities, bases = (np.bincount(of, weights=x, minlength=len(seen)) for x in (identity / 100.0, identity, aligned))
        order = np.argsort(at, kind="stable")
        owner = run[at[order]]
        bounds = np.append(np.searchsorted(owner, np.arange(len(edges))), len(owner)).tolist()
        names = list(self.codes)
        changed = np.append(False, (signature[1:] != signature[:-1]) & (run[1:] == run[:-1]))
        changes = np.add.reduceat(changed.astype(np.int64), first)
        low, high, count = np.minimum.reduceat(start, first), np.maximum.reduceat(end, first), np.add.reduceat(segments, first)
        rows = []
        for part, (a, z) in enumerate(edges):
            mine = order[bounds[part] : bounds[part + 1]].tolist()
            top = max(mine, key=lambda k: (weighted[k], bases[k], -at[k]))
            ref, strand = names[int(seen[top]) % len(self.codes)]
            discordant = sum(float(weighted[k]) for k in mine) - float(weighted[top])
            rows.append((self.contig, part, ref, strand, int(low[part]), int(high[part]), int(bases[top]), float(identities[top]), int(count[part]), int(start[a]), int(end[z - 1]), z - a, discordant, int(changes[part])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _GROUP_TYPES, strict=True)], _GROUP_NAMES)


_NUMBERS = ("query_start", "query_end", "aligned_bp", "identity_bp", "segment_count")
_GROUP_NAMES = [x.split()[0] for x in schemas.GROUPS.split(", ")]
_GROUP_TYPES = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}.get(x.split()[1], pa.int64()) for x in schemas.GROUPS.split(", ")]


def segment_groups(blocks: DataFrame, penalty: float) -> DataFrame:
    """Groups (schemas.GROUPS) of each contig's blocks, which are streamed in order.

    Each run depends on all blocks before it, so a contig is one task's work; its steps follow the blocks and the starts
    that come into question, and it holds a few numbers a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: ContigBlocks | None = None
        for batch in batches:
            names = batch.column("contig").to_pylist()
            a = 0
            while a < len(names):
                z = a + 1
                while z < len(names) and names[z] == names[a]:
                    z += 1
                if held is None or held.contig != names[a]:
                    if held is not None:
                        yield held.groups(penalty)
                    held = ContigBlocks(names[a])
                held.add(batch.slice(a, z - a))
                a = z
        if held is not None:
            yield held.groups(penalty)

    rows = blocks.repartition("contig").sortWithinPartitions("contig", "block_no")
    return rows.select("contig", "ref", "orientation", *_NUMBERS).mapInArrow(run, schemas.GROUPS)


def direct_groups(blocks: DataFrame) -> DataFrame:
    """Each block as a group of its own."""
    return blocks.select("contig", F.col("block_no").alias("part"), "ref", "orientation", "query_start", "query_end", "aligned_bp", "identity_bp", "segment_count", F.col("query_start").alias("first_start"), F.col("query_end").alias("last_end"), F.lit(1).cast("bigint").alias("blocks"), F.lit(0.0).alias("discordant_bp"), F.lit(0).cast("bigint").alias("changes"))


def group_support(groups: DataFrame) -> DataFrame:
    """(contig, ref, orientation, weighted_bp, aligned_bp): support of each signature of a contig's blocks."""
    return groups.groupBy("contig", "ref", "orientation").agg((F.sum("identity_bp") / 100).alias("weighted_bp"), F.sum("aligned_bp").alias("aligned_bp"))


def pieces_of(groups: DataFrame, lengths: DataFrame, o: FixOptions) -> DataFrame:
    """Slices of contigs, one a group, that are long enough; a dropped slice leaves its number unused.

    lengths: (contig, length)."""
    by = Window.partitionBy("contig").orderBy("part")
    g = groups.join(lengths, "contig")
    g = g.withColumn("cut", boundary(F.col("last_end"), F.lead("first_start").over(by)))
    low, high = F.coalesce(F.lag("cut").over(by), F.lit(0)), F.when(F.lead("part").over(by).isNotNull(), F.col("cut")).otherwise(F.col("length"))
    g = g.withColumn("slice_start", F.greatest(F.lit(0), F.least(low, F.col("length")))).withColumn("slice_end", F.greatest(F.lit(0), F.least(high, F.col("length"))))
    g = g.filter(F.col("slice_end") - F.col("slice_start") >= o.min_piece_bp)
    name = F.concat_ws(o.name_separator, "ref", "contig", alpha_label(F.col("part")))
    turned = (F.col("orientation") == "-") if o.orient_to_reference else F.lit(False)
    return g.select(
        "contig",
        name.alias("new_name"),
        (F.col("part") + 1).alias("part_index"),
        "ref",
        "slice_start",
        "slice_end",
        F.col("query_start").alias("align_start"),
        F.col("query_end").alias("align_end"),
        "orientation",
        ratio(F.col("identity_bp"), F.col("aligned_bp")).alias("avg_identity"),
        "segment_count",
        turned.alias("reverse_complemented"),
    )


def requested_contigs(explicit: DataFrame, records: DataFrame, blocks: DataFrame, o: FixOptions) -> DataFrame:
    """(name, ord, explicit): names given, in their order, then with auto those that show a split, in FASTA order."""
    given = explicit.select("name", F.lit(0).alias("part"), "ord", F.lit(True).alias("explicit"))
    if not o.auto:
        return given
    found = split_signals(blocks).filter("has_signal").select(F.col("contig").alias("name"))
    auto = records.select("name", "ord").join(found, "name", "left_semi").join(explicit.select("name"), "name", "left_anti")
    return given.unionByName(auto.select("name", F.lit(1).alias("part"), "ord", F.lit(False).alias("explicit")))


# The texts of reports.
NO_ALIGNMENT = "No passing alignment segments were found for this requested contig."
SINGLE_BLOCK = "Only one passing alignment block was found."
SINGLE_TARGET = "All passing alignment blocks map to the same reference sequence and orientation."
SHORT = "Fewer than two split pieces passed the minimum piece length."
SHORT_AUTO = "Fewer than two auto split pieces passed the minimum piece length."
MISSING = "Requested contig was not found in the assembly FASTA."
SPLIT = "{} query-ordered pieces inferred from {} alignment blocks."
SPLIT_AUTO = "{} auto pieces inferred from {} alignment blocks after smoothing {} weak transition(s) with breakpoint penalty {:.1f}."
SMOOTH = "Auto smoothing retained one piece: discordant support ({:.1f} identity-weighted bp) did not overcome the breakpoint penalty ({:.1f})."
WEAK = "Auto smoothing rejected the best split because at least one piece had weak dominant support ({} aligned bp; required {})."


def plan_splits(requested: DataFrame, lengths: DataFrame, blocks: DataFrame, o: FixOptions) -> tuple[DataFrame, DataFrame]:
    """(plans, pieces) of the requested contigs.

    plans: (name, part, ord, status, n_pieces, n_blocks, changes, discordant_bp, weakest); pieces: of split contigs.
    lengths: (contig, length), a contig once."""
    r = requested.join(lengths.withColumnRenamed("contig", "name"), "name", "left").join(split_signals(blocks).withColumnRenamed("contig", "name"), "name", "left")
    r = r.withColumn("smooth", F.lit(o.auto and not o.auto_sensitive) & ~F.col("explicit"))
    r = r.withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
    able = r.filter("length is not null and n_blocks > 1 and has_signal")
    mine = blocks.join(able.select(F.col("name").alias("contig"), "smooth"), "contig")
    groups = direct_groups(mine.filter("not smooth")).unionByName(segment_groups(mine.filter("smooth").drop("smooth"), o.auto_breakpoint_penalty_bp))
    sums = groups.join(lengths, "contig").join(able.select(F.col("name").alias("contig"), "smooth"), "contig")
    span = ratio(F.col("query_end") - F.col("query_start"), F.col("length"))
    weak = F.col("smooth") & ((F.col("aligned_bp") < o.auto_min_piece_aligned_bp) | (span < o.auto_min_piece_query_frac))
    sums = sums.groupBy("contig").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("changes").alias("changes"), F.max("discordant_bp").alias("discordant_bp"), F.min(F.when(weak, F.col("aligned_bp"))).alias("weakest"))
    pieces = pieces_of(groups, lengths, o)
    counts = pieces.groupBy("contig").agg(F.count(F.lit(1)).alias("n_pieces"))
    p = r.join(sums.withColumnRenamed("contig", "name"), "name", "left").join(counts.withColumnRenamed("contig", "name"), "name", "left")
    status = (
        F.when(F.col("length").isNull(), "target_missing")
        .when(F.col("n_blocks") == 0, "not_split_no_alignment")
        .when(F.col("n_blocks") == 1, "not_split_single_block")
        .when(~F.col("has_signal"), "not_split_single_target")
        .when(F.col("smooth") & ((F.col("n_groups") < 2) | F.col("weakest").isNotNull()), "not_split_auto_smooth")
        .when(F.coalesce("n_pieces", F.lit(0)) < 2, "not_split_short_piece")
        .otherwise("split")
    )
    plans = p.select("name", "part", "ord", status.alias("status"), "smooth", F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"), "n_blocks", "n_groups", "changes", "discordant_bp", "weakest")
    return plans, pieces.join(plans.filter("status = 'split'").select(F.col("name").alias("contig")), "contig", "left_semi")


def reason(plan, o: FixOptions) -> str:
    """The report's reason for one plan row."""
    s = plan["status"]
    if s == "target_missing":
        return MISSING
    if s == "not_split_no_alignment":
        return NO_ALIGNMENT
    if s == "not_split_single_block":
        return SINGLE_BLOCK
    if s == "not_split_single_target":
        return SINGLE_TARGET
    if s == "not_split_short_piece":
        return SHORT_AUTO if plan["smooth"] else SHORT
    if s == "not_split_auto_smooth":
        if plan["n_groups"] < 2:
            return SMOOTH.format(plan["discordant_bp"], o.auto_breakpoint_penalty_bp)
        return WEAK.format(plan["weakest"], o.auto_min_piece_aligned_bp)
    if plan["smooth"]:
        return SPLIT_AUTO.format(plan["n_pieces"], plan["n_blocks"], plan["changes"], o.auto_breakpoint_penalty_bp)
    return SPLIT.format(plan["n_pieces"], plan["n_blocks"])
