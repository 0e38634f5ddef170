"""Hard negatives by angular triangle filtering.

Vectors are scaled to integers; a row's score is its integer inner product with
the anchor.  An anchor's positives are its best rows of the same label; for
each positive, the negatives are the best rows of other labels whose scores lie
in a window below the positive's.

1. ``prepared`` stores for each vector its integers, its norm and its angles to
   a few reference directions (chosen on a bounded sample; any directions give
   right results).
2. Two vectors' angle lies between the difference and the sum of their angles
   to each reference.  The cosines of these, times both norms and widened for
   rounding, bound the score from both sides.
3. Rows sorted by label and angle are packed into blocks, anchors too.  Each
   block of anchors meets each block of rows in one task; whole blocks, and
   rows in them, whose bounds miss what an anchor still looks for are passed
   over.  Only the rest is scored, in exact integers.  A task keeps the best
   few of its rows for each anchor, and a window ranks those of all tasks.

The set of anchors is stated (every ``every``-th key), so no pairs of rows are
made: what is shuffled is each row once, and the anchors once a slice of rows.

Rows with a null key, label or vector, or with a null or non-finite component,
take no part, nor do those whose squared norm is over 2**62, as scores of 64
bits don't hold them.  Of rows with one key the smallest by label and vector
counts, so repeated rows count once.  Vectors of unlike lengths are filled up
with zeros; an empty vector scores 0.  Ties go to the smaller key.  An empty
table gives an empty result.  Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
#: Reference directions, and the sample they are chosen from.
REFERENCES, SAMPLE = 8, 2_000
#: Rows and anchors of a block, and bytes of its vectors.
BLOCK, ANCHORS, BLOCK_BYTES = 1_024, 512, 4 << 20
#: Rows that one task meets with all anchors, about, and slices of rows at least.
SLICE_ROWS, SLICES = 131_072, 16
#: Rounding of angles and cosines, as a part of both norms' product.
ROUNDING = 1e-7
_LARGEST = 1 << 62


def relabelled(key: Column, label: Column) -> Column:
    """The label; where the key is divisible by 7, the next of ten."""
    return F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)


def whole(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, v) of rows that take part, one a key."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{label}`").cast("long").alias("label"), v.alias("v")).dropna()
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    rows = rows.groupBy("key").agg(F.min(F.struct("label", "v")).alias("r"))
    return rows.select("key", relabelled(F.col("key"), F.col("r.label")).alias("label"), F.col("r.v").alias("v"))


def scaled(v: pa.Array) -> np.ndarray:
    """A row of integers for each vector, filled up with zeros; as floats, which hold them exactly if they are small enough."""
    size = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), max(1, int(size.max(initial=0)))))
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = np.floor(SCALE * v.flatten().to_numpy(zero_copy_only=False))
    return out


def chosen_references(rows: DataFrame, references: int = REFERENCES, sample: int = SAMPLE) -> np.ndarray:
    """Unit directions: of the first ``sample`` vectors by a hash of the key, one after another the one that is farthest in angle from those before."""
    first = rows.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toArrow().column(0).combine_chunks()
    first = first.chunk(0) if isinstance(first, pa.ChunkedArray) else first
    q = scaled(first)
    norm = np.sqrt((q * q).sum(axis=1))
    q = q[(norm > 0) & np.isfinite(norm)] / norm[(norm > 0) & np.isfinite(norm), None]
    if not len(q):
        return np.ones((1, 1))
    found, nearest = [0], np.full(len(q), -1.0)
    while len(found) < min(references, len(q)):
        nearest = np.maximum(nearest, np.abs(q @ q[found[-1]]))
        found.append(int(nearest.argmin()))
    return q[found]


_ROW = "key long, label long, first double, norm double, angles binary, q binary"


def prepared(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """_ROW of each row of ``whole``: norm, angles (first is the first of them) and integers of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = scaled(batch.column(2))
            square = (q * q).sum(axis=1)
            fit = square <= _LARGEST
            q, norm = np.where(fit[:, None], q, 0.0), np.sqrt(np.where(fit, square, 0.0))
            width = min(q.shape[1], references.shape[1])
            cosine = q[:, :width] @ references[:, :width].T / np.maximum(norm, 1e-300)[:, None]
            angles = np.arccos(np.clip(cosine, -1, 1))
            size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            ints = q.astype("<i4")
            packed = pa.array([ints[k, :n].tobytes() for k, n in enumerate(size.tolist())], pa.binary())
            kept = pa.array(fit)
            columns = [batch.column(0), batch.column(1), pa.array(angles[:, 0].copy()), pa.array(norm), pa.array([a.tobytes() for a in angles], pa.binary()), packed]
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in columns], ["key", "label", "first", "norm", "angles", "q"])

    return rows.select("key", "label", "v").mapInArrow(run, _ROW)


_BLOCK = "block long, label long, rows int, width int, keys binary, labels binary, norms binary, angles binary, q binary, more binary"


def packed(rows: DataFrame, most: int, by_label: bool, more: int = 0) -> DataFrame:
    """_BLOCK of up to ``most`` consecutive rows, of one label if by_label; more: integers of the column ``more`` that each row has."""
    names = [x.split()[0] for x in _BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId()) << 32
        held: list[tuple] = []
        held_bytes = 0

        def block() -> pa.RecordBatch:
            width = max(1, max(len(r[4]) for r in held) // 4)
            q = np.zeros((len(held), width), "<i4")
            for k, r in enumerate(held):
                q[k, : len(r[4]) // 4] = np.frombuffer(r[4], "<i4")
            ints = lambda k: np.array([r[k] for r in held], "<i8").tobytes()
            row = [number, held[0][1], len(held), width, ints(0), ints(1), np.array([r[2] for r in held], "<f8").tobytes(), b"".join(r[3] for r in held), q.tobytes(), np.array([r[5] for r in held], "<i8").tobytes() if more else b""]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6), strict=True)], names)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for r in zip(*columns, strict=True):
                if held and (len(held) == most or held_bytes > BLOCK_BYTES or (by_label and held[0][1] != r[1])):
                    yield block()
                    held, held_bytes, number = [], 0, number + 1
                held.append(r)
                held_bytes += len(r[4])
        if held:
            yield block()

    return rows.select("key", "label", "norm", "angles", "q", *(["more"] if more else [F.lit(None).cast("array<long>").alias("more")])).mapInArrow(run, _BLOCK)


class Block:
    """The arrays of one packed block."""

    def __init__(self, rows: int, width: int, keys: bytes, labels: bytes, norms: bytes, angles: bytes, q: bytes, more: bytes):
        self.keys, self.labels = np.frombuffer(keys, "<i8"), np.frombuffer(labels, "<i8")
        self.norms = np.frombuffer(norms, "<f8")
        angle = np.frombuffer(angles, "<f8").reshape(rows, -1)
        self.angle, self.cos, self.sin = angle, np.cos(angle), np.sin(angle)
        self.q = np.frombuffer(q, "<i4").reshape(rows, width)
        self.more = np.frombuffer(more, "<i8").reshape(rows, -1) if more else None


def score_bounds(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of each anchor (row) and each row of b (column)."""
    low, high = np.full((len(a.keys), len(b.keys)), -1.0), np.ones((len(a.keys), len(b.keys)))
    for r in range(a.cos.shape[1]):
        both, across = np.outer(a.cos[:, r], b.cos[:, r]), np.outer(a.sin[:, r], b.sin[:, r])
        np.minimum(high, both + across, out=high)  # cosine of the difference of the angles
        # beyond a half turn the sum turns back; its cosine is no bound there
        np.maximum(low, np.where(np.add.outer(a.angle[:, r], b.angle[:, r]) <= np.pi, both - across, -1.0), out=low)
    norms = np.outer(a.norms, b.norms)
    slack = ROUNDING * norms + 1
    return low * norms - slack, high * norms + slack


def block_bounds(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each anchor's scores with all of b at once, from b's least and largest angles and its largest norm."""
    near, far = b.angle.min(axis=0), b.angle.max(axis=0)
    apart = np.maximum(0, np.maximum(near - a.angle, a.angle - far))
    together = np.minimum(np.pi, a.angle + far)
    high, low = np.cos(apart).min(axis=1), np.cos(together).max(axis=1)
    norms = a.norms * b.norms.max(initial=0)
    slack = ROUNDING * norms + 1
    # a positive cosine is largest with the largest norm; a negative one with the least, 0 at least
    return np.minimum(low, 0) * norms - slack, np.maximum(high, 0) * norms + slack


def exact_scores(a: Block, b: Block, wanted: np.ndarray) -> np.ndarray:
    """Integer inner products where wanted (others may be anything): of the wanted pairs alone if they are few, else of all rows and anchors that have any."""
    width = min(a.q.shape[1], b.q.shape[1])
    out = np.zeros(wanted.shape, np.int64)
    rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if not len(rows):
        return out
    exact = float if a.norms.max() * b.norms.max() < 2.0**52 else np.int64
    x, y = a.q[:, :width].astype(exact), b.q[:, :width].astype(exact)
    if 8 * wanted.sum() < len(rows) * len(columns):
        i, k = np.nonzero(wanted)
        out[i, k] = np.einsum("ij,ij->i", x[i], y[k]).astype(np.int64)
    else:
        out[np.ix_(rows, columns)] = (x[rows] @ y[columns].T).astype(np.int64)
    return out


class Best:
    """For each of some lists the best few (score, key): higher scores first, then smaller keys."""

    def __init__(self, lists: int, most: int):
        self.most = most
        self.list, self.score, self.key = (np.zeros(0, np.int64) for _ in range(3))
        self.last = np.full(lists, np.iinfo(np.int64).min)  # what a newcomer's score must reach

    def add(self, lists: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        lists, scores, keys = np.concatenate([self.list, lists]), np.concatenate([self.score, scores]), np.concatenate([self.key, keys])
        order = np.lexsort((keys, -scores, lists))
        lists, scores, keys = lists[order], scores[order], keys[order]
        start = np.flatnonzero(np.append(True, lists[1:] != lists[:-1])) if len(lists) else np.zeros(0, np.int64)
        nth = np.arange(len(lists)) - np.repeat(start, np.diff(np.append(start, len(lists))))
        top = nth < self.most
        full = nth == self.most - 1
        self.last[lists[full]] = scores[full]
        self.list, self.score, self.key = lists[top], scores[top], keys[top]

    def add_matrix(self, scores: np.ndarray, good: np.ndarray, keys: np.ndarray, lists: np.ndarray) -> None:
        """Adds the good entries of a matrix; row i belongs to list lists[i]."""
        good = good & (scores >= self.last[lists][:, None])
        if good.shape[1] > self.most:  # of the good ones those that aren't below the row's own best few
            worst = np.iinfo(np.int64).min
            floor = np.partition(np.where(good, scores, worst), -self.most, axis=1)[:, -self.most]
            good &= scores >= floor[:, None]
        i, k = np.nonzero(good)
        self.add(lists[i], scores[i, k], keys[k])


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest integer scores n with LOW p <= 100 n <= HIGH p."""
    positive = positive.astype(np.int64)
    # 100 n >= 50 p and 100 n <= 95 p, without products that may not fit
    return -((-positive) // 2), positive + (-positive) // 20


class Positives:
    """The best rows of the anchors' label, other than the anchor."""

    schema = "anchor long, positive long, score long"

    def __init__(self, a: Block):
        self.a, self.best, self.scored = a, Best(len(a.keys), POSITIVES), 0

    def meet(self, b: Block) -> None:
        a, last = self.a, self.best.last.astype(float)
        seek = block_bounds(a, b)[1] >= last
        if not seek.any():
            return
        wanted = (score_bounds(a, b)[1] >= last[:, None]) & seek[:, None] & (a.keys[:, None] != b.keys[None, :]) & (a.labels[:, None] == b.labels[None, :])
        self.scored += int(wanted.sum())
        self.best.add_matrix(exact_scores(a, b, wanted), wanted, b.keys, np.arange(len(a.keys)))

    def result(self) -> list[np.ndarray]:
        return [self.a.keys[self.best.list], self.best.key, self.best.score]


class Negatives:
    """The best rows of other labels in the window of each of the anchors' positives."""

    schema = "anchor long, positive long, positive_score long, negative long, score long"

    def __init__(self, a: Block):
        self.a, self.scored = a, 0
        n = len(a.keys)
        has = a.more[:, 0]
        self.positive, self.positive_score = a.more[:, 1 : 1 + POSITIVES], a.more[:, 1 + POSITIVES :]
        there = np.arange(POSITIVES)[None, :] < has[:, None]
        low, high = window(self.positive_score)
        self.there = there & (low <= high)
        self.low, self.high = np.where(self.there, low, np.iinfo(np.int64).max), np.where(self.there, high, np.iinfo(np.int64).min)
        self.best = Best(n * POSITIVES, NEGATIVES)

    def meet(self, b: Block) -> None:
        a = self.a
        least = np.maximum(self.low, self.best.last.reshape(-1, POSITIVES)).astype(float)
        low, high = block_bounds(a, b)
        seek = ((high[:, None] >= least) & (low[:, None] <= self.high.astype(float)) & self.there).any(axis=1)
        if not seek.any():
            return
        other = (a.labels[:, None] != b.labels[None, :]) & seek[:, None]
        low, high = score_bounds(a, b)
        reach = np.zeros(other.shape, bool)
        for p in range(POSITIVES):
            reach |= (high >= least[:, p, None]) & (low <= self.high[:, p, None].astype(float)) & self.there[:, p, None]
        wanted = other & reach
        self.scored += int(wanted.sum())
        scores = exact_scores(a, b, wanted)
        for p in range(POSITIVES):
            inside = wanted & (scores >= self.low[:, p, None]) & (scores <= self.high[:, p, None])
            self.best.add_matrix(scores, inside, b.keys, np.arange(len(a.keys)) * POSITIVES + p)

    def result(self) -> list[np.ndarray]:
        i, p = self.best.list // POSITIVES, self.best.list % POSITIVES
        return [self.a.keys[i], self.positive[i, p], self.positive_score[i, p], self.best.key, self.best.score]


_FIELDS = ("rows", "width", "keys", "labels", "norms", "angles", "q", "more")


def met(anchors: DataFrame, rows: DataFrame, search: type, slots: int) -> DataFrame:
    """What search finds for each block of anchors among the blocks of rows of its slot; both sides have a column slot."""
    names = [x.split()[0] for x in search.schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, found = None, None
        result = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in found.result()], names)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for r in zip(*columns, strict=True):
                if r[0] != number:
                    if found:
                        yield result()
                    number, found = r[0], search(Block(*r[1:9]))
                found.meet(Block(*r[9:]))
        if found:
            yield result()

    left = anchors.select("slot", F.col("block").alias("a_block"), *[F.col(c).alias(f"a_{c}") for c in _FIELDS]).repartition(slots, "slot")
    right = rows.select("slot", *_FIELDS).repartition(slots, "slot")
    pairs = left.join(right, "slot").select("a_block", *[f"a_{c}" for c in _FIELDS], *_FIELDS)
    return pairs.mapInArrow(run, search.schema)


def in_all_slices(blocks: DataFrame, slices: int, by_label: bool) -> DataFrame:
    s = blocks.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return s.withColumn("slot", (F.col("label") if by_label else F.lit(0)) * slices + F.col("s"))


def mine(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors whose key is divisible by ``every``."""
    rows = stored(whole(vectors, key, vector, label), "vectors")
    table = stored(prepared(rows, chosen_references(rows)), "angles")
    ordered = table.repartitionByRange("label", "first", "key").sortWithinPartitions("label", "first", "key")
    blocks = stored(packed(ordered, BLOCK, by_label=True), "blocks")
    total = blocks.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    slices = max(SLICES, -(-total // SLICE_ROWS))
    here = F.pmod(F.xxhash64("block"), F.lit(slices))
    anchors = table.filter(F.col("key") % every == 0)
    by_label = stored(packed(anchors.repartitionByRange("label", "first", "key").sortWithinPartitions("label", "first", "key"), ANCHORS, by_label=True), "anchors")
    near = met(in_all_slices(by_label, slices, True), blocks.withColumn("slot", F.col("label") * slices + here), Positives, slices)
    rank = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive")
    near = near.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= POSITIVES)
    near = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "positive", "score"))).alias("p"))
    padded = lambda field: F.transform(F.sequence(F.lit(0), F.lit(POSITIVES - 1)), lambda k: F.coalesce(F.get("p", k)[field], F.lit(0).cast("long")))
    near = stored(near.select(F.col("anchor").alias("key"), F.concat(F.array(F.size("p").cast("long")), padded("positive"), padded("score")).alias("more")), "positives")
    armed = anchors.join(near, "key").repartitionByRange("first", "key").sortWithinPartitions("first", "key")
    armed = stored(packed(armed, ANCHORS, by_label=False, more=1 + 2 * POSITIVES), "armed")
    found = met(in_all_slices(armed, slices, False), blocks.withColumn("slot", here), Negatives, slices)
    rank = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "negative")
    found = found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= NEGATIVES)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
