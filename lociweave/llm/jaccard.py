"""N-gram Jaccard join by count vectors: which documents share most of their word shingles.

Shingles are hashed into GROUPS groups; a document is the point of its group
counts.  Two documents can't share more shingles than the sum of the smaller
coordinates, nor can any two below two nodes of an R-tree share more than the
sum of the smaller of the nodes' largest coordinates.  Pairs and nodes whose
bound is too low for the wanted similarity go; what is left is verified on the
shingle sets.

1. ``profiles``: each document's set size, a digest of the set, its point, and
   a prefix: the first n - ceil(s * n) + 1 of its n shingles in an order of the
   corpus.  Two documents with similarity s share a shingle of both prefixes.
   The order is by hash, with shingles that are frequent in a sample last; the
   sample moves work, never results.
2. Documents with equal sets become one class, so copies never meet in pairs.
   A class is 64 bits of a digest; where other 64 bits of it differ within a
   class, the class is split by them.
3. Classes that share a prefix shingle form a block.  In small blocks all
   points are compared.  In larger ones each point is first compared with a
   hub, the one with the most company; verified links make components; then only points outside
   the block's largest component meet the others, in bounded slices, through
   an R-tree over the slice.
4. Components of the verified links, in rounds.

Null and empty texts and texts without words have an empty set and no links.
Rows without key get no component and link with nothing; rows that share a key
are rows of their own.  A key may have any type that has an order, a struct too.  Repeated rows get equal results.  An empty
table gives an empty result.  Only the key and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kernels import Shared, blocks, column_texts, tidy
from .store import BROADCAST_KEYS, having, stored

GROUPS = 256
COARSE = 64
#: Blocks up to this size compare all points at once.
SMALL_BLOCK = 16
#: Points outside the largest component that one task holds.
SLICE = 1024
LEAF = 16
#: Rows of large blocks that one task works on, about; a block has no fewer.
TASK_ROWS = 8192
#: One document in so many counts for the order of shingles, and so many shingles at most are put last.
ORDER_SAMPLE, FREQUENT = 16, 1_000_000


def shingle_sets(texts, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    w = texts.words(lower=True)
    hashes, at = w.ngrams(words)
    full = np.bincount(w.owner[at], minlength=len(texts))
    ends = np.cumsum(full)
    short: dict[int, np.ndarray] = {}
    for n in range(1, words):
        h, first = w.ngrams(n)
        mine = w.counts[w.owner[first]] == n
        short |= {int(o): h[i : i + 1] for i, o in zip(np.flatnonzero(mine), w.owner[first[mine]], strict=True)}
    for i, (n, end) in enumerate(zip(full.tolist(), ends.tolist(), strict=True)):
        if n:
            h = np.sort(hashes[end - n : end])
            yield h[np.concatenate(([True], h[1:] != h[:-1]))]
        else:
            yield short.get(i, hashes[:0])


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1 if n else 0


def point(shingles: np.ndarray) -> bytes:
    """Group counts, in a byte each or, for very long texts, in four."""
    counts = np.bincount((shingles >> np.uint64(8)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else "<u4").tobytes()


def points(column: list[bytes], groups: int = GROUPS) -> np.ndarray:
    """A row for each point."""
    if all(len(x) == groups for x in column):
        return np.frombuffer(b"".join(column), np.uint8).reshape(-1, groups).astype(np.uint16)
    return np.stack([np.frombuffer(x, np.uint8 if len(x) == groups else "<u4").astype(np.uint32) for x in column])


def coarse_point(p: bytes) -> bytes:
    """The same for COARSE groups."""
    counts = coarse(points([p]))[0]
    return counts.astype(np.uint8 if counts.max() < 256 else "<u4").tobytes()


def coarse(p: np.ndarray) -> np.ndarray:
    return p.reshape(len(p), COARSE, -1).sum(axis=2, dtype=p.dtype)


def can_link(shared: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return (100 + percent) * shared.astype(np.int64) >= percent * (na + nb)


def _order(docs: DataFrame, key: str, text: str, words: int) -> np.ndarray:
    """Hashes of shingles that many documents of a sample have, sorted: at most 2000 times the mean set size, and FREQUENT."""
    sample = docs.filter(F.pmod(F.xxhash64(key), F.lit(ORDER_SAMPLE)) == 0).select(text)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for _, _, texts in blocks(column_texts(batch.column(0))):
                sets = list(shingle_sets(texts, words))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))], ["token"])

    least = max(8, sample.count() // 2000)
    seen = sample.mapInArrow(spread, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    seen = seen.orderBy(F.desc("n"), "token").limit(FREQUENT)
    return np.sort(seen.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))


PROFILE = "n_shingles long, node long, more long, point binary, prefix array<long>, known array<long>"


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two columns of 64 bits each of a digest of each set."""
    return np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)


def profiles(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(key, n_shingles, node, more, point, prefix, known) of each whole text; node and more are 64 bits each of a digest of its set.

    known is the part of the prefix that the task knows other sets to have, too; it isn't in prefix.

    A task gives point and prefix with a node's first row only (null with the others), and not for rows without key."""
    frequent = docs.sparkSession.sparkContext.broadcast(_order(docs, key, text, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        met: set[tuple[int, int]] = set()
        none = np.zeros(0, np.uint64)
        shared = Shared()
        for batch in tidy(batches):
            keyed = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for i, j, texts in blocks(column_texts(batch.column(1))):
                sizes, places, prefixes = [], [], []
                sets = list(shingle_sets(texts, words))
                nodes = digests(sets)
                for k, s in enumerate(sets):
                    n, node = len(s), (int(nodes[k, 0]), int(nodes[k, 1]))
                    sizes.append(n)
                    if node in met or not n or not keyed[i + k]:
                        places.append(None)
                        prefixes.append(none)
                        continue
                    met.add(node)
                    places.append(point(s))
                    if len(late) and n:
                        at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                        hot = late[at] == s
                        if hot.any():
                            s = np.concatenate([s[~hot], s[hot]])
                    prefixes.append(s[: prefix_length(n, percent)])
                owner = np.repeat(np.arange(len(prefixes)), [len(x) for x in prefixes])
                flat = np.concatenate(prefixes) if prefixes else none
                sure = shared.marks(flat, owner)
                lists = []
                for part in (~sure, sure):
                    ends = np.append(0, np.cumsum(np.bincount(owner[part], minlength=len(prefixes)))).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[part].view(np.int64))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(nodes[:, 0].copy()), pa.array(nodes[:, 1].copy()), pa.array(places, pa.binary()), *lists], ["key", "n_shingles", "node", "more", "point", "prefix", "known"])

    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, " + PROFILE)


def split_classes(rows: DataFrame, clash: DataFrame | None) -> DataFrame:
    """rows (with node and more) in which a class in clash (node) is split by its further bits."""
    if clash is None:
        return rows
    split = rows.join(F.broadcast(clash.select(F.col("node").alias("_clash"))), F.col("node") == F.col("_clash"), "left")  # a handful of 10 billion sets
    return split.withColumn("node", F.when(F.col("_clash").isNotNull(), F.xxhash64("node", "more")).otherwise(F.col("node"))).drop("_clash")


def sharing(profile: DataFrame) -> DataFrame:
    """(token, node, n) of the prefixes whose token several classes have.

    Rows of tokens that are known to be shared are salted, so no token brings all its rows together in one task."""
    rows = profile.select(F.explode("prefix").alias("token"), "node", F.col("n_shingles").alias("n"), F.lit(0).alias("salt"))
    known = profile.select(F.explode("known").alias("token"), "node", F.col("n_shingles").alias("n"), (1 + F.pmod(F.xxhash64("node"), F.lit(1023))).cast("int").alias("salt"))
    by_token = Window.partitionBy("token", "salt")
    rows = rows.unionByName(known).withColumn("shared", (F.col("salt") > 0) | (F.min("node").over(by_token) != F.max("node").over(by_token)))
    return rows.filter("shared").select("token", "node", "n")


_PAIR = "a long, b long"


def _emit(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _block_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches joined and cut so that each has whole blocks (first column), or a block that alone is larger than most."""
    rest = None
    for batch in tidy(batches):
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows < most:
            continue
        tokens = rest.column(0).to_numpy()
        edge = np.flatnonzero(tokens[1:] != tokens[:-1])
        if len(edge):
            yield rest.slice(0, int(edge[-1]) + 1)
            rest = rest.slice(int(edge[-1]) + 1)
    if rest is not None and rest.num_rows:
        yield rest


def small_block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs in small blocks whose points could link; rows (token, node, n, point), sorted by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _block_rows(batches, 4000):
            token, node, n = (t.column(k).to_numpy() for k in range(3))
            p = points(t.column(3).to_pylist(), COARSE)
            a, b = [], []
            for d in range(1, SMALL_BLOCK):
                i = np.flatnonzero(token[:-d] == token[d:])
                if not len(i):
                    break
                lo, hi = np.minimum(n[i], n[i + d]), np.maximum(n[i], n[i + d])
                i = i[100 * lo >= percent * hi]
                i = i[can_link(np.minimum(p[i], p[i + d]).sum(axis=1), n[i], n[i + d], percent)]
                a.append(node[i])
                b.append(node[i + d])
            yield _emit(a, b)

    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, _PAIR)


def hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """In each larger block, pairs of its hub with the others of like size.

    The hub is the class with the most company over all its blocks (ties: the smallest), found by an aggregate."""
    hub = rows.groupBy("token").agg(F.max(F.struct("degree", "node", "n")).alias("h")).select("token", F.col("h")["node"].alias("hub"), F.col("h")["n"].alias("hub_n"))
    pairs = rows.join(hub, "token").filter("node != hub").filter(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


class RTree:
    """Points packed into leaves by size and nearness; a node keeps the largest coordinates and the least size below it."""

    def __init__(self, p: np.ndarray, n: np.ndarray):
        half = coarse(p)
        self.order = np.lexsort((half[:, 0] + half[:, 1], n // np.maximum(1, n // 8)))
        self.p, self.n = p[self.order], n[self.order]
        edges = np.arange(0, len(n), LEAF)
        self.leaf = (np.maximum.reduceat(half[self.order], edges, axis=0), np.minimum.reduceat(self.n, edges), np.maximum.reduceat(self.n, edges))
        tops = np.arange(0, len(edges), LEAF)
        self.top = (np.maximum.reduceat(self.leaf[0], tops, axis=0), np.minimum.reduceat(self.leaf[1], tops), np.maximum.reduceat(self.leaf[2], tops))

    @staticmethod
    def _under(nodes, which: np.ndarray, q: np.ndarray, m: int, percent: int) -> np.ndarray:
        high, least, most = nodes
        which = which[(100 * most[which] >= percent * m) & (100 * m >= percent * least[which])]
        return which[can_link(np.minimum(high[which], q).sum(axis=1), least[which], m, percent)]

    def search(self, q: np.ndarray, m: int, percent: int) -> np.ndarray:
        """Indexes of points that could link with point q of size m."""
        half = coarse(q[None])[0]
        tops = self._under(self.top, np.arange(len(self.top[1])), half, m, percent)
        leaves = (tops[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaves = self._under(self.leaf, leaves[leaves < len(self.leaf[1])], half, m, percent)
        at = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.n)]
        at = at[(100 * self.n[at] >= percent * m) & (100 * m >= percent * self.n[at])]
        return self.order[at[can_link(np.minimum(self.p[at], q).sum(axis=1), self.n[at], m, percent)]]

    def join(self, q: np.ndarray, m: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs that could link, for many queries; a tree of few leaves is read leaf by leaf for all at once."""
        if len(self.n) > 8 * LEAF:
            hits = [self.search(x, int(k), percent) for x, k in zip(q, m, strict=True)]
            return np.repeat(np.arange(len(q)), [len(x) for x in hits]), np.concatenate(hits)
        i, j = np.nonzero((100 * np.minimum(m[:, None], self.n) >= percent * np.maximum(m[:, None], self.n)))
        half, own = coarse(q), coarse(self.p)
        for a, b in ((half, own), (q, self.p)):
            keep = np.concatenate([can_link(np.minimum(a[i[k : k + 8192]], b[j[k : k + 8192]]).sum(axis=1), m[i[k : k + 8192]], self.n[j[k : k + 8192]], percent) for k in range(0, len(i), 8192)] or [np.zeros(0, bool)])
            i, j = i[keep], j[keep]
        return i, self.order[j]


#: Pairs that a task remembers having given, to give them once.
REMEMBERED = 1 << 18


def outside_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """In larger blocks, pairs of a point outside the block's largest component with one of another component.

    rows: (block, first, outside, node, n, root, point), where a block is a slice of a token's block and ``first``
    marks the slice's own points, which form its R-tree; ``outside`` marks all points outside.  Of two such points
    the smaller one's slice gives the pair.  A task gives a pair once; slices of like blocks share a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, block, own, given = None, None, [], set()
        for batch in tidy(batches):
            if not batch.num_rows:
                continue
            of, first, outside, node, n, root = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            p = points(batch.column(6).to_pylist()).astype(np.uint32)
            edges = np.flatnonzero((of[1:] != of[:-1]) | (first[1:] != first[:-1])) + 1
            a, b = [], []
            for lo, hi in zip(np.append(0, edges).tolist(), np.append(edges, len(of)).tolist(), strict=True):
                if of[lo] != block:
                    block, tree, own = of[lo], None, []
                if first[lo]:
                    own.append((p[lo:hi], n[lo:hi], node[lo:hi], root[lo:hi]))
                    continue
                if tree is None:
                    own_p, own_n, own_node, own_root = (np.concatenate(x) for x in zip(*own, strict=True)) if own else (p[:0], n[:0], node[:0], root[:0])
                    tree = RTree(own_p, own_n) if len(own_n) else None
                    if tree is None:
                        continue
                i, j = tree.join(p[lo:hi], n[lo:hi], percent)
                good = (own_root[j] != root[lo:hi][i]) & (~outside[lo:hi][i] | (own_node[j] < node[lo:hi][i]))
                i, j = i[good], j[good]
                for x, y in zip(node[lo:hi][i].tolist(), own_node[j].tolist(), strict=True):
                    pair = (x, y) if x < y else (y, x)
                    if pair not in given:
                        given.add(pair)
                        a.append(pair[0])
                        b.append(pair[1])
            if len(given) > REMEMBERED:
                given.clear()
            if a:
                yield _emit([np.array(a, np.int64)], [np.array(b, np.int64)])

    return rows.mapInArrow(run, _PAIR)


def finer(pairs: DataFrame, place: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose full points could link."""
    both = pairs.distinct().join(place.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("point").alias("p")), "a").join(place.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("point").alias("q")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            if batch.num_rows:
                p, q = points(batch.column(3).to_pylist()), points(batch.column(5).to_pylist())
                ok = can_link(np.minimum(p, q).sum(axis=1), batch.column(2).to_numpy(), batch.column(4).to_numpy(), percent)
                yield _emit([batch.column(0).to_numpy()[ok]], [batch.column(1).to_numpy()[ok]])

    return both.select("a", "b", "n", "p", "m", "q").mapInArrow(run, _PAIR)


def packed_sets(docs: DataFrame, nodes: DataFrame, words: int, clash: DataFrame | None) -> DataFrame:
    """(node, set) for nodes (node, key), made again from the whole text of the class's smallest key; a set is its sorted hashes."""
    mine = having(docs, nodes.select("key").distinct(), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for batch in tidy(batches):
            for _, _, texts in blocks(column_texts(batch.column(1))):
                sets = list(shingle_sets(texts, words))
                found = digests(sets)
                new = [k for k, d in enumerate(map(tuple, found.tolist())) if not (d in given or given.add(d))]  # repeated rows once
                found = found[new]
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), pa.array([sets[k].tobytes() for k in new], pa.binary())], ["node", "more", "set"])

    made = split_classes(mine.select("key", "text").mapInArrow(run, "node long, more long, set binary"), clash).select("node", "set")
    return made.join(F.broadcast(nodes.select("node")) if nodes.count() <= BROADCAST_KEYS else nodes.select("node"), "node", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, rep: DataFrame, words: int, percent: int, clash: DataFrame | None = None) -> DataFrame:
    """Those of the pairs (stored) whose shingle sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(packed_sets(docs, stored(wanted.join(rep, "node"), "wanted"), words, clash), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            ok = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                u, v = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                ok[k] = can_link(np.array(len(np.intersect1d(u, v, assume_unique=True))), len(u), len(v), percent)
            yield _emit([batch.column(0).to_numpy()[ok]], [batch.column(1).to_numpy()[ok]])

    return both.select("a", "b", "x", "y").mapInArrow(compare, _PAIR)


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the smallest key that links reach, by similarity of at least percent."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    profile = stored(profiles(docs, "key", "text", words, percent), "profiles")
    with_set = profile.filter("key is not null and n_shingles > 0")
    rep = stored(with_set.groupBy("node").agg(F.min("key").alias("key"), F.min("more").alias("a"), F.max("more").alias("b")), "classes")
    clash = rep.filter("a != b").select("node")
    if clash.limit(1).count():
        profile = split_classes(profile, clash)
        rep = stored(profile.filter("key is not null and n_shingles > 0").groupBy("node").agg(F.min("key").alias("key")), "classes")
    else:
        rep, clash = rep.select("node", "key"), None
    fresh = profile.filter("point is not null")
    token_rows = sharing(fresh)
    # a class that several tasks met comes several times
    shared = stored(token_rows.distinct(), "shared")
    # of blocks with the same members one is enough; it is the first, as pairs are left to their first block
    members = shared.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"))
    kept = members.groupBy("size", "s", "x").agg(F.min("token").alias("token")).select("token", "size")
    shared = stored(shared.join(kept, "token"), "blocks")
    place = stored(fresh.select("node", F.col("n_shingles").alias("n"), "point").join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "points")

    def coarsened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coarse_point(x) for x in batch.column(1).to_pylist()], pa.binary())], ["node", "point"])

    near = place.select("node", "point").mapInArrow(coarsened, "node long, point binary")
    small = small_block_pairs(shared.filter(F.col("size") <= SMALL_BLOCK).join(near, "node").select("token", "node", "n", "point"), percent)
    large = shared.filter(F.col("size") > SMALL_BLOCK)
    degree = large.groupBy("node").agg(F.sum("size").alias("degree"))
    large = stored(large.join(degree, "node").select("token", "node", "n", "degree"), "large")
    pairs = stored(finer(small.unionByName(hub_pairs(large, percent)), place.select("node", "n", "point"), percent), "pairs")
    roots = components(stored(verified(pairs, docs, rep, words, percent, clash), "links"))
    rooted = stored(large.select("token", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    by_root = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m"))
    main = by_root.groupBy("token").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("total")).select("token", F.col("main")["root"].alias("main"), (F.col("total") - F.col("main")["m"]).alias("outside")).filter("outside > 0")
    main = main.withColumn("slices", F.ceil(F.col("outside") / SLICE).cast("int"))
    # the blocks of a group of near copies have its component in common and share tasks, as many as they need
    load = main.join(by_root.groupBy("token").agg(F.sum("m").alias("total")), "token").groupBy("main").agg(F.ceil(F.sum(F.col("total") * F.col("slices")) / TASK_ROWS).cast("int").alias("tasks"))
    main = main.join(load, "main").withColumn("task", F.pmod(F.xxhash64("token"), F.col("tasks")).cast("int")).select("token", "main", "outside", "slices", "task")
    rows = rooted.join(main, "token")
    rows = rows.withColumn("own", F.when(F.col("root") != F.col("main"), F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")))
    to = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    rows = rows.select("token", "node", "n", "root", "main", "task", "own", F.col("own").isNotNull().alias("outside"), to)
    rows = rows.select("*", F.explode(F.when(F.col("own") == F.col("slice"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("first"))
    rows = rows.join(place.select("node", "point"), "node").withColumn("block", F.xxhash64("token", "slice"))
    rows = rows.repartition("main", "task", "slice").sortWithinPartitions("block", F.col("first").desc())
    rest = stored(outside_pairs(rows.select("block", "first", "outside", "node", "n", "root", "point"), percent).distinct(), "pairs")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(rest, docs, rep, words, percent, clash)))
    of_class = rep.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = of_class.groupBy("root").agg(F.min("key").alias("component_id"))
    of_class = of_class.join(smallest, "root").select("node", "component_id")
    linked = profile.filter("n_shingles > 0").join(of_class, "node", "left").select("key", "n_shingles", F.when(F.col("key").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = profile.filter("n_shingles = 0").select("key", "n_shingles", F.col("key").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("key", key)
