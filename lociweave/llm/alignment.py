"""Alignment of two tokenizers' tokens over a corpus, by external spill counting.

A text's tokens of side A and side B are cut into groups at the bytes where
tokens of both end; each A token of a group is linked with each of its B
tokens.  What counts is in how many documents a pair of ids is linked.

1. ``runs``: texts are cut into chunks at spaces where neither tokenizer joins
   what meets; a chunk's tokens, groups and links are found once and kept in a
   dictionary of bounded size.  The (pair, document) records of some documents
   are sorted by pair and, radix by radix of the A id, written as runs: arrays
   by byte planes, compressed with zstd.
2. ``counted``: a radix' runs hold each pair once with its number of documents.
   A k-way merge, by a heap over the blocks' last pairs, adds them up; more
   runs than FAN are merged in several passes.  Pairs come in order of the A
   id, so an A id's highest count is known when its pairs have passed.
3. ``contributed``: the counts stream back past the runs, and each run's
   documents get their sums from each radix.  Records of documents never leave
   their run, so an id that all documents have is no larger than others: it is
   a row of counts in each run.
4. Sums of all radixes meet by run and become rows of documents.

Null and empty texts have no tokens, nor have texts of which one side's tokens
don't give back a space and the text.  Each row is a document, so repeated rows
count each; any key, null too, is passed on.  Long texts are taken whole.  An
empty table gives an empty result.  Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import Texts, blocks, column_texts, tidy
from .store import stored

#: Records and documents of a run, about, and radixes of the A id.
RECORDS, DOCUMENTS, RADIX = 1_000_000, 50_000, 64
#: Runs that are merged at once, pairs of a block of counts, and runs that one task brings together with the counts of a radix.
FAN, BLOCK, RUNS_A_TASK = 32, 1 << 16, 4_096
#: Chunks in a generation of a worker's dictionary.
ENTRIES = 150_000
#: Links of a group from which its distinct ids are paired instead of its tokens.
WIDE = 1 << 16


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def pack(x: np.ndarray) -> bytes:
    """An array of integers, not negative, by byte planes and compressed."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=0))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw))


def per_value(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the sum of each one's weights."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    start = np.flatnonzero(np.append(True, v[1:] != v[:-1])[: len(v)])
    return v[start], np.add.reduceat(weights[order], start) if len(start) else weights[:0]


class Sides:
    """The two tokenizers: ids of chunks, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # byte-level entries name each byte by a character: itself if it is printable Latin-1, else one from 256 on, in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
        tokens = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes([byte_of[c] for c in t]) if all(c in byte_of for c in t) else t.encode() for t in tokens]
        pieces = [(self.b.id_to_piece(k), self.b.is_byte(k)) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # ids as text, each with what may follow it: another id of its side, the other side, the next group
        self.ids = max(len(tokens), len(pieces))
        self.names = [b"%d%c" % (k, after) for after in b",|;" for k in range(self.ids)]
        self.name_sizes = np.array([len(x) for x in self.names], np.int64)
        self.b_vocabulary, self.space = len(pieces), self.b.piece_to_id("▁")

    def encode(self, chunks: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; a chunk starts with a space, which side B puts before a text itself, but not before none."""
        texts = [c.decode() for c in chunks]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], [x or [self.space] for x in b]


class Chunks:
    """What is known of some chunks: numbers of tokens, groups and links (all -1 where the bytes aren't given back), the groups as text, and pairs with how often each is linked."""

    def __init__(self, n_a: np.ndarray, n_b: np.ndarray, groups: np.ndarray, links: np.ndarray, texts: list[bytes], sizes: np.ndarray, pairs: np.ndarray, times: np.ndarray):
        self.n_a, self.n_b, self.groups, self.links, self.texts = n_a, n_b, groups, links, texts
        self.sizes, self.pairs, self.times = sizes, pairs, times
        self.at = np.cumsum(sizes) - sizes

    def take(self, k: np.ndarray) -> Chunks:
        at, _ = self.places(k)
        return Chunks(self.n_a[k], self.n_b[k], self.groups[k], self.links[k], [self.texts[i] for i in k.tolist()], self.sizes[k], self.pairs[at], self.times[at])

    def places(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs of the chunks k are, and which of k each belongs to."""
        sizes = self.sizes[k]
        of = np.repeat(np.arange(len(k)), sizes)
        return np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of] + self.at[k][of], of


def joined(parts: list[Chunks]) -> Chunks:
    columns = [np.concatenate([getattr(p, c) for p in parts]) for c in ("n_a", "n_b", "groups", "links", "sizes", "pairs", "times")]
    return Chunks(*columns[:4], list(chain.from_iterable(p.texts for p in parts)), *columns[4:])


NONE = Chunks(*[np.zeros(0, np.int64)] * 4, [], *[np.zeros(0, np.int64)] * 3)


def aligned(sides: Sides, chunks: list[bytes]) -> Chunks:
    """What is known of new chunks."""
    a, b = sides.encode(chunks)
    back = (b"".join([sides.a_bytes[i] for i in chain.from_iterable(a)]), b"".join([sides.b_bytes[i] for i in chain.from_iterable(b)]))
    good = np.ones(len(chunks), bool)
    if not back[0] == back[1] == b"".join(chunks):
        good[:] = [b"".join([sides.a_bytes[i] for i in x]) == c == b"".join([sides.b_bytes[i] for i in y]) for c, x, y in zip(chunks, a, b, strict=True)]
    n = len(chunks)
    n_a, n_b, groups, links = (np.full(n, -1, np.int64) for _ in range(4))
    sizes, texts = np.zeros(n, np.int64), [b""] * n
    kept = np.flatnonzero(good)
    if not len(kept):
        return Chunks(n_a, n_b, groups, links, texts, sizes, *[np.zeros(0, np.int64)] * 2)
    if len(kept) < n:
        a, b = [a[k] for k in kept.tolist()], [b[k] for k in kept.tolist()]
    n_a[kept], n_b[kept] = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(m[kept].sum())) for x, m in ((a, n_a), (b, n_b)))
    ends_a, ends_b = np.cumsum(sides.a_sizes[ids_a]), np.cumsum(sides.b_sizes[ids_b])
    common = ends_a[ends_b[np.searchsorted(ends_b, ends_a)] == ends_a]
    of_a, of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    in_a, in_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
    # the last group of each chunk: chunks end where both sides' tokens do
    last = np.searchsorted(common, ends_a[np.cumsum(n_a[kept]) - 1])
    groups[kept] = np.diff(last, prepend=-1)
    chunk_of = np.repeat(np.arange(len(kept)), groups[kept])
    links[kept] = np.add.reduceat(in_a * in_b, np.append(0, last[:-1] + 1))
    left, right = np.append(0, np.cumsum(in_a)).tolist(), np.append(0, np.cumsum(in_b)).tolist()
    # the ids of each group's A tokens, then of its B tokens, as one text of all chunks
    at_a, at_b = np.arange(len(ids_a)) + np.array(right)[of_a], np.arange(len(ids_b)) + np.array(left)[of_b + 1]
    named = np.zeros(len(ids_a) + len(ids_b), np.int64)
    named[at_a], named[at_b] = ids_a, ids_b
    named[at_a[np.array(left[1:]) - 1]] += sides.ids
    named[at_b[np.array(right[1:]) - 1]] += 2 * sides.ids
    whole = b"".join([sides.names[i] for i in named.tolist()])
    stops = np.cumsum(sides.name_sizes[named])[at_b[np.array(right)[last + 1] - 1]].tolist()
    first = 0
    for k, z in zip(kept.tolist(), stops, strict=True):
        texts[k] = whole[first : z - 1]
        first = z
    wide = in_a * in_b > WIDE
    narrow_a = np.flatnonzero(~wide[of_a])
    times = in_b[of_a[narrow_a]]
    which = np.repeat(narrow_a, times)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    partner = np.array(right)[of_a[which]] + nth
    owners, pairs, weights = [chunk_of[of_a[which]]], [ids_a[which] * sides.b_vocabulary + ids_b[partner]], [np.ones(len(which), np.int64)]
    for g in np.flatnonzero(wide).tolist():
        (x, m), (y, k) = (np.unique(i, return_counts=True) for i in (ids_a[left[g] : left[g + 1]], ids_b[right[g] : right[g + 1]]))
        pairs.append(np.add.outer(x * sides.b_vocabulary, y).ravel())
        weights.append(np.outer(m, k).ravel())
        owners.append(np.full(len(pairs[-1]), chunk_of[g]))
    owner, pair, weight = (np.concatenate(x) for x in (owners, pairs, weights))
    order = np.lexsort((pair, owner))
    owner, pair = owner[order], pair[order]
    start = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])))
    sizes[kept] = np.bincount(owner[start], minlength=len(kept))
    return Chunks(n_a, n_b, groups, links, texts, sizes, pair[start], np.add.reduceat(weight[order], start))


class Dictionary:
    """Chunks that a worker has met, in two generations: when the young one is full it becomes the old one, whose chunks move on when they are met again."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.index: dict[bytes, int] = {}
        self.old_index: dict[bytes, int] = {}
        self.young, self.old = NONE, NONE

    def codes(self, chunks: list[bytes]) -> np.ndarray:
        """The places of the chunks in the young generation, which may grow beyond ENTRIES by one call's chunks."""
        if len(self.index) > ENTRIES:
            self.old, self.old_index, self.young, self.index = self.young, self.index, NONE, {}
        index, n = self.index, len(self.index)
        put = index.setdefault
        found = np.array([put(c, len(index)) for c in chunks], np.int64)
        if len(index) == n:
            return found
        new = list(islice(index, n, None))
        before = np.fromiter(map(self.old_index.get, new, repeat(-1)), np.int64, len(new))
        known, fresh = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
        parts = [self.old.take(before[known])] if len(known) else []
        if len(fresh):
            parts.append(aligned(self.sides, [new[k] for k in fresh.tolist()]))
        if len(parts) > 1:
            parts = [joined(parts).take(np.argsort(np.concatenate([known, fresh])))]
        self.young = joined([self.young, *parts])
        return found


# A space after a character that isn't white space starts a token on both sides: no entry of side A's pattern and no piece
# of side B goes on from a non-space into a space.  Last bytes of ASCII white space, and first bytes of wider spaces:
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_WIDE_TWO, _WIDE_THREE = np.zeros(256, bool), np.zeros(256, bool)
_WIDE_TWO[0xC2] = _WIDE_THREE[0xE1] = _WIDE_THREE[0xE2] = _WIDE_THREE[0xE3] = True


def with_spaces(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts that aren't empty, each with a space before it, and where each starts."""
    sizes = texts.ends - texts.starts
    kept = np.flatnonzero(sizes > 0)
    starts = np.cumsum(sizes[kept] + 1) - sizes[kept] - 1
    out = np.full(int((sizes[kept] + 1).sum()), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[starts] = False
    out[inside] = texts.data
    return out, starts


def chunk_starts(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where chunks start: at each text, and at spaces after what surely isn't white space."""
    one, two, three = (np.concatenate([np.zeros(k, np.uint8), data[: max(0, len(data) - k)]])[: len(data)] for k in (1, 2, 3))
    unsure = _BLANK[one] | ((one >= 0x80) & (_WIDE_TWO[two] | _WIDE_THREE[three]))
    at = (data == 0x20) & ~unsure
    at[heads] = True
    return np.flatnonzero(at)


class Run:
    """Records of some documents, until they are written."""

    def __init__(self, vocabulary: int):
        self.vocabulary = vocabulary
        self.pairs: list[np.ndarray] = []
        self.documents: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.records, self.rows = 0, []

    def add(self, documents: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        self.documents.append(documents + len(self.rows))
        self.pairs.append(pairs)
        self.times.append(times)
        self.records += len(pairs)

    def parts(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """(radix, pairs, documents of each pair, document, times) of each radix that has any: two sorted arrays and theirs."""
        if not self.records:
            return
        pairs, documents, times = (np.concatenate(x) for x in (self.pairs, self.documents, self.times))
        radix = pairs // self.vocabulary % RADIX
        order = np.lexsort((documents, pairs, radix))
        pairs, documents, times, radix = pairs[order], documents[order], times[order], radix[order]
        edges = np.searchsorted(radix, np.arange(RADIX + 1)).tolist()
        for r, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < z:
                p = pairs[a:z]
                start = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                yield r, pack_sorted(p[start]), pack(np.diff(np.append(start, z - a))), pack(documents[a:z]), pack(times[a:z])


_DICTIONARIES: dict[tuple[str, str], Dictionary] = {}
_RUN = "run long, radix int, pairs binary, counts binary, documents binary, times binary, rows array<struct<key:{}, n_a:long, n_b:long, n_groups:long, n_links:long, groups_sha256:string>>"


def runs(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """The runs of documents (key, text); the row of radix -1 has the documents themselves."""
    schema = _RUN.format(docs.schema["key"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _DICTIONARIES:
            _DICTIONARIES[paths] = Dictionary(Sides(*paths))
        known = _DICTIONARIES[paths]
        number = TaskContext.get().partitionId() << 32
        key_type = None
        held = Run(known.sides.b_vocabulary)

        def written() -> pa.RecordBatch:
            rows = [(number, *part, None) for part in held.parts()] + [(number, -1, None, None, None, None, held.rows)]
            struct = pa.struct([("key", key_type), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])
            types = [pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.list_(struct)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in _RUN.split(", ")[:6]] + ["rows"])

        for batch in tidy(batches):
            key_type = batch.column(0).type
            keys = batch.column(0).to_pylist()
            for i, j, texts in blocks(column_texts(batch.column(1))):
                data, heads = with_spaces(texts)
                starts = chunk_starts(data, heads)
                ends = np.append(starts[1:], len(data))[: len(starts)]
                raw = data.tobytes()
                codes = known.codes([raw[a:z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)])
                c = known.young
                whose = np.flatnonzero(texts.ends > texts.starts)  # texts that aren't empty, one a head
                cuts = np.append(np.searchsorted(starts, heads), len(starts))
                owner = np.repeat(np.arange(len(whose)), np.diff(cuts))
                bad = np.unique(owner[c.n_a[codes] < 0])
                fit = np.ones(len(whose), bool)
                fit[bad] = False
                sums = [np.where(fit, np.add.reduceat(x[codes], cuts[:-1]) if len(whose) else 0, 0).tolist() for x in (c.n_a, c.n_b, c.groups, c.links)]
                rows = [(keys[k], 0, 0, 0, 0, "") for k in range(i, j)]
                for n, k in enumerate(whose.tolist()):
                    if fit[n]:
                        text = b";".join([c.texts[x] for x in codes[cuts[n] : cuts[n + 1]].tolist()])
                        rows[k] = (keys[i + k], *(s[n] for s in sums), hashlib.sha256(text).hexdigest())
                use = fit[owner]
                # each chunk of a document once, with how often it comes
                both, times = per_value(owner[use] * (len(c.sizes) + 1) + codes[use], np.ones(int(use.sum()), np.int64))
                document, code = both // (len(c.sizes) + 1), both % (len(c.sizes) + 1)
                place, of = c.places(code)
                pair, weight, document = c.pairs[place], c.times[place] * times[of], document[of]
                order = np.lexsort((pair, document))
                pair, document = pair[order], document[order]
                start = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (document[1:] != document[:-1]))[: len(pair)])
                if len(start):
                    held.add(whose[document[start]], pair[start], np.add.reduceat(weight[order], start))
                held.rows += rows
                if held.records >= RECORDS or len(held.rows) >= DOCUMENTS:
                    yield written()
                    held, number = Run(known.sides.b_vocabulary), number + 1
        if held.rows:
            yield written()

    return docs.select("key", "text").mapInArrow(run, schema)


def heap_merge(runs_: list[list[tuple[bytes, bytes]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in order with their counts added up, from runs of blocks (pairs, counts), each run in order.

    The heap has the last pair of each run's block; up to the least of these all blocks are complete."""
    queues = [iter(r) for r in runs_]
    current: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def advance(k: int) -> None:
        block = next(queues[k], None)
        if block is not None:
            pairs = unpack_sorted(block[0])
            current[k] = (pairs, unpack(block[1]))
            heapq.heappush(heap, (int(pairs[-1]), k))

    for k in range(len(queues)):
        advance(k)
    while heap:
        bound = heap[0][0]
        taken = []
        for k, (pairs, counts) in current.items():
            n = int(np.searchsorted(pairs, bound, side="right"))
            if n:
                taken.append((pairs[:n], counts[:n]))
                current[k] = (pairs[n:], counts[n:])
        yield per_value(*(np.concatenate(x) for x in zip(*taken, strict=True)))
        while heap and heap[0][0] == bound:
            k = heapq.heappop(heap)[1]
            del current[k]
            advance(k)


def in_blocks(merged: Iterator[tuple[np.ndarray, np.ndarray]], vocabulary: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same in blocks of about BLOCK pairs that don't divide an A id's pairs."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in chain(merged, [None]):
        if part is not None:
            held.append(part)
        if held and (part is None or sum(len(x[0]) for x in held) >= BLOCK):
            pairs, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            n = len(pairs) if part is None else int(np.searchsorted(pairs, pairs[-1] // vocabulary * vocabulary))
            if n:
                yield pairs[:n], counts[:n]
            held = [(pairs[n:], counts[n:])] if n < len(pairs) else []


def highest(pairs: np.ndarray, counts: np.ndarray, vocabulary: int) -> np.ndarray:
    """Whether each pair's count is its A id's highest; all pairs of an A id are here, next to each other."""
    a = pairs // vocabulary
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    return counts == np.repeat(np.maximum.reduceat(counts, start), np.diff(np.append(start, len(a))))


_COUNTS = "radix int, part long, block int, pairs binary, counts binary, best binary"


def merged_counts(blocks_: DataFrame, parts: int, vocabulary: int) -> DataFrame:
    """_COUNTS of each radix and part (part modulo parts) of rows (radix, part, block, pairs, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(group: tuple[int, int], runs_: dict[int, list]) -> Iterator[pa.RecordBatch]:
            for n, (pairs, counts) in enumerate(in_blocks(heap_merge(list(runs_.values())), vocabulary)):
                row = [group[0], group[1], n, pack_sorted(pairs), pack(counts), np.packbits(highest(pairs, counts, vocabulary)).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], [x.split()[0] for x in _COUNTS.split(", ")])

        group, held = None, {}
        for batch in batches:
            for radix, to, part, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (radix, to) != group:
                    if held:
                        yield from result(group, held)
                    group, held = (radix, to), {}
                held.setdefault(part, []).append((pairs, counts))
        if held:
            yield from result(group, held)

    to = F.pmod("part", F.lit(parts)).alias("to")
    rows = blocks_.select("radix", to, "part", "block", "pairs", "counts").repartition("radix", "to").sortWithinPartitions("radix", "to", "part", "block")
    return rows.select("radix", "to", "part", "pairs", "counts").mapInArrow(run, _COUNTS)


def counted(spilled: DataFrame, vocabulary: int) -> DataFrame:
    """_COUNTS of all pairs, from the stored runs."""
    rows = spilled.filter("radix >= 0").select("radix", F.col("run").alias("part"), F.lit(0).alias("block"), "pairs", "counts")
    parts = spilled.filter("radix = -1").count()
    numbered = spilled.filter("radix = -1").select("run")
    if parts > FAN:  # runs get dense numbers by partition and place, so that each merge gets its share
        per = stored(numbered.groupBy(F.shiftright("run", 32).alias("p")).agg(F.count(F.lit(1)).alias("n")), "tasks")
        before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task of the first stage
        offsets = per.select("p", before.alias("before"))
        low = F.col("part").bitwiseAND(F.lit((1 << 32) - 1))
        rows = rows.join(offsets, F.shiftright("part", 32) == F.col("p")).select("radix", (F.col("before") + low).alias("part"), "block", "pairs", "counts")
    while parts > FAN:
        parts = -(-parts // FAN)
        rows = stored(merged_counts(rows, parts, vocabulary), "merged")
    return stored(merged_counts(rows, 1, vocabulary), "counts")


_SUMS = "run long, best binary, total binary"


def contributed(spilled: DataFrame, counts: DataFrame, runs_: int) -> DataFrame:
    """_SUMS: for each run and radix the links of each document that are best, and the sum of their counts."""
    salts = max(1, -(-runs_ // RUNS_A_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, []
        for batch in batches:
            for radix, salt, number, pairs, n, documents, times, best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (radix, salt) != at:
                    at, table = (radix, salt), []
                if number < 0:
                    p = unpack_sorted(pairs)
                    table.append((p, unpack(n), np.unpackbits(np.frombuffer(best, np.uint8), count=len(p)).astype(bool)))
                    continue
                if len(table) > 1:
                    table = [tuple(np.concatenate(x) for x in zip(*table, strict=True))]
                p, count, top = table[0]
                each = unpack(n)
                k = np.repeat(np.searchsorted(p, unpack_sorted(pairs)), each)
                d, t = unpack(documents), unpack(times)
                sums = np.zeros((2, int(d.max()) + 1), np.int64)
                np.add.at(sums[0], d, np.where(top[k], t, 0))
                np.add.at(sums[1], d, t * count[k])
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack(sums[0])], pa.binary()), pa.array([pack(sums[1])], pa.binary())], ["run", "best", "total"])

    salt = F.pmod(F.xxhash64("run"), F.lit(salts)).cast("int").alias("salt")
    mine = spilled.filter("radix >= 0").select("radix", salt, "run", "pairs", "counts", "documents", "times", F.lit(None).cast("binary").alias("best"))
    none = F.lit(None).cast("binary")
    table = counts.select("radix", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), (F.col("block").cast("long") - F.lit(1 << 40)).alias("run"), "pairs", "counts", none.alias("documents"), none.alias("times"), "best")
    # counts come first, in order, then the runs
    rows = mine.unionByName(table).repartition("radix", "salt").sortWithinPartitions("radix", "salt", "run")
    return rows.mapInArrow(run, _SUMS)


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    paths = tokenizers or default_tokenizers()
    d = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    spilled = stored(runs(d, paths), "runs")
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    sums = contributed(spilled, counted(spilled, vocabulary), spilled.filter("radix = -1").count())
    key_type = d.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, totals = None, None, None

        def result() -> pa.RecordBatch:
            fields = {f.name: rows.field(f.name) for f in rows.type}
            columns = [*(fields[c] for c in ("key", "n_a", "n_b", "n_groups", "n_links")), pa.array(totals[0]), pa.array(totals[1]), fields["groups_sha256"]]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(2)[k].is_valid:
                    if rows is not None:
                        yield result()
                    number, rows = batch.column(0)[k].as_py(), batch.column(2)[k].values
                    totals = np.zeros((2, len(rows)), np.int64)
                else:
                    assert batch.column(0)[k].as_py() == number
                    for n in range(2):
                        x = unpack(batch.column(3 + n)[k].as_py())
                        totals[n, : len(x)] += x
        if rows is not None:
            yield result()

    none = F.lit(None).cast("binary")
    heads = spilled.filter("radix = -1").select("run", F.lit(0).alias("kind"), "rows", none.alias("best"), none.alias("total"))
    tails = sums.select("run", F.lit(1).alias("kind"), F.lit(None).cast(heads.schema["rows"].dataType).alias("rows"), "best", "total")
    out = heads.unionByName(tails).repartition("run").sortWithinPartitions("run", "kind").mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)
