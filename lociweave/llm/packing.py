"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous sweeps.

``token_pieces`` tokenises whole texts and cuts the long ones.  ``pack`` sorts
documents by length and places them into gaps.  Documents of one length are
interchangeable, and so are sequences with the same gap; so both are kept as
sorted runs, and a sweep matches a whole run of documents with the successor
gap (the smallest that holds them) at once.  If there are more documents than
gaps, or the other way round, ranks decide: the first of either side match.
Then the gaps are updated and the sweep goes on, from the longest documents to
the shortest, which gives exactly what best-fit decreasing gives one by one.
The plan depends on counts of lengths alone (at most CAPACITY rows), whatever
the corpus; each document then finds its place by its length and rank, where
ranks are counts of salted slices plus a row number within a slice.

Null and empty texts are one piece with the end token.  Repeated rows are
packed as often as they occur.  Ties go by a hash slice of key and piece, then by
key and piece; which of them gets which sequence changes no count.  An empty
table gives an empty result.  Columns other than key and text are not passed on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import Texts, blocks, column_texts, span_hashes, tidy
from .store import stored

CAPACITY, END_ID = 1024, 2
SLICE = 1_000
#: Chunks in a generation of a worker's dictionary, and bits of its slots (14 bytes each).
ENTRIES, SLOT_BITS = 330_000, 19
_SLOT_MASK = np.uint64((1 << SLOT_BITS) - 1)
#: Seed of the second hash, which tells chunks of equal first hashes apart.
CHECK_SEED = 0x5851F42D4C957F2D
#: Chunks that are encoded at once.
CHUNKS_AT_ONCE = 10_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# A byte-level BPE with the usual pattern never joins a non-space character and
# a space that follows it, and it gives a lone line break a token of its own.
# So texts can be cut there, and each chunk be encoded once.
_SPACE_LIKE = np.zeros(256, bool)
_SPACE_LIKE[:0x21] = True
_SPACE_LIKE[0x7F] = True
_SPACE_LIKE[[0x85, 0xC2, 0xE1, 0xE2, 0xE3]] = True  # first bytes of wider spaces


def chunk_starts(texts: Texts) -> np.ndarray:
    """Where chunks start: each text, single spaces before a non-space, single line breaks and what follows them."""
    data = texts.data
    if len(data) < 3:
        return texts.starts[texts.starts < texts.ends]
    plain = ~_SPACE_LIKE[data]
    spaces = np.flatnonzero((data[:-1] == 0x20) & plain[1:])
    middle = np.flatnonzero((data[1:-1] == 0x0A) & plain[2:] & plain[:-2] & (data[:-2] < 0x80)) + 1
    at = np.sort(np.concatenate([texts.starts[texts.starts < texts.ends], spaces, middle, middle + 1]))
    return at[np.diff(at, prepend=-1) > 0]


class ChunkTable:
    """Token ids by hash of a chunk: an open hash table of at most ENTRIES chunks over one buffer of ids."""

    def __init__(self, id_type: type):
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)  # 0: free
        self.at = np.zeros(1 << SLOT_BITS, np.int32)
        self.size = np.zeros(1 << SLOT_BITS, np.int32)
        self.check = np.zeros(1 << SLOT_BITS, np.uint32)
        self.ids = np.zeros(1 << 16, id_type)
        self.entries = self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that aren't here."""
        slot = (keys & _SLOT_MASK).astype(np.int64)
        there = self.keys[slot]
        open_ = np.flatnonzero((there != keys) & (there != 0))
        slot[there == 0] = -1
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(_SLOT_MASK)
            there = self.keys[slot[open_]]
            slot[open_[there == 0]] = -1
            open_ = open_[(there != keys[open_]) & (there != 0)]
        return slot

    def add(self, keys: np.ndarray, checks: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Puts in distinct keys that aren't here, with their checks and with their ids one after another."""
        ends = self.used + np.cumsum(sizes)
        need = int(ends[-1]) if len(ends) else 0
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need - len(self.ids), len(self.ids)), self.ids.dtype)])
        self.ids[self.used : self.used + len(flat)] = flat
        slot, left = (keys & _SLOT_MASK).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            mine = free[np.unique(slot[free], return_index=True)[1]]  # of keys that want one slot the first gets it
            self.keys[slot[mine]], self.check[slot[mine]], self.at[slot[mine]], self.size[slot[mine]] = keys[mine], checks[mine], (ends - sizes)[mine], sizes[mine]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & int(_SLOT_MASK)
        self.entries, self.used = self.entries + len(keys), self.used + len(flat)

    def of(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slots one after another, and how many each has."""
        size = self.size[slot].astype(np.int64)
        place = np.cumsum(size) - size
        return self.ids[np.repeat(self.at[slot] - place, size) + np.arange(int(size.sum()))], size


class ChunkEncoder:
    """Token ids of texts, by a dictionary from chunks to ids that grows as chunks are met.

    The dictionary has two generations.  When the young one is full it becomes the old one, whose chunks
    move on when they are met again; so what is frequent stays, and memory is bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.id_type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.young, self.old = ChunkTable(self.id_type), ChunkTable(self.id_type)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another, and how many each has."""
        flat, sizes = [np.zeros(0, self.id_type)], [np.zeros(0, np.int64)]
        for i in range(0, len(chunks), CHUNKS_AT_ONCE):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(chunks[i : i + CHUNKS_AT_ONCE], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), self.id_type, int(sizes[-1].sum())))
        return np.concatenate(flat), np.concatenate(sizes)

    def slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The slot of each chunk's key in the young generation, into which missing ones are put."""
        slot = self.young.find(keys)
        missing = np.flatnonzero(slot < 0)
        if not len(missing):
            return slot
        new, first = np.unique(keys[missing], return_index=True)
        if self.young.entries + len(new) > ENTRIES:
            self.young, self.old = ChunkTable(self.id_type), self.young
            return self.slots(data, starts, ends, keys, checks)
        before = self.old.find(new)
        known = before >= 0
        self.young.add(new[known], self.old.check[before[known]], *self.old.of(before[known]))
        at = missing[first[~known]]
        self.young.add(new[~known], checks[at], *self.encode_chunks(self.chunks(data, starts[at], ends[at])))
        slot[missing] = self.young.find(keys[missing])
        return slot

    @staticmethod
    def chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        raw = data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def encode(self, texts: Texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order with end_id after each text, and how many each text has."""
        starts = chunk_starts(texts)
        counts, owner = texts.per_text(starts)
        ends = np.append(starts[1:], len(texts.data))[: len(starts)]
        keys = np.maximum(span_hashes(texts.data, starts, ends), 1)
        checks = (ends - starts).astype(np.uint32)  # keys of short chunks of one length differ
        long = np.flatnonzero(ends - starts > 8)
        checks[long] = span_hashes(texts.data, starts[long], ends[long], CHECK_SEED) >> np.uint64(32)
        total = np.zeros(len(texts), np.int64)
        parts = [np.zeros(0, np.uint32)]
        for i in range(0, len(keys), ENTRIES // 2):  # a very long text has more chunks than a generation
            j = i + ENTRIES // 2
            ids, sizes = self.young_ids(texts.data, starts[i:j], ends[i:j], keys[i:j], checks[i:j])
            parts.append(ids.astype(np.uint32))
            total += np.bincount(owner[i:j], weights=sizes, minlength=len(texts)).astype(np.int64)
        return np.insert(np.concatenate(parts), np.cumsum(total), end_id), total + 1

    def young_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks and how many each has; where the key is another chunk's, as the check tells, the chunk is encoded by itself."""
        slot = self.slots(data, starts, ends, keys, checks)
        ids, sizes = self.young.of(slot)
        unlike = np.flatnonzero(self.young.check[slot] != checks)
        if not len(unlike):
            return ids, sizes
        own, own_sizes = self.encode_chunks(self.chunks(data, starts[unlike], ends[unlike]))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for k, part in zip(unlike.tolist(), np.split(own, np.cumsum(own_sizes)[:-1]), strict=True):
            parts[k] = part
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of pieces of at most capacity tokens; only the first may be shorter."""
    first = length % capacity or capacity
    return [(0, first)] + [(a, capacity) for a in range(first, length, capacity)]


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of all whole texts."""
    path = tokenizer or default_tokenizer()
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in tidy(batches):
            for i, j, texts in blocks(column_texts(batch.column(1))):
                ids, counts = coder.encode(texts, end_id)
                raw = ids.astype("<u4").tobytes()
                rows: list[tuple] = []
                base = 0
                for k, n in enumerate(counts.tolist()):
                    for p, (start, length) in enumerate(cut(n, capacity)):
                        a = 4 * (base + start)
                        rows.append((i + k, p, start, length, zlib.crc32(raw[a : a + 4 * length])))
                    base += n
                of, *rest = zip(*rows, strict=True)
                columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:])]
                names = ["key", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    offsets = np.append(0, np.cumsum(rest[2])).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"key {key_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(docs[key].alias("key"), docs[text]).mapInArrow(run, schema).withColumnRenamed("key", key)


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset) that place all documents.

    The documents of a run take one place each in as many consecutive sequences."""
    gaps: dict[int, list[list[int]]] = {g: [] for g in range(capacity + 1)}  # gap: runs [first sequence, how many]
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank, gap = counts[length], 0, length
        while left:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap <= capacity:
                run = gaps[gap][-1]
                m = min(left, run[1])
                runs.append((length, rank, m, run[0], capacity - gap))
                gaps[gap - length].append([run[0], m])
                if m == run[1]:
                    gaps[gap].pop()
                else:
                    run[0] += m
                    run[1] -= m
                gap = min(gap, max(length, gap - length))
                rank, left = rank + m, left - m
                continue
            each = capacity // length
            for depth, full in ((each, left // each), (left % each, 1 if left % each else 0)):
                if full:
                    for k in range(depth):
                        runs.append((length, rank, full, opened, k * length))
                        rank += full
                    gaps[capacity - depth * length].append([opened, full])
                    opened += full
            left = 0
    return runs


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """pieces (with piece and length, at most capacity) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    if any(n > capacity or n < 1 for n in counts):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    runs = sorted(sweep(counts, capacity))
    plan = spark.sparkContext.broadcast([np.array(x, np.int64) for x in zip(*runs, strict=True)] or [np.zeros(0, np.int64)] * 5)
    slices = spark.createDataFrame([(n, max(1, -(-c // SLICE))) for n, c in counts.items()], "l_length long, l_slices long")
    d = pieces.join(F.broadcast(slices), F.col("length") == F.col("l_length")).drop("l_length")  # at most capacity rows
    d = d.withColumn("_slice", F.pmod(F.xxhash64(key, "piece"), F.col("l_slices"))).drop("l_slices")
    sizes = d.groupBy(F.col("length").alias("p_length"), F.col("_slice").alias("p_slice")).agg(F.count(F.lit(1)).alias("_m"))
    ahead = Window.partitionBy("p_length").orderBy("p_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_ahead", F.coalesce(F.sum("_m").over(ahead), F.lit(0))).filter("_ahead > 0").drop("_m")
    d = d.join(sizes, (F.col("length") == F.col("p_length")) & (F.col("_slice") == F.col("p_slice")), "left").drop("p_length", "p_slice")
    by = Window.partitionBy("length", "_slice").orderBy(F.col(key).asc_nulls_first(), "piece")
    d = d.withColumn("_rank", F.coalesce("_ahead", F.lit(0)) + F.row_number().over(by) - 1).drop("_ahead", "_slice")
    names = pieces.columns
    at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, offset = plan.value
        start = (length << 44) + first
        for batch in tidy(batches):
            n, rank = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            i = np.searchsorted(start, (n << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence[i] + rank - first[i]), pa.array(offset[i])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return d.select(*names, "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Whole documents tokenised, cut and packed; the pieces are computed once and stored."""
    return pack(stored(token_pieces(docs, key, text, tokenizer), "pieces"), key)
