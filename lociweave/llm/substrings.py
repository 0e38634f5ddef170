"""Substring deduplication: repeated passages found by backward search in FM-indexes.

A window is WINDOW consecutive words.  Each window has an anchor, the smallest
hash among its ANCHOR-word n-grams, so equal windows have equal anchors; a
run of windows with one anchor is a segment.

1. ``segments``: the anchors of all whole texts.  Documents with equal words
   are one class, so copies are counted once.  Segments whose anchor only one
   class has can't repeat and go.
2. Distinct segments, each with the smallest document that has it, are dealt to
   shards by anchor.  A shard holds its segments as a compressed full-text
   index: the Burrows-Wheeler transform of all its words in a wavelet tree.
   Segments are streamed through it: backward search extends a match word by
   word, and stops where only the segment itself is left.  A match of WINDOW
   words is reported with the smallest document in its interval.
3. Windows that a smaller document has are marked in each document; the words
   they cover go.

An anchor with very many distinct segments is dealt by window instead, so no
shard grows with one passage; there equal windows meet by an aggregate and the
index confirms them.  An anchor that a task meets often is known to be shared,
and its segments skip the window that finds that out, so that doesn't grow with
one passage either.  Memory follows the shard, which has a bounded number of
segments: for each word its bits in the wavelet tree and four bytes for the
sequence it is in.

Null and empty texts have no words and lose none.  A null key is not smaller
than any other and loses nothing.  Repeated rows get equal results
and don't remove each other's words; a key that comes with several texts is no
document of its own: its rows remove nothing and lose nothing.  An empty table
gives an empty result.  Only the key, which must be an integer, and the text
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .kernels import Shared, Words, blocks, column_texts, summed_hashes
from .store import BROADCAST_KEYS, having, stored

WINDOW, ANCHOR = 13, 4
#: Windows of a segment at most (one byte holds their number).
LONGEST = 128
#: Segments of a shard, about.
SHARD = 20_000
#: Distinct segments of one anchor from which its windows are dealt one by one.
HOT = 20_000
#: Windows that are searched at once.
WINDOWS_AT_ONCE = 1 << 16


class BitRank:
    """Bits with counts of ones before each position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


class WaveletTree:
    """A sequence of small integers, level by level from the highest bit; ranks for many (symbol, position) at once."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (sequence >> shift) & 1
            zero = bit == 0
            self.levels.append((shift, BitRank(bit), int(zero.sum())))
            sequence = np.concatenate([sequence[zero], sequence[~zero]])
        self.first = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before position i."""
        return self._descend(symbol, i) - self.first[symbol]


class FMIndex:
    """Full-text index of some word sequences; symbol 0 ends a sequence."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        n, k = len(words) + len(sizes), len(sizes)
        ends = np.cumsum(sizes) + np.arange(k)
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = words
        owner = np.repeat(np.arange(k, dtype=np.int32), sizes + 1)
        # suffixes sorted by doubling; ends of sequences differ, so the longest sequence bounds the rounds
        order_key = text + k
        order_key[ends] = np.arange(k)
        step = 1
        while True:
            order = np.argsort(order_key, kind="stable")
            s = order_key[order]
            rank = np.zeros(n, np.int64)
            rank[order] = np.cumsum(np.append(False, s[1:] != s[:-1]))
            if step > int(sizes.max(initial=0)) + 1 or rank[order[-1]] == n - 1:
                break
            follow = np.zeros(n, np.int64)
            follow[:-step] = rank[step:] + 1
            order_key = rank * (n + 1) + follow
            step *= 2
        self.owner = owner[order]
        self.symbols = int(words.max(initial=0)) + 1
        self.starts = np.zeros(self.symbols + 1, np.int64)
        self.starts[1:] = np.cumsum(np.bincount(text, minlength=self.symbols))
        self.tree = WaveletTree(text[order - 1], self.symbols)

    def matches(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high): the longest suffix of each pattern that occurs more than once, and its interval of suffixes.

        Where no suffix does, length is 0; backward search goes from a pattern's last word."""
        q, width = patterns.shape
        length, low, high = np.zeros(q, np.int64), np.zeros(q, np.int64), np.zeros(q, np.int64)
        live = np.arange(q)
        lo, hi = np.zeros(q, np.int64), np.full(q, len(self.owner), np.int64)
        for k in range(width):
            c = patterns[live, width - 1 - k]
            if k == 0:
                a, b = self.starts[c], self.starts[c + 1]
            else:
                a, b = self.starts[c] + self.tree.rank(c, lo), self.starts[c] + self.tree.rank(c, hi)
            more = b - a > 1
            live, lo, hi = live[more], a[more], b[more]
            length[live], low[live], high[live] = k + 1, lo, hi
            if not len(live):
                break
        return length, low, high


def repeated(words: np.ndarray, sizes: np.ndarray, documents: np.ndarray, window: int) -> np.ndarray:
    """For each window of each sequence, in order, the smallest document of any sequence with that window.

    words: hashes; sizes: words of each sequence (window at least); documents: each sequence's smallest document."""
    codes = np.unique(words, return_inverse=True)[1] + 1
    index = FMIndex(codes, sizes)
    count = sizes - window + 1
    owner = np.repeat(np.arange(len(sizes)), count)
    first = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    parts = [index.matches(codes[first[i : i + WINDOWS_AT_ONCE, None] + np.arange(window)]) for i in range(0, len(first), WINDOWS_AT_ONCE)]
    length, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    out = documents[owner].copy()
    hit = np.flatnonzero(length == window)
    if len(hit):
        # intervals of patterns of one length are equal or apart
        edges, which = np.unique(low[hit], return_inverse=True)
        ends = np.zeros(len(edges), np.int64)
        ends[which] = high[hit]
        at = np.append(documents[index.owner], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(at, np.stack([edges, ends], axis=1).ravel())[::2]
        out[hit] = np.minimum(out[hit], least[which])
    return out


def anchored(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first word, windows) of each segment: runs of windows of a text with one anchor, LONGEST windows at most."""
    h, at = w.ngrams(anchor)
    span = window - anchor + 1
    if len(h) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, span)
    good = np.flatnonzero(at[span - 1 :] - at[: len(at) - span + 1] == span - 1)
    good = good[w.owner[at[good]] == w.owner[at[good + span - 1]]]
    if not len(good):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.concatenate([good[i : i + 65536] + views[good[i : i + 65536]].argmin(axis=1) for i in range(0, len(good), 65536)])
    value = h[place]
    new = np.append(True, (value[1:] != value[:-1]) | (good[1:] != good[:-1] + 1))
    start = np.flatnonzero(new)
    in_run = np.arange(len(good)) - np.repeat(start, np.diff(np.append(start, len(good))))
    start = np.flatnonzero(in_run % LONGEST == 0)
    return h[place[start]], at[good[start]], np.diff(np.append(start, len(good)))


def class_codes(w: Words) -> list[bytes]:
    """128 bits of a digest of the word sequence of each text."""
    raw, ends = w.hashes.tobytes(), np.cumsum(w.counts).tolist()
    return [hashlib.blake2b(raw[8 * (e - n) : 8 * e], digest_size=16).digest() for n, e in zip(w.counts.tolist(), ends, strict=True)]


def classes(docs: DataFrame) -> DataFrame:
    """(key, class, n_words) of each row; class stands for the words of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in blocks(column_texts(batch.column(1))):
                w = texts.words()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(class_codes(w), pa.binary()), pa.array(w.counts.astype(np.int64))], ["key", "class", "n_words"])

    return docs.mapInArrow(run, "key long, class binary, n_words long")


def segments(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, class, place, sure): all segments, of each class once a task; place holds the first word and the number of windows.

    sure: this task has met other classes with the anchor, and given two of them without the mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        shared = Shared()
        for batch in batches:
            for _, _, texts in blocks(column_texts(batch.column(1))):
                w = texts.words()
                code = class_codes(w)
                fresh = np.zeros(len(code), bool)
                for k, c in enumerate(code):
                    fresh[k] = c not in seen
                    seen.add(c)
                h, first, count = anchored(w, window, anchor)
                owner = w.owner[first]
                keep = fresh[owner]
                h, first, count, owner = h[keep], first[keep], count[keep], owner[keep]
                base = np.cumsum(w.counts) - w.counts
                sure = shared.marks(h, owner)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(code, pa.binary()).take(pa.array(owner)), pa.array(((first - base[owner]) << 8) | count), pa.array(sure)], ["anchor", "class", "place", "sure"])

    return docs.filter("key is not null").mapInArrow(run, "anchor long, class binary, place long, sure boolean")


_CUT = "anchor long, segment long, low long, first int, words array<long>"


def cut(spans: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The words (hashes) of each span of a document, and a hash of them; spans: (key, spans array<struct<anchor, place>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in blocks(column_texts(batch.column(1))):
                w = texts.words()
                base = np.cumsum(w.counts) - w.counts
                part = batch.column(2).slice(i, j - i)
                sizes = part.value_lengths().to_numpy(zero_copy_only=False)
                flat = part.flatten()
                p = flat.field(1).to_numpy()
                owner = np.repeat(np.arange(j - i), sizes)
                first, n = base[owner] + (p >> 8), (p & 255) + window - 1
                offsets = np.append(0, np.cumsum(n))
                at = np.repeat(first - offsets[:-1], n) + np.arange(offsets[-1])
                words = w.hashes[at]
                low = batch.column(0).slice(i, j - i).to_numpy()[owner]
                yield pa.RecordBatch.from_arrays([flat.field(0), pa.array(summed_hashes(words, n).view(np.int64)), pa.array(low), pa.array((p >> 8).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words.view(np.int64)))], ["anchor", "segment", "low", "first", "words"])

    return docs.join(spans, "key").dropDuplicates(["key"]).select("key", "text", "spans").mapInArrow(run, _CUT)


_LOWS = "anchor long, segment long, at int, lows array<long>"


def search_shards(cuts: DataFrame, shards: int, window: int) -> DataFrame:
    """For each segment the smallest document of each of its windows; one FM-index for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            words = t.column("words").combine_chunks()
            words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
            sizes = np.diff(words.offsets.to_numpy()).astype(np.int64)
            lows = repeated(words.flatten().to_numpy().view(np.uint64), sizes, t.column("low").to_numpy(), window)
            offsets = np.append(0, np.cumsum(sizes - window + 1)).astype(np.int32)
            one = lambda c: pa.array(t.column(c).to_numpy())
            return pa.RecordBatch.from_arrays([one("anchor"), one("segment"), one("at"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(lows))], ["anchor", "segment", "at", "lows"])

        held, shard = [], None
        for batch in batches:
            s = batch.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]]) if len(s) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and s[a] != shard:
                    yield search(pa.Table.from_batches(held))
                    held = []
                shard = s[a]
                held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield search(pa.Table.from_batches(held))

    c = cuts.withColumn("shard", F.pmod("route", F.lit(shards)).cast("int")).select("shard", "anchor", "segment", "at", "low", "words")
    return c.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, _LOWS)


_STRIPPED = "key long, n_words long, n_removed long, kept string"


def stripped_texts(rows: DataFrame, window: int) -> DataFrame:
    """(key, n_words, n_removed, kept) of rows (key, text, at array<int>): at has the first words of windows that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in blocks(column_texts(batch.column(1))):
                w = texts.words()
                base = np.cumsum(w.counts) - w.counts
                part = batch.column(2).slice(i, j - i)
                sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                starts = part.flatten().to_numpy(zero_copy_only=False) + np.repeat(base, sizes)
                change = np.zeros(len(w) + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + window, -1)
                gone = np.cumsum(change)[:-1] > 0
                raw = texts.data.tobytes()
                a, z = w.starts.tolist(), w.ends.tolist()
                kept, at = [], 0
                for n in w.counts.tolist():
                    idx = np.flatnonzero(~gone[at : at + n]) + at
                    kept.append(b" ".join([raw[a[k] : z[k]] for k in idx.tolist()]).decode("utf-8", "replace"))
                    at += n
                removed = np.bincount(w.owner[gone], minlength=j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())], ["key", "n_words", "n_removed", "kept"])

    return rows.select("key", "text", "at").mapInArrow(run, _STRIPPED)


def strip(docs: DataFrame, cls: DataFrame, low: DataFrame, removals: DataFrame, window: int) -> DataFrame:
    """(key, n_words, n_removed, kept) of documents.

    removals: (key, at), windows that go from a class's first document; a later document of the class loses all."""
    later = stored(cls.join(low, "class").filter("key > low").select("key").distinct(), "later")
    touched = stored(removals.select("key").unionByName(later).distinct(), "touched")
    send = F.broadcast if touched.count() <= BROADCAST_KEYS else lambda df: df
    whole = stripped_texts(docs.join(send(touched), "key", "left_anti").withColumn("at", F.lit(None).cast("array<int>")), window)
    some = stripped_texts(having(docs, removals.select("key"), "key").join(removals, "key"), window)
    none = cls.join(later, "key", "left_semi").select("key", "n_words", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"))
    return whole.unionByName(some).unionByName(none)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(key, n_words, n_removed, kept) of every row: kept is the words that no smaller document has in a shared window, joined by a space."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"the key {key} must be an integer")
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    cls = stored(classes(docs), "classes")
    several = stored(cls.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("key is not null and a != b").select("key"), "several")
    if several.limit(1).count():
        alone = having(docs, several, "key").withColumn("at", F.lit(None).cast("array<int>"))
        rest = docs.join(several, "key", "left_anti")
        return stripped_texts(alone, window).withColumnRenamed("key", key).unionByName(remove_repeats(rest, "key", "text", window, anchor).withColumnRenamed("key", key))
    low = cls.filter(F.col("key").isNotNull() & (F.col("n_words") >= window)).groupBy("class").agg(F.min("key").alias("low"))
    low = stored(low, "lowest")
    found = segments(docs, window, anchor).withColumn("salt", F.when(F.col("sure"), 1 + F.pmod(F.xxhash64("class"), F.lit(1023))).otherwise(0).cast("int"))
    by_anchor = Window.partitionBy("anchor", "salt")
    found = found.withColumn("shared", F.col("sure") | (F.min("class").over(by_anchor) != F.max("class").over(by_anchor))).filter("shared").select("anchor", "class", "place")
    # a set, as a class that several tasks met comes several times
    spans = found.groupBy("class").agg(F.collect_set(F.struct("anchor", "place")).alias("spans"))
    spans = stored(spans.join(low, "class").select(F.col("low").alias("key"), "spans"), "spans")
    texts = having(docs, spans.select("key"), "key")
    cuts = stored(cut(spans, texts, window), "cuts")
    per_anchor = cuts.groupBy("anchor", "segment").agg(F.min("low").alias("low"), F.first("words").alias("words"))
    per_anchor = stored(per_anchor, "distinct")
    hot = per_anchor.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("anchor")
    hot = stored(hot, "hot")
    plain = per_anchor.join(hot, "anchor", "left_anti").withColumn("at", F.lit(0))
    lows = search_shards(plain.withColumn("route", F.col("anchor")), _shards(plain), window)
    if hot.limit(1).count():
        single = per_anchor.join(hot, "anchor").select("anchor", "segment", "low", F.posexplode(F.expr(f"transform(sequence(1, size(words) - {window - 1}), i -> slice(words, i, {window}))")).alias("at", "words"))
        single = single.withColumn("route", F.xxhash64("words")).withColumn("more", F.xxhash64(F.lit(1), "words"))
        once = single.groupBy("route", "more").agg(F.min("low").alias("low"), F.first("words").alias("words"))
        once = stored(once.select("route", F.col("more").alias("anchor"), F.col("route").alias("segment"), F.lit(0).alias("at"), "low", "words"), "windows")
        best = search_shards(once, _shards(once), window).select(F.col("segment").alias("route"), F.col("anchor").alias("more"), "lows")
        lows = lows.unionByName(single.select("anchor", "segment", "at", "route", "more").join(best, ["route", "more"]).select("anchor", "segment", "at", "lows"))
    lows = stored(lows, "lows")
    places = cuts.select("anchor", "segment", F.col("low").alias("key"), "first").join(lows, ["anchor", "segment"])
    gone = F.filter(F.transform("lows", lambda x, i: F.when(x < F.col("key"), F.col("first") + F.col("at") + i)), lambda x: x.isNotNull())
    removals = places.select("key", gone.alias("gone")).filter("size(gone) > 0").groupBy("key").agg(F.flatten(F.collect_list("gone")).alias("at"))
    removals = stored(removals, "removals")
    stripped = strip(docs, cls, low, removals, window)
    return stripped.withColumnRenamed("key", key)


def _shards(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // SHARD))
