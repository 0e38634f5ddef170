"""Vectorised text kernels: numpy over the byte buffers of an Arrow string column.

Every kernel takes whole texts.  A block of rows is bounded in bytes (one very
long text is a block of its own), so memory follows the block, not the batch.
Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; as those are
ASCII, runs of bytes are runs of code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NEWLINE = 0x0A

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Places whose keys are kept ready.
_PLACES = 1 << 12
_KEYS = [mix(np.arange(_PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(k)) for k in (1, 2)]


def place_keys(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A summand and an odd factor for each place."""
    if place.max(initial=0) < _PLACES:
        return _KEYS[0][place], _KEYS[1][place] | np.uint64(1)
    twice = place.astype(np.uint64) * np.uint64(2)
    return mix(twice + np.uint64(1)), mix(twice + np.uint64(2)) | np.uint64(1)


def summed_hashes(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values (sizes of 1 at least, one run after another).

    Each value is mixed with its place before it is summed, so no difference of values carries on in a regular way
    from place to place, as it does in a polynomial modulo 2**64."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    if ends[-1] == len(sizes):
        terms = mix(values + _KEYS[0][0]) * (_KEYS[1][0] | np.uint64(1))
    else:
        summand, factor = place_keys(np.arange(ends[-1]) - np.repeat(ends - sizes, sizes))
        terms = np.add.reduceat(mix(values + summand) * factor, ends - sizes)
    return mix(terms + mix(sizes.astype(np.uint64)))


class Texts:
    """Whole texts that follow each other in one byte buffer; text i is ``data[starts[i]:ends[i]]``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def per_text(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of these sorted byte positions lie in each text, and whose each is."""
        counts = np.searchsorted(positions, self.ends) - np.searchsorted(positions, self.starts)
        return counts, np.repeat(np.arange(len(self)), counts)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """For each text the integer sum of a value per byte."""
        total = np.zeros(len(per_byte) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return total[self.ends] - total[self.starts]

    def words(self, lower: bool = False) -> Words:
        return Words(self, lower)


def column_texts(column: pa.Array) -> Texts:
    """The texts of an Arrow string column without copying them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64))
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(buffer, o[:-1], o[1:])


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one the worker, which lives on, gives unused memory back: Arrow's, and that of freed arrays."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def blocks(texts: Texts, max_bytes: int = BLOCK_BYTES, max_rows: int = 1 << 20) -> Iterator[tuple[int, int, Texts]]:
    """Runs of rows [i, j), max_rows at most, whose texts take about max_bytes, or one longer text."""
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(texts.ends, texts.starts[i] + max_bytes, side="right")))
        j = min(j, n, i + max_rows)
        a, b = texts.starts[i], texts.ends[j - 1]
        yield i, j, Texts(texts.data[a:b], texts.starts[i:j] - a, texts.ends[i:j] - a)
        i = j


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, max_words: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each byte span (sorted by start), from its words of 8 bytes; spans of one length up to 8 never collide."""
    out = np.zeros(len(starts), np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    at = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the 8 bytes from each position
    sizes = ends - starts
    words = np.maximum((sizes + 7) >> 3, 1)
    total = np.append(0, np.cumsum(words))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(total, total[i] + max_words, side="right")) - 1)
        n = words[i:j]
        if total[j] - total[i] == j - i:
            value = at[starts[i:j]] & _LOW_BYTES[sizes[i:j]]
        else:
            nth = np.arange(total[j] - total[i]) - np.repeat(total[i:j] - total[i], n)
            place = np.repeat(starts[i:j], n) + 8 * nth
            value = at[place] & _LOW_BYTES[np.minimum(np.repeat(ends[i:j], n) - place, 8)]
        out[i:j] = summed_hashes(value ^ np.uint64(seed), n)
        i = j
    return mix(out + sizes.astype(np.uint64))


class Words:
    """All words of some texts in order: their byte spans, whose they are, their hashes."""

    def __init__(self, texts: Texts, lower: bool = False):
        self.texts = texts
        data = texts.data
        inside = ~_SEPARATOR[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = texts.starts[texts.starts < texts.ends]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = texts.ends[texts.starts < texts.ends] - 1
        last[tails] = inside[tails]
        self.inside = inside
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.counts, self.owner = texts.per_text(self.starts)
        self._lower = lower
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            data = LOWER_ASCII[self.texts.data] if self._lower else self.texts.data
            self._hashes = span_hashes(data, self.starts, self.ends)
        return self._hashes

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every n consecutive words of one text, and the index of each one's first word."""
        m = len(self) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hashes[k : k + m]
        at = np.flatnonzero(self.owner[:m] == self.owner[n - 1 : n - 1 + m])
        return mix(h[at] + np.uint64(n)), at


def lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of each text (split at \\n) and whose they are."""
    breaks = np.flatnonzero(texts.data == _NEWLINE)
    counts, _ = texts.per_text(breaks)
    starts = np.sort(np.concatenate([texts.starts, breaks + 1]))
    ends = np.sort(np.concatenate([texts.ends, breaks]))
    return starts, ends, np.repeat(np.arange(len(texts)), counts + 1)


def keyed(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """One key for (owner, value): equal values of different texts get different keys."""
    return mix(values ^ mix(owner.astype(np.uint64) + np.uint64(1)))


#: A value that so many owners have within a block, or so many over several blocks, is known to be shared from then on; a task remembers so many values.
OFTEN, OVER_TIME, REMEMBERED = 3, 8, 1_000_000
#: Slots in which a task counts the owners of values that come now and then.
_SLOTS = 1 << 20


class Shared:
    """Values of which a task knows that several owners have them.

    A value that is frequent in a block of rows, or comes in block after block, becomes known, and later rows with
    it are marked; at least two owners' rows stay unmarked before.  So what decides whether a value is shared need
    only look at the unmarked rows.  Of a value that comes in one block of ten or more often, a task leaves some
    OVER_TIME rows unmarked; rarer ones lose their count to others now and then (a slot's value gives way to a
    newcomer when newcomers have taken its count), and stay unmarked in about one block of a hundred."""

    def __init__(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.value, self.count = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint8)

    def counted(self, values: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """How many owners of each of these distinct values have been counted, these included."""
        slot = (mix(values) & np.uint64(_SLOTS - 1)).astype(np.int64)
        same = self.value[slot] == values
        total = np.minimum(owners + np.where(same, self.count[slot], 0), 255)
        self.count[slot[same]] = total[same]
        other = slot[~same]
        taken = self.count[other] > 0
        self.count[other[taken]] -= 1
        free = np.flatnonzero(~same)[~taken]
        self.value[slot[free]], self.count[slot[free]] = values[free], total[free]
        return total

    def marks(self, value: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which of the rows (value, owner) are marked."""
        sure = np.isin(value, self.known)
        at = np.flatnonzero(~sure)
        if not len(at):
            return sure
        at = at[np.lexsort((owner[at], value[at]))]
        v, o = value[at], owner[at]
        new_value = np.append(True, v[1:] != v[:-1])
        new_owner = new_value | np.append(True, o[1:] != o[:-1])
        group = np.cumsum(new_value) - 1
        owners = np.bincount(group, weights=new_owner).astype(np.int64)
        often = owners >= OFTEN
        nth = np.cumsum(new_owner)
        nth = nth - nth[np.flatnonzero(new_value)][group]  # 0 for rows of a value's first owner
        spare = new_owner & (nth <= 1)  # a row each of the first two owners
        if len(self.known) < REMEMBERED:
            sure[at[often[group] & ~spare]] = True
            more = self.counted(v[new_value], owners) >= OVER_TIME
            if (often | more).any():
                self.known = np.union1d(self.known, v[new_value][often | more])
        return sure
