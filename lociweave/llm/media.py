"""Media columns: texts kept as WAV, read by the wave module, fingerprinted by spectral-peak pairs.

``encode_media`` turns bytes into 8-bit mono WAV files in a binary column;
``media_features`` opens the stored files again and computes, for each, the
short-time Fourier transform, its local peaks, and pairs of peaks.  A peak is
paired with one later peak in each band, over growing distances.  A pair is
stored as a code (frequency, frequency, time between) and its time.

Nulls and empty texts become one frame of padding.  Repeated rows give repeated
results, equal texts equal results.  Input columns other than the key and the
text are not passed on, so names can't clash.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import blocks, column_texts

FRAME, HOP, RATE, PAD = 576, 288, 8000, 255
BINS = FRAME // 2 + 1
#: A peak's partner in each band is the first peak at least so many frames later, and MAX_GAP at most.
DISTANCES, MAX_GAP = (1, 3, 9, 27), 63
#: Frames whose spectrum is in memory at once.
FRAMES_AT_ONCE = 2048
#: Files whose features go out together.
ROWS_AT_ONCE = 128


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def spectrogram(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Magnitudes of the short-time Fourier transform, some frames at a time, rounded to integers."""
    n = max(1, (len(samples) - FRAME) // HOP + 1)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for a in range(0, n, FRAMES_AT_ONCE):
        x = (frames[a : a + FRAMES_AT_ONCE].astype(np.float32) - 128) * _WINDOW
        yield np.rint(np.abs(np.fft.rfft(x, axis=1))).astype(np.int32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Times, frequencies and bands of peaks, by time: each frame's strongest bin in each of four bands, if above its neighbours."""
    edges = np.linspace(2, BINS - 1, len(DISTANCES) + 1).astype(int)
    times, freqs, bands, t0 = [], [], [], 0
    for mags in spectrogram(samples):
        rows = np.arange(len(mags))
        for band, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            f = lo + mags[:, lo:hi].argmax(axis=1)
            top = mags[rows, f]
            good = (top > mags[rows, f - 1]) & (top > mags[rows, np.minimum(f + 1, BINS - 1)])
            times.append(t0 + rows[good])
            freqs.append(f[good])
            bands.append(np.full(int(good.sum()), band))
        t0 += len(mags)
    t, f, b = np.concatenate(times), np.concatenate(freqs), np.concatenate(bands)
    order = np.lexsort((f, t))
    return t[order], f[order], b[order], t0


def peak_pairs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(times, codes, frames, peaks): each peak paired with one later peak in each band."""
    t, f, b, n = peaks(samples)
    times, codes = [], []
    for band, distance in enumerate(DISTANCES):
        of = np.flatnonzero(b == band)
        i = np.searchsorted(t[of], t + distance)
        with_partner = np.flatnonzero(i < len(of))
        partner = of[i[with_partner]]
        gap = t[partner] - t[with_partner]
        near = gap <= MAX_GAP
        times.append(t[with_partner][near])
        codes.append(((f[with_partner][near] << 15) | (f[partner][near] << 6) | gap[near]).astype(np.int64))
    at, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, at))
    return at[order].astype(np.int32), code[order].astype(np.int32), n, len(t)


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each whole text, padded to a positive multiple of FRAME, as a WAV file."""
    key_type = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in blocks(column_texts(batch.column(1))):
                raw = texts.data.tobytes()
                values = [raw[a:z] for a, z in zip(texts.starts.tolist(), texts.ends.tolist(), strict=True)]
                media = [to_wav(x.ljust(max(1, -(-len(x) // FRAME)) * FRAME, bytes([PAD]))) for x in values]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(map(len, values), pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    return docs.select(docs[key].alias("key"), docs[text]).mapInArrow(encode, f"key {key_type}, n_bytes long, media binary").withColumnRenamed("key", key)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_peaks long"


def media_features(media: DataFrame, key: str = "doc_id", arrays: bool = False) -> DataFrame:
    """Digests and fingerprints of stored media; arrays adds the time-coded arrays themselves (pair_times, pair_codes)."""
    key_type = media.schema[key].dataType.simpleString()
    schema = f"key {key_type}, n_bytes long, {FEATURES}" + ", pair_times array<int>, pair_codes array<int>" * arrays

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            rows = []
            for value in part.column(2):
                stored = value.as_py()
                payload = from_wav(stored)
                at, code, frames, n = peak_pairs(np.frombuffer(payload, np.uint8))
                digest = hashlib.sha256(at.astype("<i4").tobytes() + code.astype("<i4").tobytes()).hexdigest()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{len(code)}:{digest}", frames, n, *((at, code) if arrays else ())))
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * (2 * arrays)
            columns = [c.cast(t) for c, t in zip(columns, types, strict=True)] if columns else [pa.array([], t) for t in types]
            names = ["key", "n_bytes", *(x.split()[0] for x in FEATURES.split(", ")), *(["pair_times", "pair_codes"] if arrays else [])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names)

    return media.select(media[key].alias("key"), "n_bytes", "media").mapInArrow(features, schema).withColumnRenamed("key", key)
