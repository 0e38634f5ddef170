"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted over whole corpora: the
raw corpus and a trusted target.  A document's score is the mean, over its
n-grams, of log p(target) - log p(raw); it is kept if it passes the base rules
and its score is at least the threshold.  Both count tables have a fixed
number of buckets, so what the driver sees doesn't grow with the corpus.
Bucket weights are rounded to integers and summed as such: scores don't depend
on the order or the partition of the rows.

Null and empty texts have no words and fail the base rules; texts shorter than
an n-gram score 0.  Repeated rows are counted and returned as often as they
occur.  Without any target text the ratio is 0 for all.  All columns of the
input are passed on; a clashing column of the result takes its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Texts, blocks, column_texts, keyed, lines, span_hashes
from .store import BROADCAST_KEYS, stored

NGRAM = 4
BUCKETS = 1 << 16
SMOOTHING = 8.0
#: Mean log-likelihood ratio in nats from which a document is kept.
THRESHOLD = -0.75
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SCALE = 1 << 16

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def ngram_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the byte n-gram at each position, and for each text where its n-grams end."""
    m = max(0, len(texts.data) - NGRAM + 1)
    code = np.zeros(m, np.uint32)
    for k in range(NGRAM):
        code = (code << np.uint32(8)) | texts.data[k : k + m]
    code *= np.uint32(0x9E3779B1)
    last = np.maximum(texts.starts, texts.ends - NGRAM + 1)
    return (code >> np.uint32(16)).astype(np.int64), last


def bucket_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): n-grams of all whole texts by bucket, summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, texts in blocks(column_texts(batch.column(0))):
                code, last = ngram_buckets(texts)
                inside = np.zeros(len(texts.data) + 1, np.int8)
                np.add.at(inside, texts.starts, 1)
                np.add.at(inside, last, -1)
                total += np.bincount(code[np.cumsum(inside)[: len(code)] > 0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    return docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _table(counts: DataFrame) -> np.ndarray:
    """At most BUCKETS rows, whatever the corpus."""
    rows = counts.toPandas()
    out = np.zeros(BUCKETS, np.float64)
    out[rows["bucket"].to_numpy()] = rows["n"]
    return out


def bucket_weights(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket, as integers of 1 / SCALE; the target backs off to the raw counts."""
    if not raw.sum() or not target.sum():
        return np.zeros(BUCKETS, np.int64)
    p = (raw + SMOOTHING / BUCKETS) / (raw.sum() + SMOOTHING)
    q = (target + SMOOTHING * 1000 * np.minimum(p, 1 / BUCKETS)) / (target.sum() + (SMOOTHING * 1000 * np.minimum(p, 1 / BUCKETS)).sum())
    return np.rint(np.log(q / p) * SCALE).astype(np.int64)


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    w = texts.words()
    data = texts.data
    n = len(texts)
    out = {"n_words": w.counts.astype(np.int64), "word_chars": texts.sums(w.inside & ((data & 0xC0) != 0x80)), "n_symbols": texts.sums(_SYMBOL[data])}
    starts, ends, owner = lines(texts)
    with_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, owner = starts[with_word], ends[with_word], owner[with_word]
    first = np.unique(keyed(span_hashes(data, starts, ends), owner), return_index=True)[1]
    again = np.ones(len(owner), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(owner[again], minlength=n).astype(np.int64)
    h, at = w.ngrams(3)
    _, inverse, counts = np.unique(keyed(h, w.owner[at]), return_inverse=True, return_counts=True)
    twice = at[counts[inverse] > 1]
    covered = np.zeros(len(w), bool)
    for k in range(3):
        covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(w.owner[covered], minlength=n).astype(np.int64)
    return out


def score_sums(texts: Texts, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of bucket weights and number of n-grams of each text."""
    code, last = ngram_buckets(texts)
    total = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(weights[code], out=total[1 : len(code) + 1])
    return total[last] - total[texts.starts], last - texts.starts


RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, target: DataFrame | list[DataFrame], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base counts, the ratio and the verdict; target: trusted documents with the same text column, or blocks of them."""
    parts = [target] if isinstance(target, DataFrame) else target
    raw, trusted = _table(bucket_counts(docs, text)), sum((_table(bucket_counts(part, text)) for part in parts), np.zeros(BUCKETS))
    weights = docs.sparkSession.sparkContext.broadcast(bucket_weights(raw, trusted))  # BUCKETS integers
    names = [x.split()[0] for x in RULES.split(", ")]
    passed = [c for c in docs.columns if c not in names]
    place = passed.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list] = {x: [] for x in names}
            for _, _, texts in blocks(column_texts(batch.column(place))):
                c = base_counts(texts)
                total, n = score_sums(texts, weights.value)
                c["base_failed"] = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                c["llr"] = total / SCALE / np.maximum(n, 1)
                c["kept"] = ~c["base_failed"] & (c["llr"] >= threshold)
                for x in names:
                    parts[x].append(c[x])
            arrays = [pa.array(np.concatenate(parts[x])) if parts[x] else None for x in names]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*passed, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in passed]).schema) + ", " + RULES
    return docs.select(*[f"`{c}`" for c in passed]).mapInArrow(judge, schema)


def trusted_documents(docs: DataFrame, labels: DataFrame, most: int = BROADCAST_KEYS) -> list[DataFrame]:
    """The target: all documents that the labels call good, in blocks of at most ``most`` distinct keys; their texts are read once a block and never shuffled."""
    good = stored(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct(), "good")
    n = max(1, -(-good.count() // most))
    block = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(n))
    while n > 1 and good.groupBy(block().alias("block")).count().agg(F.max("count")).first()[0] > most:
        n += 1
    return [docs.select("doc_id", "text").join(F.broadcast(good.filter(block() == k)), "doc_id", "left_semi") for k in range(n)]
