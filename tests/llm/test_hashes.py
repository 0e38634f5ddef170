"""Words whose letters follow the Thue-Morse sequence: all polynomial hashes modulo 2**64 agree on such a word and its reverse image."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociweave.llm import jaccard, kernels, mixing, nbsvm, packing, rules, sampling, substrings, toxicity

SIZES = (1024, 2048, 4096)


def twins(n):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_hashes_tell_twins_apart():
    for n in SIZES:
        raw = np.frombuffer("".join(twins(n)).encode(), np.uint8)
        a, b = kernels.span_hashes(raw, np.array([0, n]), np.array([n, 2 * n])).tolist()
        assert a != b
        w = kernels.column_texts(pa.array([" ".join(twins(n)), " ".join(reversed(twins(n)))])).words().hashes
        assert w[0] == w[3] and w[1] == w[2] and w[0] != w[1]


def test_hash_follows_the_bytes_alone():
    rng = random.Random(5)
    words = ["".join(rng.choices("abc\0", k=n)) for n in (*range(1, 40), 4096, 40_000) for _ in range(3)]
    data = "".join(words).encode()
    ends = np.cumsum([len(w) for w in words])
    starts = ends - np.array([len(w) for w in words])
    seen = {}
    for m in (1, 7, 1 << 17):
        for w, h in zip(words, kernels.span_hashes(np.frombuffer(data, np.uint8), starts, ends, max_words=m).tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert kernels.span_hashes(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_toxicity_terms_of_twins():
    for n in SIZES:
        h, _ = toxicity.term_hashes(kernels.column_texts(pa.array(list(twins(n)))))
        assert len(set(h[0].tolist())) == 2


def test_rules_of_twins():
    counts = rules.base_counts(kernels.column_texts(pa.array(["\n".join(twins(n)) for n in SIZES])))
    assert counts["n_dup_lines"].tolist() == [0] * len(SIZES)


def test_tokens_of_twins():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain, coder = Tokenizer.from_file(path), packing.ChunkEncoder(path)
    texts = [" ".join([*twins(n), "x", *reversed(twins(n))]) for n in SIZES]
    ids, counts = coder.encode(kernels.column_texts(pa.array(texts)), 2)
    want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_tokens_where_first_hashes_agree(monkeypatch):
    """Even if the first hash agreed on all chunks of a length, the second one sends each to the tokenizer."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain, coder = Tokenizer.from_file(path), packing.ChunkEncoder(path)
    hashes = packing.span_hashes
    monkeypatch.setattr(packing, "span_hashes", lambda d, a, b, seed=0: hashes(d, a, b, seed) if seed else np.where(b - a > 8, np.uint64(77), hashes(d, a, b)))
    texts = ["extraordinary circumstances unquestionably short words extraordinary", "", "circumstances\nunquestionably"]
    for _ in range(2):
        ids, counts = coder.encode(kernels.column_texts(pa.array(texts)), 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize("n", [1024])
def test_joins_and_dedup_of_twins(spark, n):
    a, b = twins(n)
    rows = [(1, " ".join([a] + ["w"] * 16)), (2, " ".join([b] + ["w"] * 16)), (3, a), (4, b)]
    docs = spark.createDataFrame([(1, " ".join([a] * 13)), (2, " ".join([b] * 13)), *[(k + 2, t) for k, t in rows[2:]]], "doc_id long, text string")
    linked = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(docs, words=4, percent=85).collect()}
    assert linked == {1: 1, 2: 2, 5: 5, 6: 6}
    for r in substrings.remove_repeats(docs).collect():
        assert r["n_removed"] == 0 and r["kept"] == {1: " ".join([a] * 13), 2: " ".join([b] * 13), 5: a, 6: b}[r["doc_id"]]


def test_marks_of_values_that_come_once_a_block():
    """A value that comes with one owner a block, block after block, is marked before long."""
    rng = np.random.default_rng(3)
    for owners in (1, 2):
        shared, unmarked = kernels.Shared(), 0
        for k in range(300):
            value = np.append(rng.integers(1, 1 << 62, 5000), [7] * owners).astype(np.uint64)
            owner = np.arange(len(value)) + k * 10_000
            unmarked += int((~shared.marks(value, owner))[-owners:].sum())
        assert 2 <= unmarked < 40


def test_classifier_ignores_clashing_columns(spark):
    rows = [(k, ("good words here " if k % 2 else "BAD!!! ## ") * 20) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(5)).withColumn("quality", F.lit("x")).withColumn("key", F.lit(1)).withColumn("toxic", F.lit(2)).withColumn("score", F.lit("s"))
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    for model in (nbsvm, toxicity):
        assert model.classify(docs, labels).count() == 60
    got = {r["doc_id"]: r["predicted"] for r in nbsvm.classify(docs, labels).collect()}
    assert all(got[k] == k % 2 for k in range(60))


def test_sample_of_a_repeated_key_is_bounded(spark):
    docs = spark.range(500).selectExpr("id % 2 as doc_id", "cast(id as string) as text")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    held = next(h for h in range(50) if all(zlib.crc32(k) % 50 != h for k in (b"0", b"1")))
    assert sampling.labelled_sample(docs, labels, "quality", 50, held, 20).count() == 20


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(k, "w " * (k % 7), f"s{k % 3}") for k in range(40)]
    clash = ("_source", "_part", "_nth", "_key", "_place", "_rank", "_rate", "_shift", "_offset", "p_source", "_parts", "_copies", "_copy", "_own", "key", "_salt", "_id")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wide = docs
    for c in clash:
        wide = wide.withColumn(c, F.concat(F.lit(c), "doc_id"))
    plain = sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "copies", "taken").collect())
    got = mixing.mix(wide).collect()
    assert sorted((r["doc_id"], r["copies"], r["taken"]) for r in got) == plain
    taken = mixing.take(wide).collect()
    assert sorted(r["doc_id"] for r in taken) == sorted(d for d, n, _ in plain for _ in range(n))
    for r in [*got, *taken]:
        assert all(r[c] == f"{c}{r['doc_id']}" for c in clash)


def test_class_codes_are_digests_of_word_sequences():
    w = kernels.column_texts(pa.array(["a b", "a  b", "b a", ""])).words()
    codes = substrings.class_codes(w)
    assert codes[0] == codes[1] and len(set(codes)) == 3 and all(len(c) == 16 for c in codes)
    assert codes[3] == hashlib.blake2b(b"", digest_size=16).digest()
