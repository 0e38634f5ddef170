"""Alignment against whole-text encoding and counting in plain Python."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociweave.llm import alignment, kernels, queries

FOLDER = "/root/testdata/sf0.001"
PIECES = [" ", "  ", "   ", "\n", "\t", "a", "é", "è", "日本", "Ab", "'s", "1", "!", "$", "|", "<|endoftext|>", "</s>", "<0x41>", "\x85", "\xa0", " ", "　", " ", "»", "’", "\x1f", "\x00", "🙂", "word", "unbelievable", "ﬁ", "\r\n"]


@pytest.fixture(scope="module")
def sides():
    return alignment.Sides(*alignment.default_tokenizers())


def groups_of(sides, text):
    """Groups [(a ids, b ids)] of one text, encoded whole; None if its bytes aren't given back."""
    if not text:
        return None
    want = (" " + text).encode()
    a, b = sides.a.encode(" " + text, add_special_tokens=False).ids, sides.b.encode(text)
    if b"".join(sides.a_bytes[i] for i in a) != want or b"".join(sides.b_bytes[i] for i in b) != want:
        return None
    out, i, j, at_a, at_b = [], 0, 0, 0, 0
    while i < len(a):
        x, y = [a[i]], [b[j]]
        at_a, at_b = at_a + len(sides.a_bytes[a[i]]), at_b + len(sides.b_bytes[b[j]])
        i, j = i + 1, j + 1
        while at_a != at_b:
            if at_a < at_b:
                x.append(a[i])
                at_a, i = at_a + len(sides.a_bytes[a[i]]), i + 1
            else:
                y.append(b[j])
                at_b, j = at_b + len(sides.b_bytes[b[j]]), j + 1
        out.append((x, y))
    assert j == len(b)
    return out


def plain(sides, rows):
    links, count = [], Counter()
    for key, text in rows:
        g = groups_of(sides, text)
        c = Counter((x, y) for p, q in g or [] for x in p for y in q)
        count.update(c.keys())
        links.append((key, g, c))
    top: dict[int, int] = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for key, g, c in links:
        if g is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        best = sum(n for (x, y), n in c.items() if count[x, y] == top[x])
        out.append((key, sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), sum(c.values()), best, sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    assert df.columns[1:] == ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(seed, n=120):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(n)] + ["", None, " ", "▁x", "has ▁ in it", "\n\n", "x" * 5000, " " * 700, "日" * 900, " ".join(rng.choices(["the", "fox,", "über", "naïve"], k=4000))]


@pytest.mark.parametrize(("records", "fan", "block", "runs_a_task", "entries"), [(1_500_000, 32, 1 << 16, 4096, 150_000), (500, 2, 40, 3, 300)])
def test_align(spark, sides, monkeypatch, records, fan, block, runs_a_task, entries):
    for name, value in (("RECORDS", records), ("FAN", fan), ("BLOCK", block), ("RUNS_A_TASK", runs_a_task)):
        monkeypatch.setattr(alignment, name, value)
    rows = [(k, t) for k, t in enumerate(texts(1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("run", F.lit(1)).repartition(3)
    assert result(alignment.align(df)) == plain(sides, rows)


def test_odd_rows(spark, sides):
    rows = [(None, "a b"), (None, "a b"), (1, "a b"), (1, None), (1, "c"), (2, ""), (3, "a b")]
    assert result(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(sides, rows)
    named = [("x", "a b"), ("y", "b")]
    assert result(alignment.align(spark.createDataFrame(named, "doc_id string, text string"))) == plain(sides, named)
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert result(alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string"))) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_generations(sides, monkeypatch):
    """A small dictionary that is cleared again and again gives what a large one gives."""
    chunks = [f" {w}".encode() for w in random.Random(2).choices("alpha beta gamma delta epsilon zeta ▁eta theta iota kappa".split(), k=400)]
    want = alignment.aligned(sides, chunks)
    monkeypatch.setattr(alignment, "ENTRIES", 4)
    known = alignment.Dictionary(sides)
    for k in range(0, 400, 3):
        codes = known.codes(chunks[k : k + 3])
        got = known.young.take(codes)
        part = want.take(np.arange(k, min(k + 3, 400)))
        assert got.texts == part.texts and all((getattr(got, c) == getattr(part, c)).all() for c in ("n_a", "n_b", "groups", "links", "sizes", "pairs", "times"))
    assert len(known.index) <= 4 + 3


def test_wide_groups_are_paired_by_distinct_ids(sides, monkeypatch):
    chunks = [t.encode() for t in (" 日本語" * 3, " unbelievable", " ﬁﬁﬁ\x85\x85", " 🙂🙂x")]
    want = alignment.aligned(sides, chunks)
    monkeypatch.setattr(alignment, "WIDE", 1)
    got = alignment.aligned(sides, chunks)
    assert (got.pairs == want.pairs).all() and (got.times == want.times).all() and got.texts == want.texts


def test_chunks_are_encoded_as_in_the_text(sides):
    for t in texts(3, 400):
        whole = groups_of(sides, t)
        if whole is not None:
            data, heads = alignment.with_spaces(kernels.column_texts(pa.array([t])))
            starts = alignment.chunk_starts(data, heads)
            raw = data.tobytes()
            c = alignment.aligned(sides, [raw[a:z] for a, z in zip(starts, np.append(starts[1:], len(raw)), strict=True)])
            assert b";".join(c.texts).decode() == ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in whole)


def test_heap_merge():
    rng = np.random.default_rng(5)
    for _ in range(30):
        total, runs = Counter(), []
        for _ in range(rng.integers(0, 6)):
            pairs = np.unique(rng.integers(0, 200, rng.integers(1, 80)))
            counts = rng.integers(1, 9, len(pairs))
            for p, n in zip(pairs.tolist(), counts.tolist(), strict=True):
                total[p] += n
            cuts = [0, *sorted(rng.choice(np.arange(1, len(pairs)), min(2, len(pairs) - 1), replace=False).tolist()), len(pairs)]
            runs.append([(alignment.pack_sorted(pairs[a:z]), alignment.pack(counts[a:z])) for a, z in zip(cuts[:-1], cuts[1:], strict=True)])
        got = list(alignment.heap_merge(runs))
        pairs = np.concatenate([x for x, _ in got]).tolist() if got else []
        assert pairs == sorted(total) and [n for _, c in got for n in c.tolist()] == [total[p] for p in pairs]


def test_packed_arrays():
    for x in ([], [0], [5, 0, 255, 256], [1 << 40, 3]):
        assert alignment.unpack(alignment.pack(np.array(x, np.int64))).tolist() == x


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark, sides):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert result(queries.QUERIES["op12_tokenizer_alignment"](spark, FOLDER)) == plain(sides, rows)
