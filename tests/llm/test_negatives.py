"""Hard negatives against a double loop, bounds against true scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=50):
    best = {}
    for k, v, label in rows:
        if k is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        if k not in best or (label, v) < best[k]:
            best[k] = (label, v)
    items = [(k, (label + 1) % 10 if k % 7 == 0 else label, [math.floor(256 * x) for x in v]) for k, (label, v) in best.items()]
    out = []
    for k, label, v in items:
        if k % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, m) for j, m, w in items if j != k)
        for ps, p, _ in [x for x in scores if x[2] == label][:5]:
            inside = [x for x in scores if x[2] != label and -50 * ps <= -100 * x[0] <= -95 * ps][:3]
            out += [(k, p, n + 1, j, -ps, -s) for n, (s, j, _) in enumerate(inside)]
    return sorted(out)


def result(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(k, [float(x) for x in (centres[k % 6] + rng.normal(size=width) * (0.05 if k % 2 else 1)).astype(np.float32)], int(rng.integers(0, 4))) for k in range(n)]


@pytest.mark.parametrize(("block", "anchors", "slices"), [(1024, 512, 16), (7, 3, 2)])
def test_mine(spark, monkeypatch, block, anchors, slices):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "SLICES", slices)
    rows = clustered(300, 8, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(negatives.mine(df, every=10)) == plain(rows, 10)


def test_ties_and_odd_rows(spark):
    rng = random.Random(2)
    v = [0.5, 0.25, -0.125]
    rows = [(k, v, k % 2) for k in range(0, 200, 2)] + [(k, [x * rng.choice((1, 0.8, 0.6)) for x in v], k % 3) for k in range(1, 120, 2)]
    nan, inf = float("nan"), float("inf")
    rows += [(None, v, 1), (201, None, 1), (203, v, None), (205, [0.5, None, 0.1], 1), (207, [nan, 0.0, 0.0], 1), (209, [inf, 0.0, 0.0], 1), (211, [], 1), (250, [], 1), (213, [0.0, 0.0, 0.0], 2), (300, [0.0, 0.0], 0)]
    rows += [(1, v, 1), (1, v, 1), (3, [9.0], 0), (400, [0.4, 0.3], 1), (401, [0.5, 0.2, -0.1, 3.0], 1), (450, [-0.4, -0.3], 0), (51, [-3.0, -2.0, 0.0], 3), (53, [-2.5, -2.0, 0.0], 3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("x")).withColumn("q", F.lit(1)).withColumn("slot", F.lit(2))
    assert result(negatives.mine(df)) == plain(rows)
    assert result(negatives.mine(df.repartition(5), every=7)) == plain(rows, 7)


def test_large_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=4) * 3e5], k % 2) for k in range(60)] + [(k, [1e30, 1.0], 0) for k in (61, 100)]
    got = result(negatives.mine(spark.createDataFrame(rows, SCHEMA), every=10))
    assert got == plain([r for r in rows if r[0] < 60], 10)


def test_empty(spark):
    df = negatives.mine(spark.createDataFrame([], SCHEMA))
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and df.count() == 0
    assert negatives.mine(spark.createDataFrame([(50, [0.1], 1)], SCHEMA)).count() == 0


def block(rng, n, width, refs, spread):
    q = np.rint(rng.normal(size=(n, width)) * spread).astype("<i4")
    q[0] = 0
    norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    angle = np.arccos(np.clip(q @ refs.T / np.maximum(norm, 1e-300)[:, None], -1, 1))
    raw = lambda x, t: np.asarray(x).astype(t).tobytes()
    return negatives.Block(n, width, raw(np.arange(n), "<i8"), raw(rng.integers(0, 3, n), "<i8"), raw(norm, "<f8"), raw(angle, "<f8"), q.tobytes(), b"")


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 16):
        refs = rng.normal(size=(5, width))
        refs /= np.linalg.norm(refs, axis=1, keepdims=True)
        for spread in (1, 60, 1e6):
            a, b = block(rng, 30, width, refs, spread), block(rng, 50, width, refs, spread)
            true = a.q.astype(float) @ b.q.T.astype(float)
            low, high = negatives.score_bounds(a, b)
            assert (low <= true).all() and (true <= high).all()
            low, high = negatives.block_bounds(a, b)
            assert (low[:, None] <= true).all() and (true <= high[:, None]).all()
            wanted = rng.random(true.shape) < 0.02
            assert (negatives.exact_scores(a, b, wanted)[wanted] == true[wanted]).all()


def test_filter_passes_over_what_cannot_count():
    """Of tight clusters whole blocks are passed over."""
    refs = np.eye(4)
    make = lambda centre, n, seed: centre + np.random.default_rng(seed).normal(size=(n, 4)) * 0.01
    raw = lambda x, t: np.asarray(x).astype(t).tobytes()

    def packed(x, keys):
        q = np.floor(256 * x).astype("<i4")
        norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        angle = np.arccos(np.clip(q @ refs.T / norm[:, None], -1, 1))
        return negatives.Block(len(x), 4, raw(keys, "<i8"), raw(np.zeros(len(x)), "<i8"), raw(norm, "<f8"), raw(angle, "<f8"), q.tobytes(), b"")

    search = negatives.Positives(packed(make(np.eye(4)[0] * 5, 3, 1), np.arange(3)))
    search.meet(packed(make(np.eye(4)[0] * 5, 200, 2), np.arange(200) + 100))
    before = search.scored
    search.meet(packed(make(np.eye(4)[1] * 5, 200, 3), np.arange(200) + 1000))
    assert search.scored == before > 0


def test_windows():
    p = np.array([0, 1, 2, 3, 7, 20, 100, 101, -1, -7, -100, 10**17])
    low, high = negatives.window(p)
    for x, a, b in zip(p.tolist(), low.tolist(), high.tolist(), strict=True):
        inside = [n for n in range(-150, 150) if 50 * x <= 100 * n <= 95 * x] if abs(x) < 1000 else None
        if inside is not None:
            assert inside == list(range(a, b + 1))
        else:
            assert a == x // 2 and b == 95 * x // 100
