"""Hard negatives against brute force, and what the tree bounds save."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxquarry.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, anchor bigint, block int, v string, place string"


def brute(rows, every=5, scale=256):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (label, [math.floor(scale * float(np.float32(x))) for x in v])
        best[i] = min(best.get(i, key), key)
    score = lambda x, y: sum(a * b for a, b in zip(x, y))
    out = []
    for a, (la, va) in best.items():
        if a % every:
            continue
        ranked = sorted((-score(va, v), i, label) for i, (label, v) in best.items() if i != a)
        for ps, p, _ in [x for x in ranked if x[2] == la][:5]:
            fits = [(-s, i) for s, i, label in ranked if label != la and 50 * -ps <= 100 * -s <= 95 * -ps]
            out += [(a, p, k + 1, i, -ps, s) for k, (s, i) in enumerate(fits[:3])]
    return sorted(out)


def mined(spark, rows, every=5, **more):
    df = spark.createDataFrame([(i, v, x, 1, 2, "c", "c") for i, v, x in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % every == 0, **more).collect())


def vectors(rng, n, d, centers):
    c = np.random.Generator(np.random.PCG64(rng.randrange(10**6))).normal(size=(centers, d))
    out = []
    for i in range(n):
        x = c[rng.randrange(centers)] + np.array([rng.gauss(0, 0.15) for _ in range(d)])
        out.append((i, (x / np.linalg.norm(x)).astype(np.float32).tolist(), rng.randrange(4)))
    return out


@pytest.mark.parametrize("blocks", [(4096, 1024), (64, 8)])
def test_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hn, "ROWS", blocks[0])
    monkeypatch.setattr(hn, "ANCHORS", blocks[1])
    rows = vectors(random.Random(3), 300, 12, 6)
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    """Nulls, odd components, ties, repeated ids, short and empty vectors, huge numbers, a third of equal rows."""
    rng = random.Random(4)
    rows = vectors(rng, 60, 5, 3)
    rows += [(None, [1.0] * 5, 1), (70, None, 1), (75, [1.0, None, 0.0, 0.0, 0.0], 1), (80, [float("nan")] * 5, 1), (85, [float("inf")] * 5, 1)]
    rows += [(90, [0.5] * 5, None), (95, [0.5, 0.25], 1), (100, [], 2), (105, [0.0] * 5, 3), (110, [-0.5] * 5, 0)]
    rows += [(120 + k, [0.5, 0.5, 0.5, 0.5, 0.1], k % 2) for k in range(40)]
    rows += [(10, [0.1] * 5, 0), (10, [0.1] * 5, 0), (10, [0.1] * 5, 3)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows + [(200, [1e6, -1e6, 1e6, 3.0, 0.5], 1), (201, [2e6, 1e6, 1e6, 1.0, 0.5], 1)]) == brute(
        rows + [(200, [1e6, -1e6, 1e6, 3.0, 0.5], 1), (201, [2e6, 1e6, 1e6, 1.0, 0.5], 1)]
    )


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []
    assert mined(spark, [(5, [1.0], 1)]) == []


def test_beyond_64_bits(spark):
    rows = [(0, [3e15] * 4, 1), (1, [3e15] * 4, 1), (2, [1e15] * 4, 2), (5, [2e15] * 4, 2)]
    assert mined(spark, rows) == []  # both sides stand at the limit, so nothing is below 95 % of it


def test_bounds_save_scores():
    """In clustered data most rows are passed on without being scored again."""
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in vectors(random.Random(5), 2000, 32, 20)]
    points = np.array([v for _, v, _ in rows[:300]])
    order, parent, edge = hn.spanning_tree(points)
    assert sorted(order.tolist()) == list(range(300)) and (parent[1:] < np.arange(1, 300)).all() and parent[0] == -1
    full = sum(np.sqrt(((points[order[i]] - points[order[p]]) ** 2).sum()) for i, p in enumerate(parent) if p >= 0)
    assert abs(full - edge[1:].sum()) < 1e-3 * full
    scorer = hn.Scorer(np.array([v for _, v, _ in rows]), points[order])
    asked = 0

    def wanted(c, lo, hi):
        exact = scorer.score(c)
        assert (lo <= exact).all() and (exact <= hi).all()
        return np.flatnonzero(hi >= 0.9 * 256 * 256)

    for _, at, _ in hn.walk(scorer, parent, edge, wanted):
        asked += len(at)
    assert asked < 0.25 * 300 * 2000


def test_cells_with_one_side():
    rows = pa.table({"id": pa.array([], pa.int64()), "label": pa.array([], pa.int32()), "v": pa.array([], pa.list_(pa.int64()))})
    assert hn.block_positives(rows, rows, 5).num_rows == 0
