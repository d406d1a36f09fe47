"""Operators against plain Python on random, deliberately skewed input."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxquarry.functions import text as tx
from voxquarry.operators import components as cc
from voxquarry.operators import ordering as od
from voxquarry.operators import reports as rp
from voxquarry.operators import retrieval as rt
from voxquarry.operators import sampling as sp
from voxquarry.operators import slices as sl
from voxquarry.operators import tfidf as tf
from voxquarry.operators import voxels as vx

VOX = "case_id string, mask_id int, z int, y int, x int"


def flood(points, dim, diagonal=False):
    """Component name (first voxel) of every point by breadth-first search."""
    left, names = set(points), {}
    for p in sorted(points):
        if p not in left:
            continue
        stack = [p]
        left.discard(p)
        while stack:
            q = stack.pop()
            names[q] = p
            z, y, x = q
            near = [(z, y, x - 1), (z, y, x + 1), (z, y - 1, x), (z, y + 1, x)]
            if diagonal:
                near += [(z, y + a, x + b) for a in (-1, 1) for b in (-1, 1)]
            if dim == 3:
                near += [(z - 1, y, x), (z + 1, y, x)]
            for n in near:
                if n in left:
                    left.discard(n)
                    stack.append(n)
    return names


def random_volume(seed):
    rnd = random.Random(seed)
    pts = [(z, y, x) for z in range(21) for y in range(9) for x in range(9) if rnd.random() < 0.33]
    # A staircase through all slices keeps one component alive across every block.
    return sorted(set(pts) | {(z, z % 9, x) for z in range(21) for x in range(9)})


@pytest.mark.parametrize("dim,diagonal", [(2, False), (2, True), (3, False)])
def test_components(spark, dim, diagonal):
    want, rows = {}, []
    for case, seed in (("a", 1), ("b", 2)):
        pts = random_volume(seed)
        rows += [(case, 1, *p) for p in pts]
        want.update({(case, *p): n for p, n in flood(pts, dim, diagonal).items()})
    df = spark.createDataFrame(rows, VOX)
    got = cc.components(df, dim, diagonal, block=3).collect()
    assert {(r.case_id, r.z, r.y, r.x): r.label for r in got} == {
        k: (n[0] << 40) + (n[1] << 20) + n[2] for k, n in want.items()
    }
    sizes = cc.component_sizes(cc.component_runs(df, dim, diagonal), dim)
    assert sizes.agg(F.sum("size")).first()[0] == len(rows)


def test_long_chain_of_blocks(spark):
    """A one-voxel-wide column and a detached one: many blocks, two components."""
    rows = [("a", 1, z, 0, 0) for z in range(200)] + [("a", 1, z, 5, 5) for z in range(200) if z != 77]
    got = cc.component_count(spark.createDataFrame(rows, VOX)).first()
    assert got.component_count == 3


def test_erosion_in_one_pass_equals_repeated(spark):
    pts = [p for p in random_volume(3) if p[0] < 4] + [(0, y, x) for y in range(9) for x in range(9)]
    df = spark.createDataFrame(sorted({("a", 1, *p) for p in pts}), VOX)
    once = vx.erode(vx.erode(df))
    assert sorted(map(tuple, vx.erode(df, 2).collect())) == sorted(map(tuple, once.collect()))
    assert vx.erode(df).join(df, df.columns, "left_anti").count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60))
def test_quantile_matches_numpy(spark, values):
    # Two thirds of the rows share one value.
    data = [(float(v),) for v in values] + [(7.0,)] * (2 * len(values))
    df = spark.createDataFrame(data, "v double")
    got = od.quantiles(od.value_table(df, [], "v"), [], {"m": 0.5, "q": 0.9}, buckets=4).first()
    arr = np.array([d[0] for d in data])
    assert got.m == pytest.approx(np.median(arr)) and got.q == pytest.approx(np.percentile(arr, 90))


def test_grouped_summary_matches_numpy(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.7 else f"g{rnd.randrange(5)}", rnd.choice([0.0, rnd.random()])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, dice double")
    for r in rp.result_summary(df, keys=["k"]).collect():
        vals = np.array([v for k, v in rows if k == r.k])
        assert (r.n, r.zero, r.hit) == (len(vals), (vals == 0).sum(), (vals >= 0.5).sum())
        assert r.median == pytest.approx(np.median(vals)) and r["mean"] == pytest.approx(vals.mean())


def test_global_rank_and_running_sums(spark):
    names = [f"n{i * 7919 % 500:03d}" for i in range(500)]
    df = spark.createDataFrame([(n, float(i % 5), i % 3) for i, n in enumerate(names)], "case_id string, dice double, pred_voxels int")
    ranks = {r.case_id: r["rank"] for r in od.global_rank(df, ["case_id"], buckets=7).collect()}
    assert [n for n, _ in sorted(ranks.items(), key=lambda t: t[1])] == sorted(names)
    assert sorted(ranks.values()) == list(range(1, 501))
    run = {r.case_id: r for r in rp.running_summary(df, ["case_id"]).collect()}
    order = sorted(range(500), key=lambda i: names[i])
    total = empty = 0
    for n, i in enumerate(order, 1):
        total += i % 5
        empty += i % 3 == 0
        assert run[names[i]].running_mean == pytest.approx(total / n) and run[names[i]].running_empty == empty


ORGANS = ["liver", "lung", "kidney", "spleen", "toe", "lumbar spine"]
SIDES = ["left ", "right ", "bilateral ", ""]
FINDINGS = ["mass", "cyst", "nodule", "fracture", "thing"]
TAILS = ["", " at L4", " at C5", " in the upper part"]


def bank_rows(seed, n=160):
    """Case 'hot' holds a third of all rows, and one text a third of them."""
    rnd, rows, pos = random.Random(seed), [], {}
    for _ in range(n):
        case = "hot" if rnd.random() < 0.34 else f"c{rnd.randrange(12):02d}"
        text = "left liver mass" if rnd.random() < 0.34 else "".join(
            [rnd.choice(SIDES), rnd.choice(ORGANS), " ", rnd.choice(FINDINGS), rnd.choice(TAILS)]
        )
        pos[case] = pos.get(case, -1) + 1
        voxels = 0 if rnd.random() < 0.3 else rnd.randrange(1, 99)
        rows.append((case, pos[case] + 1, pos[case], text, voxels, *[round(rnd.random(), 3) for _ in rt.EXTENT]))
    return rows


BANK = "case_id string, mask_id int, pos int, text string, gt_voxels int, " + ", ".join(f"{e} double" for e in rt.EXTENT)


def best(rows, q, score, k):
    cand = [(-score(q, e), e[0], e[2], e[1]) for e in rows if e[0] != q[0] and e[4] > 0]
    return [(c, m, -s) for s, c, _p, m in sorted(cand)[:k]]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_slot_topk(spark, k):
    rows = bank_rows(11)
    bank = tx.with_packet(spark.createDataFrame(rows, BANK))
    slots = {(r.case_id, r.mask_id): r for r in bank.collect()}

    def score(q, e):
        a, b = slots[q[0], q[1]], slots[e[0], e[1]]
        s = 4.0 * (a.anatomy == b.anatomy) + 2.0 * (a.finding_type == b.finding_type) + (a.target_form == b.target_form)
        s += 2.0 * (a.level == b.level != "") + 0.5 * (a["count"] == b["count"])
        if a.side == b.side:
            return s + 2
        return s - (a.side != "none" and b.side != "none")

    got = {}
    for r in rt.slot_topk(bank, bank, k).collect():
        got.setdefault((r.case_id, r.mask_id), []).append((r["rank"], r.m_case_id, r.m_mask_id, r.score))
    for q in rows:
        want = [w for w in best(rows, q, score, k) if w[2] > 0]
        assert [g[1:] for g in sorted(got.get((q[0], q[1]), []))] == want


@pytest.mark.parametrize("k", [1, 3])
def test_tfidf_topk(spark, k):
    rows = bank_rows(12)
    stop = ["at", "in", "the"]
    n = len(rows)
    docs = []
    for r in rows:
        words = [w for w in r[3].lower().split() if len(w) > 1 and w not in stop]
        docs.append(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df_count = {}
    for d in docs:
        for t in set(d):
            df_count[t] = df_count.get(t, 0) + 1
    vecs = {}
    for r, d in zip(rows, docs):
        v = {t: (1 + math.log(d.count(t))) * (math.log((1 + n) / (1 + df_count[t])) + 1) for t in set(d)}
        norm = math.sqrt(sum(w * w for w in v.values()))
        vecs[r[0], r[1]] = {t: w / norm for t, w in v.items()}

    def score(q, e):
        a, b = vecs[q[0], q[1]], vecs[e[0], e[1]]
        return round(sum(w * b.get(t, 0.0) for t, w in a.items()), 9)

    bank = spark.createDataFrame(rows, BANK)
    got = {}
    for r in tf.tfidf_topk(bank, bank, stop, k).collect():
        got.setdefault((r.case_id, r.mask_id), []).append((r["rank"], r.m_case_id, r.m_mask_id))
    for q in rows:
        assert [g[1:] for g in sorted(got[q[0], q[1]])] == [w[:2] for w in best(rows, q, score, k)]


def test_tfidf_fills_up_in_bank_order(spark):
    ext = [0.5] * 6
    rows = [("a", 1, 0, "liver mass", 5, *ext), ("b", 1, 0, "toe cyst", 5, *ext), ("c", 1, 0, "rib spur", 5, *ext), ("d", 1, 0, "rib spur", 0, *ext)]
    bank = spark.createDataFrame(rows, BANK)
    hits = tf.tfidf_topk(bank.where("case_id = 'a'"), bank, [], 3).orderBy("rank").collect()
    assert [(h.m_case_id, h.score) for h in hits] == [("b", 0.0), ("c", 0.0)]
    assert rt.weighted_prior(tf.tfidf_topk(bank, bank, [], 3)).where("case_id = 'a'").first().z_min is None


def test_triplet_edges_and_blocks(spark):
    rows = [("a", z, [float(z)]) for z in range(23)]
    df = spark.createDataFrame(rows, "case_id string, z int, px array<float>")
    got = {r.z: (r.prev[0], r.curr[0], r.next[0]) for r in sl.slice_triplet(df, block=4).collect()}
    assert got == {z: (max(0, z - 1), z, min(22, z + 1)) for z in range(23)}


def index(spark, n_pos, n_neg):
    rows = [("a", 1, z, 1) for z in range(n_pos)] + [("a", 1, 100 + z, 0) for z in range(n_neg)]
    return spark.createDataFrame(rows, "case_id string, mask_id int, z int, is_positive int")


def test_ratio_sampler(spark):
    idx = index(spark, 3, 9)
    a = sp.posneg_sample(idx, num_samples=200, seed=1).collect()
    assert sum(r.is_positive for r in a) == 140 and len(a) == 200
    assert {r.z for r in a if r.is_positive} == {0, 1, 2} and all(r.z >= 100 for r in a if not r.is_positive)
    assert sorted(map(tuple, a)) == sorted(map(tuple, sp.posneg_sample(idx, num_samples=200, seed=1).collect()))
    assert sorted(map(tuple, a)) != sorted(map(tuple, sp.posneg_sample(idx, num_samples=200, seed=1, epoch=1).collect()))
    assert sp.posneg_sample(index(spark, 3, 0), num_samples=10).count() == 7
    with pytest.raises(Exception, match="no positive"):
        sp.posneg_sample(index(spark, 0, 4), num_samples=10).collect()


def test_negative_quota(spark):
    got = {n: sp.negative_sample(index(spark, n, 9)).groupBy("is_positive").count().collect() for n in (0, 2, 5)}
    counts = {n: {r.is_positive: r["count"] for r in rows} for n, rows in got.items()}
    assert counts == {0: {0: 3}, 2: {1: 2, 0: 6}, 5: {1: 5, 0: 9}}


def test_splits_are_disjoint_and_stable(spark):
    cases = spark.createDataFrame([(f"s{i}",) for i in range(97)], "case_id string")
    rows = sp.random_case_split(cases).collect()
    assert len({r.case_id for r in rows}) == len(rows) == 97
    assert sum(r.split == "train" for r in rows) == 77
