"""Run algebra, distance maps and summed-volume tables against plain sets and arrays."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from voxquarry.operators import distance as ds
from voxquarry.operators import metrics as mt
from voxquarry.operators import runs as rn
from voxquarry.operators import summed as sm
from voxquarry.operators import voxels as vx

VOXEL = "case_id string, mask_id int, z int, y int, x int"
KEYS = ["case_id", "mask_id", "z", "y", "x"]


def masks(seed, n=900, side=14, cases=3):
    """Blobs, single voxels, an empty case and one mask with a third of all rows."""
    rng = random.Random(seed)
    out = set()
    for _ in range(n // 12):
        case = rng.choice(["big", *[f"c{k}" for k in range(cases)]])
        z, y, x = (rng.randrange(side) for _ in range(3))
        h, w = rng.randint(1, 6), rng.randint(1, 6)
        out |= {(case, 1, z, y + a, x + b) for a in range(h) for b in range(w)}
    return out


def table(spark, voxels, repeat=1):
    return spark.createDataFrame(sorted(voxels) * repeat, VOXEL).repartition(5)


def spelt(runs):
    rows = [(r.case_id, r.mask_id, r.z, r.y, r.x0, r.x1) for r in runs.collect()]
    for key, group in itertools.groupby(sorted(rows), key=lambda r: r[:4]):
        group = list(group)
        assert all(a[5] + 1 < b[4] for a, b in zip(group, group[1:])), "runs are maximal"
    return [(*r[:4], x) for r in rows for x in range(r[4], r[5] + 1)]


def test_run_algebra(spark):
    a, b = masks(1), masks(2)
    ra, rb = rn.stored_runs(table(spark, a, 2)), rn.stored_runs(table(spark, b))
    assert sorted(spelt(ra)) == sorted(a)
    for fn, want in ((rn.runs_and, a & b), (rn.runs_or, a | b), (rn.runs_minus, a - b), (rn.runs_xor, a ^ b)):
        assert sorted(spelt(fn(ra, rb))) == sorted(want)
    none = ra.where("false")
    assert spelt(rn.runs_and(ra, none)) == [] and sorted(spelt(rn.runs_or(none, rb))) == sorted(b) and spelt(rn.runs_minus(none, rb)) == []
    # runs that overlap or touch in one table
    loose = ra.unionByName(ra.withColumn("x1", F.col("x1") + 1)).unionByName(ra)
    assert sorted(spelt(rn.runs_or(loose, none))) == sorted(a | {(*v[:4], v[4] + 1) for v in a})


def test_overlap_from_runs(spark):
    a, b = masks(3), masks(4)
    ra, rb = rn.stored_runs(table(spark, a)), rn.stored_runs(table(spark, b))
    targets = spark.createDataFrame([(c, m) for c in ("big", "c0", "c1", "c2", "empty") for m in (1, 2)], "case_id string, mask_id int")
    got = rn.runs_overlap(ra, rb, targets).orderBy("case_id", "mask_id").collect()
    want = mt.overlap_metrics(table(spark, a), table(spark, b), targets).select(got[0].__fields__).orderBy("case_id", "mask_id").collect()
    assert got == want


def test_runs_move_less(spark):
    """Rows that the sweep sorts follow the runs; voxel tables move one row a voxel of either mask."""
    wide = {("c", 1, z, y, x) for z in range(3) for y in range(10) for x in range(200)}
    ra = rn.stored_runs(table(spark, wide))
    assert ra.count() == 30 and rn._segments(ra, ra).count() == 60
    row = rn.runs_overlap(ra, ra).first()
    assert (row.pred_pos, row.inter, row.dice) == (6000, 6000, 1.0)


@pytest.mark.parametrize("limit,tile", [(None, 0), (5, 5), (5, 7), (6, 64)])
def test_distance_map(spark, limit, tile):
    a = masks(5, 2000) | {("solid", 2, 0, y, x) for y in range(13) for x in range(-3, 12)}
    mask = table(spark, a, 2)
    more = {} if limit is None else {"limit": limit, "tile": tile}
    far = ds.distance_map(mask, **more).persist()
    rows = {tuple(r[:5]): r.distance for r in far.collect()}
    assert set(rows) == a and far.count() == len(a)
    for c, m, z, y, x in a:
        k = 1
        while all((c, m, z, y + i, x + s * (k - abs(i))) in a for i in range(-k, k + 1) for s in (-1, 1)):
            k += 1
        assert rows[c, m, z, y, x] == (k if limit is None else min(k, limit + 1))
    for k in range(1, 6):
        assert sorted(map(tuple, ds.erode_by(far, k).collect())) == sorted(map(tuple, vx.erode(mask, k).select(*KEYS).collect()))


def test_distance_map_is_one_pass(spark):
    plan = ds.distance_map(table(spark, masks(6)), limit=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("side", [4, 8, 32])
def test_box_mass(spark, side):
    a = masks(7, 2000) | {("solid", 2, z, y, x) for z in range(9) for y in range(3, 13) for x in range(20)}
    rng = random.Random(side)
    boxes = [(c, m, *sorted((rng.randint(-3, 22), rng.randint(-3, 22))), *sorted((rng.randint(-3, 22), rng.randint(-3, 22))), rng.randint(-3, 22), rng.randint(-3, 22), "tag")
             for c, m in (("big", 1), ("c0", 1), ("c1", 1), ("solid", 2), ("absent", 1)) for _ in range(25)]
    boxes += [("solid", 2, 0, 14, 0, 20, 0, 20, "all"), ("solid", 2, -9, 90, -9, 90, -9, 90, "beyond"), ("solid", 2, 3, 3, 0, 20, 0, 20, "empty")]
    df = spark.createDataFrame(boxes, "case_id string, mask_id int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int, tag string")
    sums = sm.summed_volume(table(spark, a, 2), 14, 20, 20, side)
    got = sm.box_mass(sums, df, 14, 20, 20, side)
    inside = {v for v in a if 0 <= v[2] < 14 and 0 <= v[3] < 20 and 0 <= v[4] < 20}
    want = sorted(map(tuple, sm.box_voxels(table(spark, inside), df).collect()))
    assert sorted(map(tuple, got.collect())) == sorted(set(want))
    assert {r.tag: r.mass for r in got.collect() if r.tag in ("all", "beyond", "empty")} == {"all": 1800, "beyond": 1800, "empty": 0}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_box_mass_of_weights(spark):
    rows = [("a", 1, 0, 0, 0, 5), ("a", 1, 0, 0, 0, 2), ("a", 1, 1, 2, 3, 7)]
    df = spark.createDataFrame(rows, VOXEL + ", w bigint")
    box = spark.createDataFrame([("a", 1, 0, 1, 0, 4, 0, 4), ("a", 1, 0, 2, 0, 4, 0, 4)], "case_id string, mask_id int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    assert sorted(r.mass for r in sm.box_mass(sm.summed_volume(df, 2, 4, 4, 2, weight="w"), box, 2, 4, 4, 2).collect()) == [7, 14]
