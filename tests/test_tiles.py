"""Components in tiles: labels don't depend on the tiling, arrays not on the frame."""

import random

import pytest
from pyspark.sql import functions as F

from voxquarry.operators import components as cc
from voxquarry.operators import tiles as tl

VOXEL = "case_id string, mask_id int, z int, y int, x int"


def blobs(seed):
    """Noise, a spiral through many tiles, diagonals across corners, a second mask over the first."""
    rng = random.Random(seed)
    out = {("a", 1, rng.randrange(5), rng.randrange(20), rng.randrange(20)) for _ in range(900)}
    x = y = 0
    lo, hi = 0, 30
    while lo < hi:
        out |= {("s", 1, 2, lo, k) for k in range(lo, hi)} | {("s", 1, 2, k, hi - 1) for k in range(lo, hi)}
        out |= {("s", 1, 2, hi - 1, k) for k in range(lo, hi)} | {("s", 1, 2, k, lo) for k in range(lo + 2, hi)}
        out |= {("s", 1, 2, lo + 2, lo + 1)}
        lo, hi = lo + 2, hi - 2
    out |= {("d", 1, 0, k, k) for k in range(25)} | {("d", 1, 0, 24 - k, 30 + k) for k in range(25)} | {("d", 2, 0, k, 7) for k in range(9)}
    out |= {("z", 1, k, 3 + k % 2, 3) for k in range(20)} | {("z", 1, k, 4, 3) for k in range(9)}
    return out


@pytest.mark.parametrize("tile", [(1, 1, 1), (4, 4, 4), (2, 3, 5), (16, 16, 16), (64, 64, 64)])
@pytest.mark.parametrize("dim,diagonal", [(3, False), (2, False), (2, True)])
def test_labels_for_any_tiles(spark, tile, dim, diagonal):
    if tile == (1, 1, 1) and dim == 3:
        pytest.skip("single voxels are tried in slices")
    df = spark.createDataFrame(sorted(blobs(dim)) * 2, VOXEL).repartition(4)
    want = sorted(map(tuple, cc.components(df.distinct(), dim, diagonal).collect()))
    assert sorted(map(tuple, tl.tiled_components(df, dim, diagonal, tile).collect())) == want


def test_arrays_stay_small(spark):
    """A frame four times as wide and high has no larger arrays."""
    for side in (40, 160):
        full = spark.range(side * side).select(
            F.lit("c").alias("case_id"), F.lit(1).alias("mask_id"), F.lit(0).alias("z"), (F.col("id") / side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x")
        )
        dotted = full.where("x % 2 = 0")
        sizes = [tl.gathered(tl.tile_runs(df, 16), (16, 16, 16)).agg(F.max(F.size("runs"))).first()[0] for df in (full, dotted)]
        assert sizes == [16, 16 * 8]


def test_no_voxels(spark):
    assert tl.tiled_components(spark.createDataFrame([], VOXEL)).collect() == []
    with pytest.raises(ValueError):
        tl.tiled_components(spark.createDataFrame([], VOXEL), 3, True)
