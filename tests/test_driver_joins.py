"""Tables that grow are joined by shuffles: stored ones are small as files and large in the driver's memory."""

import pytest
from pyspark.sql import functions as F

from voxquarry.operators import boxes as bx
from voxquarry.operators import components as cc
from voxquarry.operators import retrieval as rt
from voxquarry.operators import tricks as tr
from voxquarry.session import cut_lineage

T = ["case_id", "mask_id"]


@pytest.fixture
def tables(spark):
    """Targets with extents, and voxels of rods that cross blocks of slices."""
    ext = {e: F.lit(v) for e, v in zip(rt.EXTENT, (0.0, 1.0, 0.0, 0.0, 1.0, 1.0))}
    slots = {s: F.lit("a") for s in rt.SLOTS}
    targets = spark.range(200).select(F.col("id").alias("case_id"), F.lit(1).cast("bigint").alias("mask_id"), F.col("id").alias("pos"))
    targets = cut_lineage(targets.withColumns({**ext, **slots, "post_rule": F.lit("keep_nearest"), "score": F.lit(5.0)}))
    zero, last = F.lit(0).cast("bigint"), F.lit(15).cast("bigint")
    voxels = targets.select(*T, F.explode(F.sequence(zero, last)).alias("z"), zero.alias("y"), zero.alias("x"))
    return targets, cut_lineage(voxels.withColumn("prob", F.lit(0.9)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_of_the_guided_report(tables):
    targets, voxels = tables
    bank = rt.prompt_bank(targets.select(*T, "pos", *rt.SLOTS), voxels, 16, 4, 4)
    hits = rt._pick(targets.select(*T, *rt.SLOTS), targets.select(*T, "pos", *rt.SLOTS, "score"), rt.SLOTS, 5)
    atlas = targets.select(*T, *[F.col(e).alias(f"atlas_{e}") for e in rt.EXTENT])
    blend = rt.prior_blend(atlas, targets.select(*T, "score", *rt.EXTENT))
    boxes = bx.prior_slices(bx.prior_to_pixels(targets.select(*T, *rt.EXTENT), 16, 4, 4)).select(*T, "z", "x1", "y1", "x2", "y2")
    inside = tr.inside_box(voxels, boxes)
    clean = cc.postprocess_route(voxels.select(*T, "z", "y", "x"), targets, targets.select(*T, *rt.EXTENT), 16, 4, 4)
    for df, rows in ((bank, 200), (hits, 1000), (blend, 200), (inside, 3200), (clean, 3200)):
        assert "BroadcastHashJoin" not in plan(df)
        assert df.count() == rows


def test_components_across_blocks(tables):
    runs = cc.component_runs(tables[1].select(*T, "z", "y", "x"), block=4)
    assert "BroadcastHashJoin" not in plan(runs)
    assert runs.select(*T, "label").distinct().count() == 200
