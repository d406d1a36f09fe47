"""Queries that label components hand the worker runs by the Arrow batch, not all runs of a partition."""

import pytest
from pyspark.sql import functions as F

from voxquarry.operators import components as cc
from voxquarry.plans.catalog import QUERIES
from voxquarry.plans.fixtures import Data

SF = "/root/testdata/sf0.001"
ROWS = 100  # of an Arrow batch


def largest_part(voxels, depth):
    """Runs of the largest block, which a worker holds besides one batch."""
    runs = cc.voxel_runs(voxels).withColumn("_block", F.floor(F.col("z") / depth))
    return runs.groupBy("case_id", "mask_id", "_block").count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize(
    "name, view, depth",
    [
        ("posneg_sample_counts", "gt", 16),  # F6
        ("aux_json_io", "gt", 16),  # F7
        ("largest_cc", "dense", 16),  # F8
        ("components_across_blocks", "dense", 4),  # F9
        ("negative_sample", "gt", 16),  # F10
        ("nearest_component", "dense", 16),  # F11
        ("components", "dense", 16),  # F12
        ("min_size_filter", "dense", 16),  # F13
        ("postprocess_route", "dense", 16),  # F14
        ("epoch_order", "gt", 16),  # F19
        ("posneg_sample", "gt", 16),  # F20
    ],
)
def test_worker_holds_a_batch_and_a_block(spark, monkeypatch, name, view, depth):
    seen, most = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    limit = ROWS + largest_part(getattr(Data(spark, SF), view), depth)
    real = cc._label_blocks

    def counting(block, z, *rest):
        seen.add(len(z))
        most.add(max(0, len(z) - limit))
        return real(block, z, *rest)

    monkeypatch.setattr(cc, "_label_blocks", counting)
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # all blocks in one task
    try:
        assert QUERIES[name](spark, SF).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert seen.value > 2 * limit
    assert most.value == 0
