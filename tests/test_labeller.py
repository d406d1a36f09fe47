"""Runs reach the labelling worker in batches, whatever the number of blocks."""

import pyarrow as pa
from pyspark.sql import functions as F

from voxquarry.operators import components as cc

PART = ["case_id", "mask_id", "_block"]


def batch(rows):
    names = [*PART, "z", "y", "x0", "x1"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def test_parts_that_go_on_in_the_next_batch():
    first = batch([(1, 1, 0, 0, 0, 3, 5), (1, 1, 1, 16, 0, 0, 1), (None, 1, 0, 0, 0, 2, 2)])
    rest = batch([(None, 1, 0, 0, 1, 2, 4), (None, 1, 0, 0, 3, 0, 0)])
    other = batch([(2, 1, 0, 0, 3, 0, 0), (2, 1, 0, 0, 4, 0, 1)])
    out = list(cc._labeller(PART, 0)(iter([first, rest.slice(0, 0), rest, other])))
    labels = [v for b in out for v in b.column("label").to_pylist()]
    at = lambda z, y, x: (z << cc.Z_SHIFT) + (y << cc.Y_SHIFT) + x
    assert labels == [at(0, 0, 3), at(16, 0, 0), at(0, 0, 2), at(0, 0, 2), at(0, 3, 0), at(0, 3, 0), at(0, 3, 0)]


def test_batches_hold_runs_not_blocks(spark):
    """600 blocks of 128 runs each, in Arrow batches of 100 rows: no batch holds more than 100 runs."""
    pixels = spark.range(600 * 128).select(
        F.floor(F.col("id") / 128).alias("case_id"), F.lit(1).cast("bigint").alias("mask_id"),
        F.floor(F.col("id") % 128 / 8).alias("z"), F.lit(0).cast("bigint").alias("y"), (F.col("id") % 8 * 2).alias("x"),
    )
    most = spark.sparkContext.accumulator(0)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    real = cc._labeller

    def counting(part, reach):
        label = real(part, reach)

        def seen(batches):
            def each():
                for b in batches:
                    most.add(max(0, len(b) - 100))
                    yield b

            return label(each())

        return seen

    cc._labeller = counting
    try:
        got = cc.components(pixels)
        assert got.count() == 600 * 128
        assert got.select("case_id", "label").distinct().count() == 600 * 8
    finally:
        cc._labeller = real
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert most.value == 0
