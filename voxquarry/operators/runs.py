"""Masks as horizontal runs, and algebra on them without voxels.

A run ``(case_id, mask_id, z, y, x0, x1)`` stands for its voxels, both ends
included.  Two masks meet by a sweep over each image row: the ends of their
runs are events in order of x, running sums of the events say in which masks
the stretch up to the next event lies.  Rows and shuffled bytes follow the
number of runs, whatever the area of the masks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, spread_rows
from .components import voxel_runs
from .metrics import dice_of, iou_of
from .voxels import SLICE, TARGET

ROW = [*SLICE, "y"]
RUN = [*ROW, "x0", "x1"]


def mask_runs(voxels: DataFrame) -> DataFrame:
    """Maximal runs of a voxel table; repeated voxels count once."""
    return voxel_runs(voxels).select(*RUN)


def stored_runs(voxels: DataFrame) -> DataFrame:
    """Runs written once to the shared folder, for many comparisons."""
    return cut_lineage(mask_runs(voxels))


def _segments(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stretches ``[x, next)`` of every image row between events, with how many runs of each mask cover them.

    One shuffle by image row, into tasks of bounded size: both tables are counted,
    so pass stored ones.  Runs may repeat or overlap.
    """

    def events(runs: DataFrame, in_a: int, in_b: int) -> DataFrame:
        ends = F.explode(F.array(
            F.struct(F.col("x0").alias("x"), F.lit(in_a).alias("a"), F.lit(in_b).alias("b")),
            F.struct((F.col("x1") + 1).alias("x"), F.lit(-in_a).alias("a"), F.lit(-in_b).alias("b")),
        ))
        return runs.where(F.col("x0") <= F.col("x1")).select(*ROW, ends.alias("e")).select(*ROW, "e.*")

    # the two ends of a row that meet in one place are one event
    every = spread_rows(events(a, 1, 0).unionByName(events(b, 0, 1)), 2 * (a.count() + b.count()), *ROW)
    every = every.groupBy(*ROW, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    row = Window.partitionBy(*ROW).orderBy("x")
    return every.select(
        *ROW, "x", F.lead("x").over(row).alias("next"), F.sum("a").over(row).alias("a"), F.sum("b").over(row).alias("b")
    )


def combine(a: DataFrame, b: DataFrame, holds: Callable[[Column, Column], Column]) -> DataFrame:
    """Maximal runs of the voxels for which ``holds(in_a, in_b)``; false outside of both."""
    row = Window.partitionBy(*ROW).orderBy("x")
    marked = _segments(a, b).withColumn("in", holds(F.col("a") > 0, F.col("b") > 0) & F.col("next").isNotNull())
    turns = marked.withColumn("was", F.lag("in", 1, False).over(row)).where(F.col("in") != F.col("was"))
    ends = turns.withColumn("end", F.lead("x").over(row))
    return ends.where("in").select(*ROW, F.col("x").alias("x0"), (F.col("end") - 1).alias("x1"))


def runs_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda p, q: p & q)


def runs_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda p, q: p | q)


def runs_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda p, q: p & ~q)


def runs_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda p, q: p != q)


def runs_overlap(pred: DataFrame, gt: DataFrame, targets: DataFrame | None = None, keys: list[str] = TARGET) -> DataFrame:
    """Voxel counts, Dice and IoU of two run tables, as ``metrics.overlap_metrics`` gives them of voxel tables.

    The sweep moves two rows a run; only partial counts move afterwards.
    """
    length = F.col("next") - F.col("x")

    def held(where: Column) -> Column:
        return F.sum(F.when(where, length).otherwise(0))

    counts = (
        _segments(pred, gt)
        .groupBy(*keys)
        .agg(
            held(F.col("a") > 0).alias("pred_pos"),
            held(F.col("b") > 0).alias("gt_pos"),
            held((F.col("a") > 0) & (F.col("b") > 0)).alias("inter"),
        )
    )
    if targets is not None:
        zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("pred_pos", "gt_pos", "inter")}
        counts = targets.join(counts, keys, "left").withColumns(zero)
    c = [F.col(n) for n in ("pred_pos", "gt_pos", "inter")]
    return counts.withColumns({"dice": dice_of(*c), "iou": iou_of(*c)})
