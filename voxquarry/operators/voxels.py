"""Relational algebra on sparse voxel tables ``(case_id, mask_id, z, y, x)``.

Background is not stored.  Every grouping key below contains at least the
slice, so one large volume never lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET = ["case_id", "mask_id"]
SLICE = ["case_id", "mask_id", "z"]
VOXEL = ["case_id", "mask_id", "z", "y", "x"]


def mask_select(voxels: DataFrame, mask_id: int) -> DataFrame:
    return voxels.where(F.col("mask_id") == mask_id)


def slice_needed(voxels: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Slices on which any wanted label occurs."""
    if targets is not None:
        voxels = voxels.join(targets.select(*TARGET).distinct(), TARGET, "left_semi")
    return voxels.select("case_id", "z").distinct()


def present_labels(targets: DataFrame, voxels: DataFrame) -> DataFrame:
    return targets.join(voxels.select(*TARGET).distinct(), TARGET, "left_semi")


def voxel_count(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy(*TARGET).agg(F.count(F.lit(1)).alias("voxels"))


def volume_fraction(voxels: DataFrame, dims: DataFrame) -> DataFrame:
    """Voxel count over the case volume; ``dims`` is (case_id, d, h, w)."""
    return voxel_count(voxels).join(dims, "case_id").select(
        *TARGET, "voxels",
        (F.col("voxels") / (F.col("d").cast("double") * F.col("h") * F.col("w"))).alias("volume"),
    )


def threshold_fixed(prob: DataFrame, t: float | Column) -> DataFrame:
    return prob.where(F.col("prob") > t)


def flip_horizontal(voxels: DataFrame, w: int) -> DataFrame:
    return voxels.withColumn("x", F.lit(w - 1) - F.col("x"))


def _offset_array(offsets: list[tuple[int, int, int]]) -> Column:
    return F.array(
        *[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in offsets]
    )


FACE_OFFSETS = [(0, 0, 1), (0, 1, 0), (1, 0, 0)]


def neighbor_join(voxels: DataFrame, offsets=FACE_OFFSETS) -> DataFrame:
    """Adjacent same-label voxel pairs: (z,y,x) and its neighbour (nz,ny,nx)."""
    shifted = voxels.select(*VOXEL).withColumn("o", F.explode(_offset_array(offsets))).select(
        *TARGET, "z", "y", "x",
        (F.col("z") + F.col("o.dz")).alias("nz"),
        (F.col("y") + F.col("o.dy")).alias("ny"),
        (F.col("x") + F.col("o.dx")).alias("nx"),
    )
    other = voxels.select(
        *TARGET, F.col("z").alias("nz"), F.col("y").alias("ny"), F.col("x").alias("nx")
    )
    return shifted.join(other, [*TARGET, "nz", "ny", "nx"]).select(*VOXEL, "nz", "ny", "nx")


def erode(mask: DataFrame, iterations: int = 1) -> DataFrame:
    """2-D erosion with the cross, outside counted as background.

    n rounds with the cross equal one round with the diamond of radius n, so
    any number of iterations is one shuffle.
    """
    n = iterations
    diamond = [
        (0, dy, dx) for dy in range(-n, n + 1) for dx in range(-n, n + 1) if abs(dy) + abs(dx) <= n
    ]
    votes = mask.select(*VOXEL).distinct().withColumn("o", F.explode(_offset_array(diamond))).select(
        *SLICE, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")
    )
    return (
        votes.groupBy(*VOXEL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(diamond)).drop("n")
    )


def confidence_gate(mask_prob: DataFrame, min_mean: float | Column = 0.55) -> DataFrame:
    """Drop slices whose mean probability inside the mask is below ``min_mean``."""
    w = Window.partitionBy(*SLICE)
    return (
        mask_prob.withColumn("_conf", F.avg("prob").over(w))
        .where(F.col("_conf") >= min_mean)
        .drop("_conf")
    )


def first_writer_merge(preds: DataFrame) -> DataFrame:
    """One label per voxel: the lowest id that claims it."""
    return preds.groupBy("case_id", "z", "y", "x").agg(F.min("mask_id").alias("mask_id"))


def slice_or_merge(preds: DataFrame) -> DataFrame:
    """Union of several predictions of the same target."""
    return preds.select(*VOXEL).distinct()


def flip_vote(a: DataFrame, b: DataFrame) -> DataFrame:
    """Vote of two binary masks with threshold one half: their union."""
    return slice_or_merge(a.select(*VOXEL).union(b.select(*VOXEL)))


def prob_ensemble(probs: DataFrame, n: int) -> DataFrame:
    """Mean probability over ``n`` runs; a voxel missing from a run counts as 0."""
    return probs.groupBy(*VOXEL).agg((F.sum("prob") / F.lit(float(n))).alias("prob"))


def body_mask_gate(saliency: DataFrame, ct: DataFrame, min_ct: float = 0.05) -> DataFrame:
    """Keep saliency only where the CT value exceeds ``min_ct``."""
    body = ct.where(F.col("ct") > min_ct).select("case_id", "z", "y", "x")
    return saliency.join(body, ["case_id", "z", "y", "x"], "left_semi")


def gamma_sharpen(sal: DataFrame, gamma: float, h: int, w: int) -> DataFrame:
    """sal**gamma, then min-max over the dense slice (absent pixels are 0)."""
    win = Window.partitionBy(*SLICE)
    powered = sal.withColumn("_p", F.pow(F.col("prob"), F.lit(float(gamma)))).withColumns(
        {
            "_n": F.count(F.lit(1)).over(win),
            "_lo": F.min("_p").over(win),
            "_hi": F.max("_p").over(win),
        }
    )
    lo = F.when(F.col("_n") < h * w, F.least(F.col("_lo"), F.lit(0.0))).otherwise(F.col("_lo"))
    span = F.col("_hi") - lo
    return powered.select(
        *VOXEL,
        F.when(span < 1e-8, F.lit(0.0)).otherwise((F.col("_p") - lo) / F.nullif(span, F.lit(0.0))).alias("prob"),
    )
