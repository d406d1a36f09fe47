"""Configurable refinement of probability maps, and sweeps over its settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffled
from . import boxes as bx
from . import components as cc
from . import thresholds as th
from . import voxels as vx
from .metrics import dice_of
from .voxels import SLICE, TARGET, VOXEL

TRICKS = {"adaptive_margin", "ensemble", "otsu", "erosion", "confidence_gate", "cc2d", "cc3d"}


def inside_box(prob: DataFrame, boxes: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Probability pixels inside the box of their slice (far side exclusive)."""
    j = prob.join(shuffled(boxes), keys)
    return j.where(
        (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    ).drop("x1", "y1", "x2", "y2")


def fixed_threshold_of(tricks: set[str], default: float = 0.5) -> float:
    """Cut named by a 'threshold_<t>' entry; malformed entries are ignored."""
    for t in sorted(tricks):
        if t.startswith("threshold_"):
            try:
                default = float(t.split("_")[1])
            except ValueError:
                pass
    return default


def refine(
    prob: DataFrame, tricks: set[str], h: int, w: int, *, prompt: DataFrame | None = None, min_conf: float = 0.55,
    copies: int = 5, seed: int = 0,
) -> DataFrame:
    """Box, threshold, erosion, confidence gate and component steps as one lazy plan.

    ``prompt`` are voxels whose per-slice boxes limit the map; the model that
    would score inside a box is the caller's (see ``learning.batch_score``).
    ``ensemble`` scores jittered copies of each box and takes the mean
    probability; ``prob`` may have a column ``copy`` with the map of each copy.
    """
    if prompt is not None:
        boxes = bx.bbox2d_adaptive(prompt, h, w) if "adaptive_margin" in tricks else bx.bbox2d_fixed(prompt, h, w)
        if "ensemble" in tricks:
            boxes = bx.bbox_jitter(boxes, h, w, n=copies, seed=seed)
            keys = [*SLICE, "copy"] if "copy" in prob.columns else SLICE
            prob = vx.prob_ensemble(inside_box(prob, boxes, keys).select(*VOXEL, "prob"), copies)
        else:
            prob = inside_box(prob, boxes)
    if "otsu" in tricks:
        mask = th.otsu_mask(prob, h, w)
    else:
        mask = vx.threshold_fixed(prob, fixed_threshold_of(tricks))
    if "erosion" in tricks:
        mask = mask.join(vx.erode(mask), VOXEL, "left_semi")
    if "confidence_gate" in tricks:
        mask = vx.confidence_gate(mask, min_conf)
    if "cc2d" in tricks:
        mask = cc.largest_cc(mask, dim=2)
    if "cc3d" in tricks:
        mask = cc.largest_cc(mask, dim=3)
    return mask.select(*VOXEL)


def ablation_sweep(prob_gt: DataFrame, grid: list[tuple[str, float, float]]) -> DataFrame:
    """Dice of every configuration (name, threshold, min confidence) in one pass.

    Voxels are read and shuffled once: each configuration is three sums per
    slice, unfolded into rows only after that reduction.
    """
    aggs = []
    for i, (_, t, _c) in enumerate(grid):
        on = F.col("prob") > t
        aggs += [
            F.count_if(on).alias(f"p{i}"),
            F.count_if(on & (F.col("g") == 1)).alias(f"i{i}"),
            F.sum(F.when(on, F.col("prob")).otherwise(0.0)).alias(f"s{i}"),
        ]
    per_slice = prob_gt.groupBy(*SLICE).agg(F.sum("g").alias("gt_pos"), *aggs)
    configs = F.array(
        *[
            F.struct(
                F.lit(name).alias("config"), F.lit(conf).alias("conf"), F.col(f"p{i}").alias("p"),
                F.col(f"i{i}").alias("i"), F.col(f"s{i}").alias("s"),
            )
            for i, (name, _t, conf) in enumerate(grid)
        ]
    )
    rows = per_slice.select(*SLICE, "gt_pos", F.explode(configs).alias("c")).select(*SLICE, "gt_pos", "c.*")
    kept = F.col("s") >= F.col("conf") * F.col("p")
    return (
        rows.groupBy("config", *TARGET)
        .agg(
            F.sum("gt_pos").alias("gt_pos"),
            F.sum(F.when(kept, F.col("p")).otherwise(0)).alias("pred_pos"),
            F.sum(F.when(kept, F.col("i")).otherwise(0)).alias("inter"),
        )
        .withColumn("dice", dice_of(F.col("pred_pos"), F.col("gt_pos"), F.col("inter")))
    )
