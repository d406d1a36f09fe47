"""Boxes derived from voxels and their bulk transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clamp
from ..session import cut_lineage
from .ordering import rank_within
from .voxels import SLICE, TARGET


def _extent2d(voxels: DataFrame, keys: list[str]) -> DataFrame:
    return voxels.groupBy(*keys).agg(
        F.min("x").cast("int").alias("x0"), F.min("y").cast("int").alias("y0"),
        F.max("x").cast("int").alias("xm"), F.max("y").cast("int").alias("ym"),
    )


def _with_margin(ext: DataFrame, keys: list[str], margin: Column, h: int, w: int) -> DataFrame:
    return ext.select(
        *keys,
        F.greatest(F.lit(0), F.col("x0") - margin).alias("x1"),
        F.greatest(F.lit(0), F.col("y0") - margin).alias("y1"),
        F.least(F.lit(w), F.col("xm") + margin).alias("x2"),
        F.least(F.lit(h), F.col("ym") + margin).alias("y2"),
    )


def bbox2d_fixed(voxels: DataFrame, h: int, w: int, margin: int = 5, keys: list[str] = SLICE) -> DataFrame:
    """Per-slice box; the far side is the largest coordinate plus the margin."""
    return _with_margin(_extent2d(voxels, keys), keys, F.lit(margin), h, w)


def bbox2d_adaptive(
    voxels: DataFrame, h: int, w: int, ratio: float = 0.1, lo: int = 2, hi: int = 15, keys: list[str] = SLICE
) -> DataFrame:
    """Per-slice box whose margin grows with the longer side of the target."""
    ext = _extent2d(voxels, keys)
    side = F.greatest(F.col("xm") - F.col("x0"), F.col("ym") - F.col("y0"))
    return _with_margin(ext, keys, clamp((F.lit(ratio) * side).cast("int"), lo, hi), h, w)


def hash_number(key: Column) -> Column:
    """First 60 bits of the SHA-256 of a text: a draw that any engine can repeat, for classes of any size."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("bigint")


def bbox_jitter(boxes: DataFrame, h: int, w: int, n: int = 5, px: int = 3, seed: int = 0) -> DataFrame:
    """``n`` copies of each slice box with every side moved by up to ``px`` pixels.

    Offsets come from a seeded hash of the box key, so a retry repeats them.
    """
    out = boxes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def off(i: int) -> Column:
        key = F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in SLICE], F.col("copy").cast("string"), F.lit(i))
        return (hash_number(key) % (2 * px + 1) - px).cast("int")

    return out.select(
        *SLICE, "copy",
        F.greatest(F.lit(0), F.col("x1") + off(0)).alias("x1"),
        F.greatest(F.lit(0), F.col("y1") + off(1)).alias("y1"),
        F.least(F.lit(w), F.col("x2") + off(2)).alias("x2"),
        F.least(F.lit(h), F.col("y2") + off(3)).alias("y2"),
    )


def centroid2d(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy(*SLICE).agg(
        F.avg("x").cast("int").alias("cx"), F.avg("y").cast("int").alias("cy")
    )


def box3d_half_open(voxels: DataFrame, d: int, h: int, w: int, keys: list[str] = TARGET) -> DataFrame:
    """Normalised 3-D box with an exclusive far side, plus the centroid."""
    size = {"z": d, "y": h, "x": w}
    aggs = []
    for a, n in size.items():
        aggs += [
            (F.min(a) / F.lit(float(n))).alias(f"{a}1"),
            ((F.max(a) + 1) / F.lit(float(n))).alias(f"{a}2"),
            (F.avg(a) / F.lit(float(n))).alias(f"c{a}"),
        ]
    return voxels.groupBy(*keys).agg(*aggs)


def prior_to_pixels(
    prior: DataFrame, d: int, h: int, w: int, margin: int = 10, z_margin: int = 1, full_axis: bool = True
) -> DataFrame:
    """Normalised prior -> slice range and pixel box; empty axes become whole ones."""

    def px(c: str, n: int) -> Column:
        return (F.col(c) * F.lit(float(n))).cast("int")

    box = {
        "x1": F.greatest(F.lit(0), px("x_min", w) - margin),
        "y1": F.greatest(F.lit(0), px("y_min", h) - margin),
        "x2": F.least(F.lit(w), px("x_max", w) + margin),
        "y2": F.least(F.lit(h), px("y_max", h) + margin),
    }
    if full_axis:
        bad_x, bad_y = box["x2"] <= box["x1"], box["y2"] <= box["y1"]
        box = {
            "x1": F.when(bad_x, F.lit(0)).otherwise(box["x1"]),
            "y1": F.when(bad_y, F.lit(0)).otherwise(box["y1"]),
            "x2": F.when(bad_x, F.lit(w)).otherwise(box["x2"]),
            "y2": F.when(bad_y, F.lit(h)).otherwise(box["y2"]),
        }
    return prior.withColumns(
        {
            "z0": F.greatest(F.lit(0), px("z_min", d) - z_margin),
            "z1": F.least(F.lit(d - 1), px("z_max", d) + z_margin),
            **box,
        }
    )


def prior_slices(pixels: DataFrame) -> DataFrame:
    """One row per slice of the range ``z0..z1``; an empty range gives none."""
    return pixels.where(F.col("z1") >= F.col("z0")).withColumn(
        "z", F.explode(F.sequence(F.col("z0"), F.col("z1")))
    )


def argmax_candidate(cands: DataFrame, keys: list[str], score: str = "pred_iou", by: str = "candidate") -> DataFrame:
    """Candidate with the highest score; the first one wins a tie."""
    best = F.max_by(F.struct("*"), F.struct(F.col(score), -F.col(by)))
    return cands.groupBy(*keys).agg(best.alias("b")).select("b.*")


def smallest_candidate(cands: DataFrame, keys: list[str], area: str = "area", by: str = "candidate") -> DataFrame:
    """Candidate with the smallest non-zero area; all-zero groups keep the first one."""
    size = F.when(F.col(area) > 0, F.col(area).cast("double")).otherwise(F.lit(float("inf")))
    best = F.min_by(F.struct("*"), F.struct(size, F.col(by)))
    return cands.groupBy(*keys).agg(best.alias("b")).select("b.*")


def focus_rank(saliency: DataFrame, h: int, w: int, coverage_above: float = 0.3) -> DataFrame:
    """Keep the better-focused half of the slices of each target.

    Focus is the peak times the share of pixels not above ``coverage_above``.
    """
    per_slice = saliency.groupBy(*SLICE).agg(
        (
            F.max("prob") * (F.lit(1.0) - F.count_if(F.col("prob") > coverage_above) / F.lit(float(h * w)))
        ).alias("focus")
    )
    per_slice = cut_lineage(per_slice.withColumn("_worst", -F.col("focus")))
    half = per_slice.groupBy(*TARGET).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 2)).alias("_keep"))
    ranked = rank_within(per_slice, TARGET, ["_worst", "z"])
    return ranked.join(half, TARGET).where(F.col("rank") <= F.col("_keep")).drop("_worst", "_keep")


def slice_gate(boxes: DataFrame, slice_prob: DataFrame, threshold: float | Column) -> DataFrame:
    """Blank the box of every slice whose relevance probability is too low."""
    joined = boxes.join(slice_prob, SLICE, "left")
    drop = F.col("slice_prob") < threshold
    return joined.withColumns(
        {c: F.when(drop, F.lit(None)).otherwise(F.col(c)).cast("int") for c in ("x1", "y1", "x2", "y2")}
    )
