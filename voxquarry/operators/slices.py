"""Dense slice rows ``(case_id, z, h, w, px)`` and training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_double, min_max, standardize, value_range
from .voxels import SLICE, TARGET

Z_BLOCK = 32


def slice_minmax(slices: DataFrame, eps: float = 1e-8) -> DataFrame:
    return slices.withColumn("px", min_max(as_double(F.col("px")), eps))


def slice_standardize(slices: DataFrame, mean: float, std: float) -> DataFrame:
    return slices.withColumn("px", standardize(as_double(F.col("px")), mean, std))


def constant_slice_filter(slices: DataFrame, eps: float = 1e-8) -> DataFrame:
    return slices.where(value_range(as_double(F.col("px"))) >= eps)


def scale_intensity(px: Column, mode: Column | str) -> Column:
    """Rescale [0,1] intensities: 'imagenet255', 'hu' or 'raw01'."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return (
        F.when(
            mode == "imagenet255",
            F.transform(px, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), v * 255.0))),
        )
        .when(mode == "hu", F.transform(px, lambda v: v * 2000.0 - 1000.0))
        .when(mode == "raw01", px)
    )


def export_scaled(slices: DataFrame, mode: str) -> DataFrame:
    if mode not in ("imagenet255", "hu", "raw01"):
        raise ValueError(f"unknown scale mode {mode!r}")
    return slices.withColumn("px", scale_intensity(as_double(F.col("px")), mode))


def value_profile(slices: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest, largest and mean intensity per key, folded inside each row first."""
    px = as_double(F.col("px"))
    per_row = slices.select(
        *keys,
        F.array_min(px).alias("lo"), F.array_max(px).alias("hi"),
        F.aggregate(px, F.lit(0.0), lambda a, v: a + v).alias("s"), F.size(px).alias("n"),
    )
    return per_row.groupBy(*keys).agg(
        F.min("lo").alias("vmin"), F.max("hi").alias("vmax"), (F.sum("s") / F.sum("n")).alias("vmean")
    )


def slice_triplet(slices: DataFrame, block: int = Z_BLOCK) -> DataFrame:
    """Previous, current and next slice with the edges repeated, also beside a missing slice.

    Windows run over blocks of ``block`` slices that carry one halo slice on
    each side, so pixels are shuffled about once and a deep volume is spread
    over many tasks.
    """
    z = F.col("z")
    own = F.floor(z / block)
    homes = F.array_distinct(F.array(F.floor((z - 1) / block), own, F.floor((z + 1) / block)))
    halo = slices.select("case_id", "z", "px", own.alias("_own"), F.explode(homes).alias("_block"))
    w = Window.partitionBy("case_id", "_block").orderBy("z")
    before = F.when(F.lag("z").over(w) == z - 1, F.lag("px").over(w))
    after = F.when(F.lead("z").over(w) == z + 1, F.lead("px").over(w))
    return (
        halo.select(
            "case_id", "z", "_own", "_block",
            F.coalesce(before, "px").alias("prev"),
            F.col("px").alias("curr"),
            F.coalesce(after, "px").alias("next"),
        )
        .where(F.col("_own") == F.col("_block"))
        .drop("_own", "_block")
    )


def slice_label_join(slices: DataFrame, boxes: DataFrame) -> DataFrame:
    """Slices that need scoring, once each, with all their prompts.

    The list holds one entry per target that touches the slice.
    """
    work = boxes.groupBy("case_id", "z").agg(
        F.sort_array(F.collect_list(F.struct("mask_id", "x1", "y1", "x2", "y2"))).alias("prompts")
    )
    return slices.join(work, ["case_id", "z"])


def training_rows(
    index: DataFrame, triplets: DataFrame, aux: DataFrame, targets: DataFrame, voxels: DataFrame
) -> DataFrame:
    """Assemble samples: image triplet, text, mask slice and auxiliary targets."""
    mask = voxels.groupBy(*SLICE).agg(
        F.sort_array(F.collect_list(F.struct("y", "x"))).alias("gt_pixels")
    )  # bounded by the pixels of one slice
    return (
        index.join(aux.drop("slice_exist", "text", "pos"), TARGET)
        .join(targets.select(*TARGET, "text"), TARGET)
        .join(mask, SLICE, "left")
        .join(triplets, ["case_id", "z"], "left")  # a slice without a picture keeps its row
    )
