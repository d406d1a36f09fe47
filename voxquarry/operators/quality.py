"""Intermediate quality of prompts and boxes, before any mask is produced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES, interval_recall, iou3d, volume3d
from .voxels import SLICE, TARGET


def _named_box(names: dict[str, str]):
    return F.struct(*[F.col(src).alias(dst) for dst, src in names.items()])


def prompt_quality(priors: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Parse coverage, centroid hits, slice recall, box IoU and volume ratio per group.

    ``priors`` has normalised z_min..x_max and the parsed anatomy; ``truth``
    the half-open boxes and centroids of existing targets.
    """
    j = priors.join(truth, TARGET)
    p = _named_box({f"{a}{i}": f"{a}_{m}" for i, m in ((1, "min"), (2, "max")) for a in AXES})
    g = _named_box({f"{a}{i}": f"{a}{i}" for i in (1, 2) for a in AXES})
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(f"c{a}").between(F.col(f"{a}_min"), F.col(f"{a}_max"))
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("anatomy") != "unknown").cast("double")).alias("parse_coverage"),
        F.avg(inside.cast("double")).alias("centroid_inside"),
        F.avg(interval_recall(F.col("z_min"), F.col("z_max"), F.col("z1"), F.col("z2"))).alias("z_recall"),
        F.avg(iou3d(p, g)).alias("box_iou"),
        F.avg(volume3d(p) / F.nullif(volume3d(g), F.lit(0.0))).alias("volume_ratio"),
    )


def failure_modes(boxes: DataFrame, truth: DataFrame, too_large: float = 3.0, off_centre: float = 0.5) -> DataFrame:
    """Class of every boxed or true slice of a target.

    empty: truth without box; wrong_slice: box without truth; too_large: box
    area above ``too_large`` times the true box; off_centre: centres further
    apart than ``off_centre`` of the true half diagonal; else ok.
    """
    b = boxes.where(F.col("x1").isNotNull()).select(*SLICE, *[F.col(c).alias("b_" + c) for c in ("x1", "y1", "x2", "y2")])
    t = truth.select(*SLICE, *[F.col(c).alias("t_" + c) for c in ("x1", "y1", "x2", "y2")])
    j = b.join(t, SLICE, "full_outer")

    def area(s: str):
        return (F.col(s + "x2") - F.col(s + "x1")) * (F.col(s + "y2") - F.col(s + "y1"))

    def mid(s: str, a: str):
        return (F.col(f"{s}{a}1") + F.col(f"{s}{a}2")) / F.lit(2.0)

    def half(a: str):
        return (F.col(f"t_{a}2") - F.col(f"t_{a}1")) / F.lit(2.0)

    shift = F.sqrt(F.pow(mid("b_", "x") - mid("t_", "x"), 2.0) + F.pow(mid("b_", "y") - mid("t_", "y"), 2.0))
    reach = F.sqrt(half("x") * half("x") + half("y") * half("y"))
    return j.select(
        *SLICE,
        F.when(F.col("b_x1").isNull(), "empty")
        .when(F.col("t_x1").isNull(), "wrong_slice")
        .when(area("b_") > F.lit(too_large) * area("t_"), "too_large")
        .when(shift > F.lit(off_centre) * reach, "off_centre")
        .otherwise("ok")
        .alias("failure"),
    )
