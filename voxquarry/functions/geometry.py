"""Column expressions over boxes, intervals and points.

3-D boxes are structs ``<z1,y1,x1,z2,y2,x2>`` and 2-D boxes ``<x1,y1,x2,y2>``;
coordinates are always addressed by name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
BOX3 = [f"{a}{i}" for i in (1, 2) for a in AXES]


def box3(*, prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).cast("double").alias(c) for c in BOX3])


def _product(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out * c
    return out


def _positive(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def volume3d(b: Column) -> Column:
    return _product([_positive(b[a + "2"] - b[a + "1"]) for a in AXES])


def intersection3d(p: Column, g: Column) -> Column:
    return _product(
        [
            _positive(F.least(p[a + "2"], g[a + "2"]) - F.greatest(p[a + "1"], g[a + "1"]))
            for a in AXES
        ]
    )


def iou3d(p: Column, g: Column) -> Column:
    """Axis-aligned IoU; 0 where the union is (almost) empty."""
    inter = intersection3d(p, g)
    union = volume3d(p) + volume3d(g) - inter
    return F.when(union > 1e-9, inter / union).otherwise(F.lit(0.0))


def giou3d_loss(p: Column, g: Column, eps: float = 1e-6) -> Column:
    """1 - generalised IoU; ``eps`` enters the union and the enclosing volume."""
    inter = intersection3d(p, g)
    union = volume3d(p) + volume3d(g) - inter + F.lit(eps)
    hull = _product(
        [
            _positive(F.greatest(p[a + "2"], g[a + "2"]) - F.least(p[a + "1"], g[a + "1"]))
            for a in AXES
        ]
    ) + F.lit(eps)
    return F.lit(1.0) - (inter / union - (hull - union) / hull)


def interval_recall(plo: Column, phi: Column, glo: Column, ghi: Column) -> Column:
    cover = _positive(F.least(phi, ghi) - F.greatest(plo, glo))
    return cover / F.greatest(ghi - glo, F.lit(1e-9))


def centroid_err_norm(p: list[Column], g: list[Column]) -> Column:
    total = sum(((a - b) * (a - b) for a, b in zip(p, g)), F.lit(0.0))
    return F.sqrt(total) / F.lit(math.sqrt(3.0))


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def flip_box(b: Column, size: int) -> Column:
    """Mirror a 2-D box left to right in a frame ``size`` pixels wide."""
    return F.struct(
        (F.lit(size) - b["x2"]).alias("x1"),
        b["y1"].alias("y1"),
        (F.lit(size) - b["x1"]).alias("x2"),
        b["y2"].alias("y2"),
    )


def bbox_valid(b: Column) -> Column:
    return (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])


def bbox_or_full_axis(b: Column, h: int, w: int) -> Column:
    """Replace an axis whose extent is not positive by the whole axis."""
    bad_x, bad_y = b["x2"] <= b["x1"], b["y2"] <= b["y1"]
    return F.struct(
        F.when(bad_x, F.lit(0)).otherwise(b["x1"]).alias("x1"),
        F.when(bad_y, F.lit(0)).otherwise(b["y1"]).alias("y1"),
        F.when(bad_x, F.lit(w)).otherwise(b["x2"]).alias("x2"),
        F.when(bad_y, F.lit(h)).otherwise(b["y2"]).alias("y2"),
    )


def bbox_scale(b: Column, fx: float, fy: float) -> Column:
    """Pure rescale, e.g. to the 1024-pixel prompt space; stays fractional."""
    return F.struct(
        (b["x1"] * F.lit(fx)).alias("x1"),
        (b["y1"] * F.lit(fy)).alias("y1"),
        (b["x2"] * F.lit(fx)).alias("x2"),
        (b["y2"] * F.lit(fy)).alias("y2"),
    )


def bbox_rescale_padded(b: Column, h: int, w: int, frame: float = 224.0, pad: int = 3) -> Column:
    """Map from a square saliency frame to pixels, pad and clamp."""

    def px(c: Column, size: int) -> Column:
        return (c * F.lit(size / frame)).cast("int")

    return F.struct(
        F.greatest(F.lit(0), px(b["x1"], w) - pad).alias("x1"),
        F.greatest(F.lit(0), px(b["y1"], h) - pad).alias("y1"),
        F.least(F.lit(w), px(b["x2"], w) + pad).alias("x2"),
        F.least(F.lit(h), px(b["y2"], h) + pad).alias("y2"),
    )
