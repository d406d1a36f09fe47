"""Data-driven thresholds of probability maps, per slice.

Slices are dense in meaning: pixels that are not stored count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .voxels import SLICE, VOXEL


def otsu_threshold(
    prob: DataFrame, h: int, w: int, bins: int = 256, lo_ok: float = 0.2, hi_ok: float = 0.9, fallback: float = 0.5
) -> DataFrame:
    """Otsu's threshold per slice, replaced by ``fallback`` outside [lo_ok, hi_ok].

    Only counted bins are ordered (at most ``bins`` rows per slice); an empty
    bin repeats the split of the bin on its left, so it can never be first.
    Counts and bin-index sums are integers, so the choice is exact.
    """
    pixels = h * w
    stats = prob.groupBy(*SLICE).agg(
        F.count(F.lit(1)).alias("n"), F.min("prob").alias("pmin"), F.max("prob").alias("pmax")
    ).select(
        *SLICE, "n",
        F.when(F.col("n") < pixels, F.least("pmin", F.lit(0.0))).otherwise(F.col("pmin")).alias("lo"),
        F.when(F.col("n") < pixels, F.greatest("pmax", F.lit(0.0))).otherwise(F.col("pmax")).alias("hi"),
    )

    def bin_of(v: Column) -> Column:
        span = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
        return F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / span * bins)).cast("bigint")

    stored = prob.join(stats, SLICE).groupBy(*SLICE, "n", "lo", "hi", bin_of(F.col("prob")).alias("bin")).agg(
        F.count(F.lit(1)).alias("c")
    )
    # Pixels that are not stored join the list of a slice's bins: a union here may be planned with partitions that don't match.
    implicit = F.when(F.col("n") < pixels, F.array(F.struct(bin_of(F.lit(0.0)).alias("bin"), (F.lit(pixels) - F.col("n")).alias("c"))))
    bins_of = stored.groupBy(*SLICE, "n", "lo", "hi").agg(F.collect_list(F.struct("bin", "c")).alias("bins"))
    every = bins_of.select(*SLICE, F.explode(F.concat("bins", F.coalesce(implicit, F.array()))).alias("b")).select(*SLICE, "b.*")
    hist = every.where(F.col("bin").isNotNull()).groupBy(*SLICE, "bin").agg(F.sum("c").alias("c"))
    whole = Window.partitionBy(*SLICE)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.select(
        *SLICE, "bin",
        F.sum("c").over(upto).alias("w1"),
        F.sum(F.col("c") * F.col("bin")).over(upto).alias("s1"),
        F.sum("c").over(whole).alias("wt"),
        F.sum(F.col("c") * F.col("bin")).over(whole).alias("st"),
    ).where(F.col("w1") < F.col("wt"))
    w1, w2 = F.col("w1").cast("double"), (F.col("wt") - F.col("w1")).cast("double")
    gap = F.col("s1") / w1 - (F.col("st") - F.col("s1")) / w2
    best = cum.withColumn("var", w1 * w2 * gap * gap).groupBy(*SLICE).agg(
        F.max_by("bin", F.struct(F.col("var"), -F.col("bin"))).alias("bin")
    )
    t = F.when(F.col("bin").isNull(), F.col("lo")).otherwise(
        F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    )
    return stats.join(best, SLICE, "left").withColumn("otsu", t).select(
        *SLICE,
        F.when((F.col("otsu") < lo_ok) | (F.col("otsu") > hi_ok), F.lit(fallback)).otherwise(F.col("otsu")).alias("threshold"),
    )


def otsu_mask(prob: DataFrame, h: int, w: int) -> DataFrame:
    t = otsu_threshold(prob, h, w)
    return prob.join(t, SLICE).where(F.col("prob") > F.col("threshold")).drop("threshold")


def percentile_threshold(sal: DataFrame, h: int, w: int, percentile: float = 90.0) -> DataFrame:
    """Linearly interpolated percentile of the dense slice (values are >= 0)."""
    pos = F.lit(percentile / 100.0 * (h * w - 1))
    per = Window.partitionBy(*SLICE)
    ranked = sal.select(
        *SLICE, "prob",
        (F.row_number().over(per.orderBy("prob")) - 1 + F.lit(h * w) - F.count(F.lit(1)).over(per)).alias("i"),
    )

    def at(index: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("i") == index, F.col("prob"))), F.lit(0.0))

    lo, hi = at(F.floor(pos)), at(F.ceil(pos))
    return ranked.groupBy(*SLICE).agg((lo + (hi - lo) * (pos - F.floor(pos))).alias("threshold"))


def percentile_mask(sal: DataFrame, h: int, w: int, percentile: float = 90.0, min_area: int = 20) -> DataFrame:
    """Pixels above the percentile; slices with fewer than ``min_area`` are dropped."""
    above = sal.join(percentile_threshold(sal, h, w, percentile), SLICE).where(F.col("prob") > F.col("threshold"))
    area = Window.partitionBy(*SLICE)
    return (
        above.withColumn("_n", F.count(F.lit(1)).over(area)).where(F.col("_n") >= min_area).select(*VOXEL)
    )


def threshold_fallback(sal: DataFrame, first: float = 0.5, second: float = 0.3, min_area: int = 50) -> DataFrame:
    """Pixels above ``first``; slices with too few of them use ``second``."""
    area = F.count_if(F.col("prob") > first).over(Window.partitionBy(*SLICE))
    return sal.withColumn("_t", F.when(area < min_area, F.lit(second)).otherwise(F.lit(first))).where(
        F.col("prob") > F.col("_t")
    ).select(*VOXEL)
