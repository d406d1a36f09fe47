"""Auxiliary labels of targets, label fallbacks and case selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import component_runs
from .voxels import SLICE, TARGET


def aux_labels(voxels: DataFrame, targets: DataFrame, d: int, h: int, w: int) -> DataFrame:
    """Existence, per-slice flags, box, centroid, z-range, volume, component count.

    Boxes are half-open fractions; a target without voxels gets zeros.
    """
    runs = component_runs(voxels)
    n = F.col("x1") - F.col("x0") + 1
    total = F.sum(n)
    # One pass over the labelled runs; the set holds at most d slice numbers.
    stats = runs.groupBy(*TARGET).agg(
        total.alias("voxels"),
        F.count_distinct("label").alias("component_count"),
        F.collect_set(F.col("z").cast("int")).alias("zs"),
        (F.min("z") / F.lit(float(d))).alias("z1"), ((F.max("z") + 1) / F.lit(float(d))).alias("z2"),
        (F.min("y") / F.lit(float(h))).alias("y1"), ((F.max("y") + 1) / F.lit(float(h))).alias("y2"),
        (F.min("x0") / F.lit(float(w))).alias("x1"), ((F.max("x1") + 1) / F.lit(float(w))).alias("x2"),
        (F.sum(F.col("z") * n) / total / F.lit(float(d))).alias("cz"),
        (F.sum(F.col("y") * n) / total / F.lit(float(h))).alias("cy"),
        (F.sum((F.col("x0") + F.col("x1")) * n) / total / F.lit(2.0 * w)).alias("cx"),
    )
    joined = targets.join(stats, TARGET, "left")
    zero = F.lit(0.0)
    floats = ["z1", "y1", "x1", "z2", "y2", "x2", "cz", "cy", "cx"]
    return joined.select(
        *targets.columns,
        F.when(F.col("voxels").isNotNull(), 1).otherwise(0).alias("existence"),
        F.transform(
            F.sequence(F.lit(0), F.lit(d - 1)),
            lambda z: F.coalesce(F.array_contains("zs", z), F.lit(False)).cast("int"),
        ).alias("slice_exist"),
        *[F.coalesce(c, zero).alias(c) for c in floats],
        F.coalesce("z1", zero).alias("z_lo"),
        F.coalesce("z2", zero).alias("z_hi"),
        F.coalesce(F.col("voxels") / F.lit(float(d * h * w)), zero).alias("volume"),
        F.coalesce("component_count", F.lit(0).cast("bigint")).alias("component_count"),
    )


def slice_index(aux: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per (case, mask, slice) of the chosen cases with its presence flag."""
    return aux.join(cases.select("case_id").distinct(), "case_id", "left_semi").select(
        *TARGET, F.posexplode("slice_exist").alias("z", "is_positive")
    )


def case_index(targets: DataFrame, cases: DataFrame) -> DataFrame:
    return targets.select(*TARGET).join(cases.select("case_id").distinct(), "case_id", "left_semi")


def case_complete(files: DataFrame, kinds: list[str]) -> DataFrame:
    """Cases that own a file of every required kind."""
    need = F.array(*[F.lit(k) for k in kinds])
    return (
        files.where(F.col("kind").isin(kinds))
        .groupBy("case_id")
        .agg(F.collect_set("kind").alias("have"))
        .where(F.size(F.array_except(need, "have")) == 0)
        .select("case_id")
    )


def case_limit(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` cases in name order; 0 keeps all."""
    if n <= 0:
        return df
    first = df.select("case_id").distinct().orderBy("case_id").limit(n)
    return df.join(first, "case_id", "left_semi")


def label_fallback(targets: DataFrame, voxels: DataFrame) -> DataFrame:
    """Targets plus, for cases without any text, their stored labels with empty text."""
    bare = voxels.select(*TARGET).distinct().join(
        targets.select("case_id").distinct(), "case_id", "left_anti"
    )
    return targets.select(*TARGET, "text").unionByName(bare.withColumn("text", F.lit("")))


def missing_inputs(cases: DataFrame, aux: DataFrame) -> DataFrame:
    return cases.select("case_id").distinct().join(aux.select("case_id").distinct(), "case_id", "left_anti")


def required_inputs(cases: DataFrame, aux: DataFrame) -> DataFrame:
    """The cases unchanged, or an error naming some that lack auxiliary labels."""
    lost = missing_inputs(cases, aux).limit(10).select("case_id").collect()  # at most 10 names
    if lost:
        raise ValueError("auxiliary labels missing for: " + ", ".join(str(r[0]) for r in lost))
    return cases


def top2_boxes(top: DataFrame, h: int, w: int, margin: int = 5) -> DataFrame:
    """One box per slice for each kept component."""
    from .boxes import bbox2d_fixed

    return bbox2d_fixed(top, h, w, margin, keys=[*SLICE, "cc_rank"])
