"""Evaluation reports over result rows (one row per target and run)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import join_on, quantiles, running, value_table


def _join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return join_on(left, right, keys)
    return left.withColumns({c: right.select(c).scalar() for c in right.columns})  # one row each


def result_summary(df: DataFrame, metric: str = "dice", keys: list[str] | None = None) -> DataFrame:
    """n, mean, exact median, share at or above 0.5 and share equal to 0."""
    keys = keys or []
    counted = value_table(df, keys, metric)
    v, c = F.col("value"), F.col("count")
    n, hit, zero = F.sum(F.when(v.isNotNull(), c).otherwise(0)), F.sum(F.when(v >= 0.5, c).otherwise(0)), F.sum(F.when(v == 0.0, c).otherwise(0))
    head = counted.groupBy(*keys).agg(
        n.alias("n"),
        F.try_divide(F.sum(v * c), n).alias("mean"),
        hit.alias("hit"),
        F.try_divide(hit * F.lit(100.0), n).alias("hit_pct"),
        zero.alias("zero"),
        F.try_divide(zero * F.lit(100.0), n).alias("zero_pct"),
    )
    return _join_on(head, quantiles(counted, keys, {"median": 0.5}), keys)


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Frequencies, most common first; ties by value."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(col))
    return out if n is None else out.limit(n)


def summary_by(df: DataFrame, col: str, metric: str = "dice", top: int | None = None) -> DataFrame:
    """``result_summary`` per value of ``col``, optionally its ``top`` most frequent values."""
    if top is not None:
        common = value_counts(df, col, top).select(col)
        df = df.join(common.withColumnRenamed(col, "_common"), F.col(col).eqNullSafe(F.col("_common")), "left_semi")
    return result_summary(df, metric, [col])


def grouping_report(df: DataFrame, dims: list[str], metric: str = "dice") -> DataFrame:
    """Overall summary and one per dimension, from one scan.

    Same rows as GROUPING SETS ((), (dim1), (dim2) ...): each input row feeds
    one row per set, so the exact median works for every set at once.
    """
    sets = F.array(
        F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("level")),
        *[F.struct(F.lit(d).alias("grouping"), F.col(d).cast("string").alias("level")) for d in dims],
    )
    long = df.select(metric, F.explode(sets).alias("s")).select(metric, "s.grouping", "s.level")
    return result_summary(long, metric, ["grouping", "level"])


# Upper bounds of the target-size classes, in voxels.
SIZE_BINS = [(50, "<50"), (500, "50-500"), (5000, "500-5K"), (50000, "5K-50K")]


def size_bin(voxels: Column) -> Column:
    out = F.when(voxels < SIZE_BINS[0][0], SIZE_BINS[0][1])
    for upper, name in SIZE_BINS[1:-1]:
        out = out.when(voxels < upper, name)
    upper, name = SIZE_BINS[-1]
    return out.when(voxels <= upper, name).otherwise(">50K")


def size_bins(df: DataFrame) -> DataFrame:
    """Per size class: n, mean Dice, mean predicted/true volume; empty targets excluded."""
    return (
        df.where(F.col("gt_voxels") > 0)
        .groupBy(size_bin(F.col("gt_voxels")).alias("size_bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("dice").alias("mean_dice"),
            F.avg(F.col("pred_voxels") / F.col("gt_voxels")).alias("mean_ratio"),
        )
    )


def overseg_ratio(df: DataFrame, limit: float = 3.0) -> DataFrame:
    ratio = F.col("pred_voxels") / F.col("gt_voxels")
    return df.where(F.col("gt_voxels") > 0).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(ratio).alias("mean_ratio"),
        F.count_if(ratio > limit).alias("n_over"),
        F.avg((ratio > limit).cast("double")).alias("share_over"),
    )


def empty_stats(df: DataFrame) -> DataFrame:
    """Empty predictions and targets with at least one boxed slice, per mode."""
    return df.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("pred_voxels") == 0).alias("empty_pred"),
        F.count_if(F.col("slices_used") > 0).alias("any_box"),
    )


RUN_KEYS = ["case_id", "mask_id", "mode"]


def runs_merge(direct: DataFrame, refined: DataFrame, oracle: DataFrame) -> DataFrame:
    """Direct and refined runs side by side (outer), with the oracle where known."""
    return direct.join(refined, RUN_KEYS, "full_outer").join(oracle, RUN_KEYS[:2], "left")


def run_compare(a: DataFrame, b: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """Rows both runs scored, with their difference b - a."""
    left = a.select(*keys, F.col("dice").alias("a")).where(F.col("a").isNotNull())
    right = b.select(*keys, F.col("dice").alias("b")).where(F.col("b").isNotNull())
    return left.join(right, keys).withColumn("delta", F.col("b") - F.col("a"))


def paired_delta(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Wins, ties and losses of ``b`` against ``a`` with the mean difference."""
    d = F.col(b) - F.col(a)
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(d > 0).alias("wins"),
        F.count_if(d == 0).alias("ties"),
        F.count_if(d < 0).alias("losses"),
        F.avg(d).alias("mean_delta"),
    )


def ceiling_retention(df: DataFrame, refined: str, oracle: str, keys: list[str] | None = None) -> DataFrame:
    """Refined over oracle score; pairs whose oracle is 0 are left out."""
    keys = keys or []
    rated = df.withColumn("ratio", F.try_divide(F.col(refined), F.col(oracle)))
    counted = value_table(rated, keys, "ratio")
    n = F.sum(F.when(F.col("value").isNotNull(), F.col("count")).otherwise(0))
    head = counted.groupBy(*keys).agg(
        n.alias("n"), F.try_divide(F.sum(F.col("value") * F.col("count")), n).alias("mean_retention")
    )
    return _join_on(head, quantiles(counted, keys, {"median_retention": 0.5}), keys)


def running_summary(df: DataFrame, order_cols: list[str], metric: str = "dice", pred: str = "pred_voxels") -> DataFrame:
    """Running mean and running count of empty predictions in processing order."""
    out = running(
        cut_lineage(df),  # read three times
        [],
        order_cols,
        {
            "_rows": ("sum", F.lit(1).cast("bigint")),
            "_sum": ("sum", F.col(metric)),
            "running_empty": ("sum", (F.col(pred) == 0).cast("bigint")),
        },
    )
    return out.withColumn("running_mean", F.col("_sum") / F.col("_rows")).drop("_rows", "_sum")


def best_epoch(history: DataFrame, metric: str, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Best value so far and whether an epoch improved on all earlier ones."""
    out = running(history, [run], [epoch], {"_past": ("max", F.col(metric))}, exclusive=True)
    return out.withColumns(
        {
            "improved": F.col("_past").isNull() | (F.col(metric) > F.col("_past")),
            "best_so_far": F.greatest(F.col(metric), F.col("_past")),
        }
    ).drop("_past")


def robustness_report(df: DataFrame, base: str = "raw", metric: str = "dice") -> DataFrame:
    """Change of a metric under each text variant against the base variant."""
    keys = ["case_id", "mask_id"]
    ref = df.where(F.col("variant") == base).select(*keys, F.col(metric).alias("base"))
    return (
        df.where(F.col("variant") != base)
        .join(ref, keys)
        .groupBy("variant")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col(metric) - F.col("base")).alias("mean_delta"),
            F.avg(F.abs(F.col(metric) - F.col("base"))).alias("mean_abs_delta"),
            F.count_if(F.col(metric) < F.col("base")).alias("worse"),
        )
    )
