"""Overlap, localisation and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box3, centroid_err_norm, interval_recall, iou3d
from ..functions.losses import sigmoid
from .voxels import SLICE, TARGET, VOXEL


def overlap_counts(
    pred: DataFrame, gt: DataFrame, targets: DataFrame | None = None, keys: list[str] = TARGET
) -> DataFrame:
    """Voxel counts of prediction, ground truth and their intersection per key.

    Both masks meet on the full voxel position, so the wide shuffle is evenly
    spread; the second level only moves partial counts.
    """
    flags = pred.select(*VOXEL, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(
        gt.select(*VOXEL, F.lit(0).alias("p"), F.lit(1).alias("g"))
    )
    counts = (
        flags.groupBy(*VOXEL)
        .agg(F.max("p").alias("p"), F.max("g").alias("g"))
        .groupBy(*keys)
        .agg(
            F.sum("p").alias("pred_pos"),
            F.sum("g").alias("gt_pos"),
            F.sum(F.col("p") * F.col("g")).alias("inter"),
        )
    )
    if targets is None:
        return counts
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("pred_pos", "gt_pos", "inter")}
    return targets.join(counts, keys, "left").withColumns(zero)


def dice_of(p: Column, g: Column, inter: Column) -> Column:
    """Dice from counts; two empty masks agree perfectly."""
    return F.coalesce(F.try_divide(F.lit(2.0) * inter, p + g), F.lit(1.0))


def iou_of(p: Column, g: Column, inter: Column) -> Column:
    return F.coalesce(F.try_divide(inter.cast("double"), p + g - inter), F.lit(1.0))


def overlap_metrics(pred: DataFrame, gt: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Dice and IoU per target from one pass; every row of ``targets`` is scored."""
    c = [F.col(n) for n in ("pred_pos", "gt_pos", "inter")]
    return overlap_counts(pred, gt, targets).withColumns({"dice": dice_of(*c), "iou": iou_of(*c)})


def dice_score(pred: DataFrame, gt: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    return overlap_metrics(pred, gt, targets).drop("iou")


def iou_score(pred: DataFrame, gt: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    return overlap_metrics(pred, gt, targets).drop("dice")


def slice_dice(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """2-D Dice on every slice that holds ground truth."""
    c = overlap_counts(pred, gt, keys=SLICE).where(F.col("gt_pos") > 0)
    return c.withColumn("dice", dice_of(F.col("pred_pos"), F.col("gt_pos"), F.col("inter")))


def hit_counts(df: DataFrame, col: str = "dice", cuts=(0.5, 0.7, 0.9)) -> DataFrame:
    return df.agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        *[F.count_if(F.col(col) >= c).alias(f"ge_{int(c * 100)}") for c in cuts],
    )


def soft_dice(prob_gt: DataFrame, keys: list[str] = SLICE, eps: float = 1e-5) -> DataFrame:
    """Soft Dice of a probability map; eps sits in the denominator only."""
    return prob_gt.groupBy(*keys).agg(
        (
            F.lit(2.0) * F.sum(F.col("prob") * F.col("gt"))
            / (F.sum("prob") + F.sum("gt") + F.lit(eps))
        ).alias("soft_dice")
    )


def f1_columns(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1 that are 0 rather than NULL on empty denominators."""
    precision = tp / F.greatest(F.lit(1), tp + fp)
    recall = tp / F.greatest(F.lit(1), tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": F.lit(2.0) * precision * recall / F.greatest(F.lit(1e-9), precision + recall),
    }


def slice_f1(slices: DataFrame, keys: list[str], pred: str = "pred", gt: str = "gt") -> DataFrame:
    """F1 of binary slice flags at the grain of ``keys``; [] gives the micro score."""
    p, g = F.col(pred) == 1, F.col(gt) == 1
    counts = slices.groupBy(*keys).agg(
        F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn")
    )
    return counts.withColumns(f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def existence_acc(df: DataFrame, prob: str, gt: str, threshold: float = 0.5) -> DataFrame:
    hit = (F.col(prob) > threshold).cast("int") == F.col(gt)
    return df.agg(F.avg(hit.cast("double")).alias("existence_acc"))


def clf_metrics(df: DataFrame, prob: str, y: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision and recall with a >= cut."""
    p, g = F.col(prob) >= threshold, F.col(y) == 1
    return df.agg(
        F.avg((p == g).cast("double")).alias("acc"),
        (F.count_if(p & g) / F.greatest(F.lit(1), F.count_if(p))).alias("precision"),
        (F.count_if(p & g) / F.greatest(F.lit(1), F.count_if(g))).alias("recall"),
    )


CASE_VALUES = ["z1", "y1", "x1", "z2", "y2", "x2", "cz", "cy", "cx", "z_lo", "z_hi"]


def case_aggregate(slice_preds: DataFrame, values: list[str] = CASE_VALUES) -> DataFrame:
    """Per-target prediction from per-slice heads.

    Regressions average over slices judged present, or over all slices when
    none is; existence uses the largest logit.
    """
    on = sigmoid(F.col("slice_logit")) > 0.5
    return slice_preds.groupBy(*TARGET).agg(
        *[F.coalesce(F.avg(F.when(on, F.col(v))), F.avg(v)).alias(v) for v in values],
        sigmoid(F.max("existence_logit")).alias("existence_prob"),
    )


def aux_metrics(case_pred: DataFrame, slice_f1_df: DataFrame, aux: DataFrame) -> DataFrame:
    """Join case predictions with auxiliary labels; NULL where the target is absent."""
    g = aux.select(
        *TARGET, "existence", *[F.col(c).alias(f"g_{c}") for c in CASE_VALUES]
    )
    j = case_pred.join(g, TARGET).join(slice_f1_df.select(*TARGET, "f1"), TARGET, "left")
    here = F.col("existence") == 1
    gt_box = box3(prefix="g_")
    return j.select(
        *TARGET,
        F.col("existence").alias("existence_gt"),
        "existence_prob",
        F.col("f1").alias("slice_exist_f1"),
        F.when(here, iou3d(box3(), gt_box)).alias("bbox_iou_3d"),
        F.when(
            here,
            centroid_err_norm(
                [F.col("cz"), F.col("cy"), F.col("cx")], [F.col("g_cz"), F.col("g_cy"), F.col("g_cx")]
            ),
        ).alias("centroid_err_norm"),
        F.when(
            here, interval_recall(F.col("z_lo"), F.col("z_hi"), F.col("g_z_lo"), F.col("g_z_hi"))
        ).alias("z_range_recall"),
    )


def dev_summary(samples: DataFrame) -> DataFrame:
    """Means over a development pass; localisation means over existing targets only.

    Expects soft_dice, slice_prob, slice_gt, existence_prob, existence, and the
    per-sample iou / centroid_err / z_recall columns.
    """
    on, gt = F.col("slice_prob") > 0.5, F.col("slice_gt") == 1
    here = F.col("existence") == 1

    def mean(c: Column) -> Column:
        return F.coalesce(F.avg(c), F.lit(0.0))

    return samples.agg(
        mean(F.col("soft_dice")).alias("main_dice"),
        mean(((F.col("existence_prob") > 0.5) == here).cast("double")).alias("existence_acc"),
        mean(F.when(here, F.col("iou"))).alias("bbox_iou_pos"),
        mean(F.when(here, F.col("centroid_err"))).alias("centroid_err_norm"),
        mean(F.when(here, F.col("z_recall"))).alias("z_range_recall"),
        F.count_if(on & gt).alias("tp"), F.count_if(on & ~gt).alias("fp"), F.count_if(~on & gt).alias("fn"),
    ).withColumn(
        "slice_exist_f1", f1_columns(F.col("tp"), F.col("fp"), F.col("fn"))["f1"]
    ).drop("tp", "fp", "fn")


def masked_mean(value: Column, mask: Column) -> Column:
    """Mean over rows with mask 1; 0 when there is none."""
    return F.sum(value * mask) / F.greatest(F.sum(mask), F.lit(1.0))


# Weights of the auxiliary terms and the warm-up length in epochs.
TERM_WEIGHTS = {
    "existence": 0.3, "slice_exist": 0.5, "bbox": 0.3, "centroid": 0.1, "zrange": 0.2, "distill": 0.0,
}
RAMP_EPOCHS = 2


def ramp(epoch: Column, ramp_epochs: int = RAMP_EPOCHS) -> Column:
    if ramp_epochs <= 0:
        return F.lit(1.0)
    return F.least(F.lit(1.0), (epoch + 1) / F.lit(float(ramp_epochs)))


def composite_score(terms: DataFrame, weights: dict[str, float] = TERM_WEIGHTS, ramp_epochs: int = RAMP_EPOCHS) -> DataFrame:
    """Weighted total per epoch from long rows (epoch, term, value).

    The term 'main' has weight 1 and no warm-up.
    """
    w = F.when(F.col("term") == "main", F.lit(1.0))
    for name, value in weights.items():
        w = w.when(F.col("term") == name, F.lit(value) * ramp(F.col("epoch"), ramp_epochs))
    return terms.groupBy("epoch").agg(F.sum(w * F.col("value")).alias("total"))


def class_weight(samples: DataFrame, label: str = "y") -> DataFrame:
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return samples.agg(
        neg.alias("n_neg"), pos.alias("n_pos"),
        (F.greatest(neg, F.lit(1)) / F.greatest(pos, F.lit(1))).alias("pos_weight"),
    )
