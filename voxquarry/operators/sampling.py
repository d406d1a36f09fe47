"""Deterministic splits and ratio-controlled samples.

All randomness is a seeded hash of the row key: the same draw on every retry
and on every cluster size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .boxes import hash_number
from .ordering import bucket_count, global_rank, rank_within
from .voxels import TARGET


def _hash_key(*parts) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def _rank_by_hash(df: DataFrame) -> DataFrame:
    """Rank by the hex hash ``h``; its first digits are ready-made even buckets, as many as the session is wide."""
    digits = max(1, math.ceil(math.log(bucket_count(df.sparkSession), 16)))
    return global_rank(df, ["h", "case_id"], bucket=F.substring("h", 1, digits))


def hash_split(cases: DataFrame, n_train: int = 150, n_dev: int = 30, n_test: int = 28) -> DataFrame:
    """Cut the cases, ordered by SHA-256 of their name, into exact counts.

    Equal-length lower-case hex sorts like the number it writes.  Evaluating
    the result fails if there are too few cases.
    """
    total = n_train + n_dev + n_test
    distinct = cases.select("case_id").distinct()
    have = distinct.agg(F.count(F.lit(1))).scalar()
    ranked = _rank_by_hash(distinct.withColumn("h", F.sha2(F.col("case_id").cast("string"), 256)))
    split = (
        F.when(have < total, F.raise_error(F.concat(F.lit("too few cases: "), have.cast("string"))))
        .when(F.col("rank") <= n_train, "train")
        .when(F.col("rank") <= n_train + n_dev, "dev")
        .otherwise("test")
    )
    return ranked.where(F.col("rank") <= total).select("case_id", split.alias("split"))


def random_case_split(cases: DataFrame, frac: float = 0.8, seed: int = 42) -> DataFrame:
    """Shuffle the cases by a seeded hash and cut at the floor of ``frac``."""
    distinct = cases.select("case_id").distinct()
    n_train = F.floor(distinct.agg(F.count(F.lit(1))).scalar() * F.lit(frac))
    ranked = _rank_by_hash(distinct.withColumn("h", _hash_key(F.lit(seed), F.col("case_id"))))
    return ranked.select(
        "case_id", F.when(F.col("rank") <= n_train, "train").otherwise("val").alias("split")
    )


def negative_sample(index: DataFrame, ratio: int = 3, seed: int = 0) -> DataFrame:
    """All positive slices and up to max(ratio * positives, ratio) negatives per target."""
    h = _hash_key(F.lit(seed), F.col("case_id"), F.col("mask_id"), F.col("z"))
    keyed = cut_lineage(index.withColumn("_h", h))
    quota = keyed.groupBy(*TARGET).agg(
        F.greatest(F.sum("is_positive") * ratio, F.lit(ratio)).alias("_quota")
    )
    negatives = rank_within(keyed.where(F.col("is_positive") == 0), TARGET, ["_h", "z"], "_r")
    kept = negatives.join(quota, TARGET).where(F.col("_r") <= F.col("_quota"))
    return keyed.where(F.col("is_positive") == 1).drop("_h").unionByName(kept.drop("_h", "_r", "_quota"))


def posneg_sample(
    index: DataFrame, ratio: float = 0.7, num_samples: int | None = None, seed: int = 0, epoch: int = 0
) -> DataFrame:
    """Draw with replacement: a share ``ratio`` of positive slices, the rest negative.

    Without negatives only the positive part is drawn; without positives
    evaluation fails.  Sort by ``order_key`` for the shuffled order.
    """
    spark = index.sparkSession
    keyed = cut_lineage(index.select(*TARGET, "z", "is_positive"))
    n = keyed.count() if num_samples is None else num_samples
    n_pos = round(n * ratio)
    ranked = rank_within(keyed, ["is_positive"], [*TARGET, "z"], "_r").withColumn("_r", F.col("_r") - 1)
    sizes = keyed.agg(F.count_if(F.col("is_positive") == 1).alias("p"), F.count_if(F.col("is_positive") == 0).alias("n"))
    pos, neg = sizes.select("p").scalar(), sizes.select("n").scalar()
    draw = spark.range(n).withColumnRenamed("id", "draw")
    is_pos = (F.col("draw") < n_pos).cast("int")
    class_size = F.when(
        is_pos == 1, F.when(pos == 0, F.raise_error(F.lit("no positive slices"))).otherwise(pos)
    ).otherwise(neg)
    draws = (
        draw.withColumns({"is_positive": is_pos, "_size": class_size})
        .where(F.col("_size") > 0)
        .select(
            "draw", "is_positive",
            (hash_number(F.concat_ws("|", F.lit(seed), F.lit(epoch), F.col("draw").cast("string"))) % F.col("_size")).alias("_r"),
            hash_number(F.concat_ws("|", F.lit(seed), F.lit(epoch), F.lit("order"), F.col("draw").cast("string"))).alias("order_key"),
        )
    )
    return draws.join(ranked, ["is_positive", "_r"]).drop("_r")
