"""Pair features, slice classifier and batched model scoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import pair_features as _pair
from ..functions.vectors import unit
from ..session import cut_lineage, ship_package


def pair_features(df: DataFrame, img: str, txt: str, out: str = "features") -> DataFrame:
    """[i, t, i*t, |i-t|] of the unit vectors of image and text."""
    both = df.withColumns({"_i": unit(F.col(img)), "_t": unit(F.col(txt))})
    return both.withColumn(out, _pair(F.col("_i"), F.col("_t"))).drop("_i", "_t")


def class_weighted(samples: DataFrame, label: str = "label") -> DataFrame:
    """Weight positives by max(negatives, 1) / max(positives, 1)."""
    pos, neg = samples.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()  # two numbers
    return samples.withColumn("weight", F.when(F.col(label) == 1, max(neg, 1) / max(pos, 1)).otherwise(1.0))


def slice_classifier(
    train: DataFrame, val: DataFrame, reg_params: tuple[float, ...] = (0.001, 0.01, 0.1), max_iter: int = 20
) -> LogisticRegressionModel:
    """Class-weighted slice relevance model, chosen by validation recall.

    Both inputs need ``features`` (array) and ``label``.  Ties keep the earlier
    setting, as a later epoch has to improve to replace the best one.
    """
    def vectors(df: DataFrame) -> DataFrame:
        # Every iteration reads the samples: store them instead of recomputing features.
        stored = cut_lineage(df.select("features", F.col("label").cast("double").alias("label")))
        return stored.withColumn("vec", array_to_vector(F.col("features"))).drop("features")

    fit_on = class_weighted(vectors(train)).persist()
    check = vectors(val).persist()
    best, best_recall = None, -1.0
    for reg in reg_params:
        model = LogisticRegression(
            featuresCol="vec", labelCol="label", weightCol="weight", regParam=reg, maxIter=max_iter
        ).fit(fit_on)
        hit = F.count_if((F.col("prediction") == 1) & (F.col("label") == 1))
        recall = model.transform(check).agg(hit / F.greatest(F.count_if(F.col("label") == 1), F.lit(1))).first()[0]
        if recall > best_recall:
            best, best_recall = model, recall
    fit_on.unpersist()
    check.unpersist()
    return best


def slice_probability(model: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    scored = model.transform(df.withColumn("vec", array_to_vector(F.col("features"))))
    return scored.withColumn("prob", F.get(vector_to_array("probability"), F.lit(1))).drop(
        "vec", "rawPrediction", "probability", "prediction"
    )


def batch_score(
    df: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], column: str, length: int,
    out: str = "score", batch_size: int = 64,
) -> DataFrame:
    """Score array rows with a user model: loaded once per worker, called on batches."""
    ship_package(df.sparkSession)
    udf = predict_batch_udf(
        make_model, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[length]]
    )
    return df.withColumn(out, udf(F.col(column)))
