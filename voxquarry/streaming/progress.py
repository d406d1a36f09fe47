"""Progress figures over result files that keep arriving.

The batch operator ``reports.running_summary`` orders finished rows; while an
evaluation still writes, the same two figures (mean metric, empty predictions)
are a complete-mode aggregate over the growing folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def result_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("header", "true").csv(path)


def progress(rows: DataFrame, keys: list[str], metric: str = "dice", pred: str = "pred_voxels") -> DataFrame:
    """Rows so far, mean metric and empty predictions per key; works on streams and tables."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(metric).alias("mean"),
        F.count_if(F.col(pred) == 0).alias("empty"),
    )
