"""Stores that stay in place over epochs: tables bucketed and sorted by (case, z).

Pictures are shuffled once, when the store is made.  Samples are stored in the
same buckets, so an epoch joins both without moving either, and its order is a
projection (``shuffle.epoch_order``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .shuffle import epoch_order, numbered
from .voxels import SLICE, TARGET

PLACE = ["case_id", "z"]


def bucketed(df: DataFrame, keys: list[str], buckets: int, sort: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``keys``, one sorted file each, and read it as a table.

    Rows are dealt by the hash that names the buckets, so a task writes one
    file.  Joins and groups of such tables on these keys need no exchange if
    their numbers of buckets agree.  Forget a store with ``drop_store``.
    """
    spark = df.sparkSession
    name = f"store_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*(sort or keys))
    writer.format("parquet").option("path", scratch_path(spark, name)).saveAsTable(name)
    stored = spark.table(name)
    stored.store_name = name
    return stored


def drop_store(spark: SparkSession, stored: DataFrame) -> None:
    """Forget the table; its files lie in the shared folder, whose owner clears it."""
    spark.sql(f"DROP TABLE IF EXISTS {stored.store_name}")


def picture_store(triplets: DataFrame, buckets: int) -> DataFrame:
    """Slices with their neighbours, in buckets of (case, z)."""
    return bucketed(triplets, PLACE, buckets)


def sample_store(index: DataFrame, aux: DataFrame, targets: DataFrame, voxels: DataFrame, buckets: int) -> DataFrame:
    """Numbered samples without their pictures, in the same buckets: ``number`` runs from 0 in (case, mask, z) order."""
    pixels = voxels.groupBy(*SLICE).agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("gt_pixels"))  # of one slice
    rows = (
        index.join(aux.drop("slice_exist", "text", "pos"), TARGET)
        .join(targets.select(*TARGET, "text"), TARGET)
        .join(pixels, SLICE, "left")
    )
    return bucketed(numbered(rows, [*TARGET, "z"]), PLACE, buckets, [*PLACE, "mask_id"])


def epoch_rows(samples: DataFrame, pictures: DataFrame, n: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Samples of an epoch with their pictures and ``place``; joined bucket by bucket, nothing is shuffled.

    A slice without a picture keeps its row.  Sort a bucket's rows by
    ``place``, or write them by ranges of it, for the order of the epoch.
    """
    joined = samples.join(pictures.hint("merge"), PLACE, "left")
    return epoch_order(joined, n, seed, epoch)
