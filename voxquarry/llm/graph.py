"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_stage


def _print_of(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; the label is the smallest node that it reaches.

    Each round moves every node's edges towards its smallest neighbour, so
    diameters shrink by a constant factor and the number of rounds is
    logarithmic.  Minima are pre-aggregated per task and joined back, so a node
    with very many neighbours is never collected.  Rounds are written to the
    shared folder.
    """
    now = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _print_of(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        joined = large.join(least, F.col("a") == F.col("v"))
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
        read, now = now, cut_lineage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        after = _print_of(now)
        drop_stage(read)  # the new generation is stored
        if after == before:
            break
        before = after
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
