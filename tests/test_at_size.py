"""Faults that showed on large tables, on small ones."""

from pyspark.sql import functions as F

from voxquarry.operators import thresholds as th
from voxquarry.operators import tricks as tr


def test_otsu_without_a_union(spark, tmp_path):
    """Planned as large tables are: the union of stored and other pixels had partitions that a join couldn't zip."""
    grid = spark.range(4 * 3 * 100).selectExpr("id div 300 AS case_id", "1L AS mask_id", "id div 100 % 3 AS z", "id div 10 % 10 AS y", "id % 10 AS x")
    inner = F.col("y").between(2, 7) & F.col("x").between(2, 7)
    grid.withColumn("prob", F.when(inner, 0.8).otherwise(0.1)).write.parquet(str(tmp_path / "prob"))
    prob = spark.read.parquet(str(tmp_path / "prob"))
    large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in large}
    try:
        for k, v in large.items():
            spark.conf.set(k, v)
        got = tr.refine(prob, {"otsu", "erosion", "confidence_gate"}, 16, 16)
        assert got.count() == 4 * 3 * 16
        assert th.otsu_mask(prob, 16, 16).count() == 4 * 3 * 36
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
