"""Distance maps get tasks of bounded size."""

from voxquarry import session
from voxquarry.operators import distance as ds


def test_maps_get_more_tasks_with_more_voxels(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    df = spark.range(2000).selectExpr("id div 100 AS case_id", "id % 1 + 1 AS mask_id", "id % 1 AS z", "id div 10 % 10 AS y", "id % 10 * 2 AS x")
    got = ds.distance_map(df)
    assert got.rdd.getNumPartitions() == 20
    assert got.where("distance = 1").count() == 2000
