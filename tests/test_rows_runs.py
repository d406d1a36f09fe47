"""Sweeps over runs get tasks of bounded size."""

from voxquarry import session
from voxquarry.operators import runs as rn


def test_run_sweeps_get_more_tasks_with_more_runs(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    df = spark.range(2000).selectExpr("id div 100 AS case_id", "1L AS mask_id", "0L AS z", "id div 10 % 10 AS y", "id % 10 * 2 AS x")
    a = rn.stored_runs(df)
    got = rn.runs_and(a, a)
    assert got.rdd.getNumPartitions() == 80  # two ends each of 2 * 2000 runs
    assert got.count() == 2000
