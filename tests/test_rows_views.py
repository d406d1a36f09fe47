"""Stored views are grouped in tasks of bounded size."""

from voxquarry import session
from voxquarry.plans.fixtures import VIEWS, Data


def test_stored_views_get_more_tasks_with_more_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    d = Data(spark, "/root/testdata/sf0.001")
    rows = d.table("lineitem").count()
    for view in ("vox", "dense"):
        got = d._view(view)
        assert got.rdd.getNumPartitions() == -(-rows // 100)
        assert got.exceptAll(d.sql(VIEWS[view])).count() == 0 and got.count() == d.sql(VIEWS[view]).count()
