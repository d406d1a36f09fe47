"""Scores that other queries compare don't depend on the order of a sum."""

import random

from voxquarry.plans import catalog

HALF = [48, 28, 35, 34, 47, 48, 41, 18, 46, 31, 41, 42, 27, 39, 39, 21]  # / 50: mean 0.73125, below it summed in this order


def test_argmax_candidate_on_exact_halves(spark, tmp_path):
    """A mean of 0.73125 rounds up to that of the second candidate, so the first wins in every case."""
    rows = []
    for case in range(40):
        values = random.Random(case).sample(HALF, len(HALF))
        rows += [(375 * case, 0, 3, 3, float(q), float(x), 0.0, 0.0) for x, q in enumerate(values)]
        rows += [(375 * case, 0, 1, 1, 36.565, float(x), 0.0, 0.0) for x in range(2)]
    names = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.QUERIES["argmax_candidate"](spark, str(tmp_path)).collect()
    assert len(got) == 40 and {r.by_score for r in got} == {1}
