"""Bucketed stores: epochs join in place, with the same rows as the joins from scratch."""

import random

from pyspark.sql import functions as F

from voxquarry.operators import slices as sl
from voxquarry.operators import store as st


def data(spark):
    rng = random.Random(1)
    cases = ["big"] * 3 + [f"c{k}" for k in range(6)]
    slices = {(c, z) for c in cases for z in range(30 if c == "big" else 6)} - {("c2", 3)}
    pictures = spark.createDataFrame([(c, z, [float(z), rng.random()]) for c, z in sorted(slices)], "case_id string, z int, px array<double>")
    targets = [(c, m) for c in sorted(set(cases)) for m in (1, 2)]
    index = [(c, m, z, (z + m) % 2) for c, m in targets for z in range(6)]
    voxels = [(c, m, z, y, y + m) for c, m, z, p in index if p for y in range(3)]
    return (
        spark.createDataFrame(index, "case_id string, mask_id int, z int, is_positive int"),
        sl.slice_triplet(pictures),
        spark.createDataFrame([(c, m, 0.5) for c, m in targets], "case_id string, mask_id int, volume double"),
        spark.createDataFrame([(c, m, f"text {c} {m}") for c, m in targets], "case_id string, mask_id int, text string"),
        spark.createDataFrame(voxels, "case_id string, mask_id int, z int, y int, x int"),
    )


def test_epochs_in_place(spark):
    index, triplets, aux, targets, voxels = data(spark)
    pictures = st.picture_store(triplets, 4)
    samples = st.sample_store(index, aux, targets, voxels, 4)
    n = samples.count()
    want = sl.training_rows(index, triplets, aux, targets, voxels)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        places = []
        for epoch in (0, 1):
            rows = st.epoch_rows(samples, pictures, n, 7, epoch)
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan
            got = rows.collect()
            places.append([r.place for r in sorted(got, key=lambda r: r.number)])
            key = lambda r: (r.case_id, r.mask_id, r.z)
            assert [r.asDict() | {"number": 0, "place": 0} for r in sorted(got, key=key)] == [
                {c: r[c] for c in rows.columns if c not in ("number", "place")} | {"number": 0, "place": 0} for r in sorted(want.collect(), key=key)
            ]
        assert sorted(places[0]) == sorted(places[1]) == list(range(n)) and places[0] != places[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any(r.px is None if "px" in r else r.curr is None for r in st.epoch_rows(samples, pictures, n).collect())
    for store in (samples, pictures):
        st.drop_store(spark, store)
    assert not [t for t in spark.catalog.listTables() if t.name in (samples.store_name, pictures.store_name)]


def test_one_file_a_bucket(spark):
    df = spark.range(500).select(F.col("id").alias("case_id"), (F.col("id") % 7).alias("z"))
    stored = st.bucketed(df, ["case_id", "z"], 4)
    assert stored.select(F.input_file_name()).distinct().count() == 4 and stored.count() == 500
    st.drop_store(spark, stored)
