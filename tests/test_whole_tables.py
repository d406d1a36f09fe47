"""Cases in which rows used to be lost: NULL groups, gaps, repeats, missing partners."""

import os

import pytest
from pyspark.sql import functions as F

from voxquarry import session
from voxquarry.operators import components, labels, ordering, prompts, reports, slices


def test_groups_without_numbers_stay(spark):
    rows = [("a", 0.2), ("a", 0.6), ("a", None), (None, 0.5), ("empty", None)]
    df = spark.createDataFrame(rows, "mode string, dice double")
    got = {r["mode"]: r for r in reports.result_summary(df, keys=["mode"]).collect()}
    assert set(got) == {"a", None, "empty"}
    assert (got["a"].n, got["a"]["median"], got[None]["median"]) == (2, 0.4, 0.5)
    assert got["empty"].n == 0 and got["empty"]["mean"] is None and got["empty"]["median"] is None
    total = reports.result_summary(df).collect()
    assert len(total) == 1 and total[0].n == 3
    levels = {(r.grouping, r.level) for r in reports.grouping_report(df, ["mode"]).collect()}
    assert levels == {("all", "all"), ("mode", "a"), ("mode", None), ("mode", "empty")}
    kept = reports.ceiling_retention(df.withColumn("oracle", F.lit(0.5)), "dice", "oracle", ["mode"]).collect()
    assert {(r["mode"], r.n) for r in kept} == {("a", 2), (None, 1), ("empty", 0)}
    assert {r["mode"] for r in reports.summary_by(df, "mode", top=2).collect()} == {"a", None}


def test_repeated_voxels_count_once(spark):
    voxels = spark.createDataFrame([(1, 1, 0, 0, x) for x in (0, 1, 1, 2)], "case_id int, mask_id int, z int, y int, x int")
    runs = components.component_runs(voxels).collect()
    assert [(r.x0, r.x1) for r in runs] == [(0, 2)]


@pytest.mark.parametrize("block", [2, 5, 32])
def test_neighbours_across_gaps(spark, block):
    df = spark.createDataFrame([(1, z, [float(z)]) for z in (0, 1, 2, 3, 5, 6)], "case_id int, z int, px array<double>")
    got = {r.z: (r.prev[0], r.next[0]) for r in slices.slice_triplet(df, block=block).collect()}
    assert got == {0: (0, 1), 1: (0, 2), 2: (1, 3), 3: (2, 3), 5: (5, 6), 6: (5, 6)}


def test_prompts_without_vector_stay(spark):
    prompt = spark.createDataFrame([("a",), ("b",), ("b",)], "prompt string")
    inventory = prompts.prompt_inventory(prompt)
    vectors = spark.createDataFrame([(0, [1.0])], "prompt_id bigint, embedding array<double>")
    got = prompts.embed_join(prompt, inventory, vectors).collect()
    assert sorted((r.prompt, r.embedding is None) for r in got) == [("a", False), ("b", True), ("b", True)]


def test_siblings_are_cyclic(spark):
    rows = [(1, 2, "lung", "mass", "x"), (1, 5, "lung", "mass", "y"), (1, 9, "lung", "mass", "z"), (2, 1, "lung", "mass", "alone")]
    df = spark.createDataFrame(rows, "case_id int, mask_id int, anatomy string, finding_type string, text string")
    got = prompts.hard_negatives(df).where("kind = 'sibling'").collect()
    assert {(r.case_id, r.mask_id, r.negative) for r in got} == {(1, 2, "y"), (1, 5, "z"), (1, 9, "x")}


def test_required_inputs_names_gaps(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    with pytest.raises(ValueError, match="b"):
        labels.required_inputs(cases, cases.where("case_id = 'a'"))


def test_buckets_are_even_and_ordered(spark):
    df = spark.range(20_000).select((F.xxhash64("id") % 1000).alias("k"), "id")
    got = ordering.order_bucket(df, ["k", "id"], buckets=16)
    sizes = got.groupBy("_bucket").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("_bucket").collect()
    assert len(sizes) == 17 and max(r.n for r in sizes) < 3 * 20_000 / 16
    assert all(a.hi <= b.lo for a, b in zip(sizes, sizes[1:]))
    assert ordering.bucket_count(spark) == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_stages_end_with_their_scope(spark):
    shared = session.shared_dir(spark)
    held = set(os.listdir(shared))
    voxels = spark.createDataFrame([(1, 1, z, 0, 0) for z in range(60)], "case_id int, mask_id int, z int, y int, x int")
    with session.stage_scope(spark):
        got = components.component_runs(voxels, block=4).select("label").distinct().count()
        assert set(os.listdir(shared)) - held
    assert got == 1 and set(os.listdir(shared)) == held
