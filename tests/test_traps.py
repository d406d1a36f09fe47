"""One small hand-made case per semantic trap of the reference semantics."""

import math

import pytest
from pyspark.sql import functions as F

from voxquarry.functions import geometry as geo
from voxquarry.functions import text as tx
from voxquarry.functions.losses import bce_with_logits
from voxquarry.operators import boxes as bx
from voxquarry.operators import components as cc
from voxquarry.operators import labels as lb
from voxquarry.operators import metrics as mt
from voxquarry.operators import prompts as pr
from voxquarry.operators import reports as rp
from voxquarry.operators import retrieval as rt
from voxquarry.operators import sampling as sp
from voxquarry.operators import thresholds as th
from voxquarry.operators import voxels as vx
from voxquarry.sources import tables as tb

VOX = "case_id string, mask_id int, z int, y int, x int"


def vox(spark, points, case="a", mask=1):
    return spark.createDataFrame([(case, mask, *p) for p in points], VOX)


def one(df):
    return df.collect()[0].asDict()


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")


def column(df, col):
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_empty_masks_agree(spark):  # T1, T2
    targets = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "case_id string, mask_id int")
    gt, pred = vox(spark, [(0, 0, 0)]), vox(spark, [(0, 0, 0)], mask=3)
    rows = {r.mask_id: r for r in mt.overlap_metrics(pred, gt, targets).collect()}
    assert (rows[2].dice, rows[2].iou) == (1.0, 1.0)
    assert (rows[1].dice, rows[1].iou, rows[3].dice) == (0.0, 0.0, 0.0)
    soft = spark.createDataFrame([("a", 1, 0, 0.0, 0)], "case_id string, mask_id int, z int, prob double, gt int")
    assert one(mt.soft_dice(soft))["soft_dice"] == 0.0


def test_extent_conventions(spark):  # T3
    v = vox(spark, [(1, 2, 3), (3, 4, 7)])
    aux = one(bx.box3d_half_open(v, 4, 8, 8))
    assert (aux["z1"], aux["z2"], aux["x2"]) == (0.25, 1.0, 1.0)
    t = spark.createDataFrame([("a", 1, 0, "x"), ("a", 9, 1, "y")], "case_id string, mask_id int, pos int, text string")
    bank = {r.mask_id: r for r in rt.prompt_bank(t, v, 4, 8, 8).collect()}
    assert (bank[1].z_max, bank[1].x_max) == (0.75, 0.875)
    assert (bank[9].z_min, bank[9].gt_voxels) == (-1.0, 0)


def test_box_margins(spark):  # T4
    v = vox(spark, [(0, 1, 1), (0, 30, 61)])
    b = one(bx.bbox2d_fixed(v, 64, 64))
    assert (b["x1"], b["y1"], b["x2"], b["y2"]) == (0, 0, 64, 35)
    a = one(bx.bbox2d_adaptive(v, 64, 64))
    assert (a["x1"], a["x2"], a["y2"]) == (0, 64, 36)


def test_keyword_order(spark):  # T6
    df = texts(spark, "A bright liver spot", "discrete change", "gallbladder stone", "urinary bladder wall", "nothing")
    assert column(df, tx.laterality(F.col("text"))) == ["right", "none", "none", "none", "none"]
    assert column(df, tx.anatomy(F.col("text"))) == ["liver", "spine", "gallbladder", "bladder", "unknown"]


def test_finding_whole_words(spark):  # T7
    df = texts(spark, "Enlarged LYMPH NODES seen", "masses and a cyst", "amassed tissue", "small calculi", "tumours")
    got = column(df, tx.finding_regex(F.col("text")))
    assert got == ["lymph node", "cyst", "lesion", "calculus", "tumor"]


def test_side_and_count(spark):  # T8
    df = texts(spark, "left and right lung", "both lungs", "several nodules", "left")
    assert column(df, tx.laterality(F.col("text"))) == ["bilateral", "bilateral", "none", "left"]
    assert column(df, tx.count_focality(F.col("text"))) == ["single", "multiple", "multiple", "single"]


def test_packet_rules(spark):
    df = texts(
        spark, "mass at C5 of the upper lung lobe", "fracture of L4", "splenomegaly", "multiple lung nodules", "emphysema", "T10 level"
    )
    rows = [r.asDict() for r in tx.with_packet(df).orderBy("i").collect()]
    assert [r["level"] for r in rows] == ["upper", "L4", "", "", "", "T10"]
    assert [r["target_form"] for r in rows] == ["focal", "bony", "diffuse", "multifocal", "diffuse", "focal"]
    assert [r["post_rule"] for r in rows] == ["keep_nearest", "keep_multi", "organ_roi", "keep_multi", "keep_multi", "keep_nearest"]


def test_shorten_and_keyword(spark):
    long = "A very long finding text that is seen in the liver, " + "and more words " * 10
    df = texts(spark, "Mass (benign) is seen here", long, " ".join(f"w{i}" for i in range(20)), "a  b\tc d e f")
    got = column(df, tx.shorten_text(F.col("text")))
    assert got[0] == "Mass   here"
    assert got[1] == "A very long finding text that  in the liver"
    assert got[2] == " ".join(f"w{i}" for i in range(15))
    assert column(df, tx.anatomy_keyword(F.col("text")))[1:] == ["liver", "w0 w1 w2 w3 w4", "a b c d e"]
    df = texts(spark, "rib and nodule and lesion")
    assert column(df, tx.anatomy_keyword(F.col("text"))) == ["nodule"]


def test_first_sentence(spark):
    df = texts(spark, "  One. Two.", "no stop")
    assert column(df, tx.first_sentence(F.col("text"))) == ["One.", "no stop."]


def test_implicit_zeros_and_guard(spark):  # T9, T10
    s = "case_id string, mask_id int, z int, y int, x int, prob double"
    two = spark.createDataFrame([("a", 1, 0, 0, x, 0.9) for x in range(4)], s)
    t = one(th.otsu_threshold(two, 4, 4))["threshold"]
    assert t == 0.5  # 12 zeros and 4 times 0.9: the raw cut is below 0.2
    full = spark.createDataFrame([("a", 1, 0, y, x, 0.5) for y in range(2) for x in range(2)], s)
    assert one(th.otsu_threshold(full, 2, 2))["threshold"] == 0.5  # constant slice
    # The 90th percentile of 96 zeros and four ones interpolates among the zeros.
    four = spark.createDataFrame([("a", 1, 0, 0, x, 1.0) for x in range(4)], s)
    assert one(th.percentile_threshold(four, 10, 10))["threshold"] == 0.0
    assert th.percentile_mask(four, 10, 10, min_area=5).count() == 0


def test_component_ties(spark):  # T11
    v = vox(spark, [(0, 0, 0), (0, 0, 1), (0, 2, 2), (0, 2, 3), (0, 3, 4)])
    assert {r[0] for r in cc.components(v, dim=2).select("label").distinct().collect()} == {0, (2 << 20) + 2, (3 << 20) + 4}
    assert sorted((r.y, r.x) for r in cc.largest_cc(v, dim=2).collect()) == [(0, 0), (0, 1)]
    assert cc.components(v, dim=2, diagonal=True).select("label").distinct().count() == 2


def test_integer_truncation(spark):  # T12, T17
    prior = spark.createDataFrame(
        [("a", 0.05, 0.55, 0.3, 0.6, 0.9, 0.1)], "case_id string, z_min double, z_max double, y_min double, y_max double, x_min double, x_max double"
    )
    r = one(bx.prior_to_pixels(prior, 10, 20, 20, margin=2))
    assert (r["z0"], r["z1"], r["y1"], r["y2"]) == (0, 6, 4, 14)
    assert (r["x1"], r["x2"]) == (0, 20)  # 16..4 is no interval: whole axis


def test_rounding_at_sink(spark):  # T13
    df = spark.createDataFrame([(0.12345, "t" * 200)], "dice double, text string")
    r = one(tb.results_rows(df))
    assert r["dice"] == 0.1235 and len(r["text"]) == 120


def test_all_zero_similarity_gives_null(spark):  # T15
    cols = "case_id string, mask_id int, score double, " + ", ".join(f"{e} double" for e in rt.EXTENT)
    top = spark.createDataFrame([("a", 1, 0.0, *([0.5] * 6))], cols)
    assert one(rt.weighted_prior(top))["z_min"] is None


def test_zero_is_not_empty(spark):  # T18
    rows = [("raw", 0.0, 5, 1), ("raw", 0.0, 0, 0), ("raw", 0.4, 3, 1)]
    df = spark.createDataFrame(rows, "mode string, dice double, pred_voxels int, slices_used int")
    assert one(rp.empty_stats(df))["empty_pred"] == 1
    assert one(rp.result_summary(df))["zero"] == 2


def test_case_aggregate_fallback(spark):  # T19
    cols = "case_id string, mask_id int, slice_logit double, existence_logit double, z1 double"
    df = spark.createDataFrame(
        [("a", 1, 2.0, -1.0, 0.2), ("a", 1, -2.0, 3.0, 0.8), ("b", 1, -1.0, 0.0, 0.2), ("b", 1, -2.0, -5.0, 0.4)], cols
    )
    r = {x.case_id: x for x in mt.case_aggregate(df, ["z1"]).collect()}
    assert r["a"].z1 == 0.2 and r["b"].z1 == pytest.approx(0.3)
    assert r["a"].existence_prob == pytest.approx(1 / (1 + math.exp(-3))) and r["b"].existence_prob == 0.5


def test_f1_guards(spark):  # T20
    df = spark.createDataFrame([("a", 0, 0)], "case_id string, pred int, gt int")
    r = one(mt.slice_f1(df, ["case_id"]))
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_box_eps(spark):  # T21
    cols = [c for p in ("p_", "g_") for c in (p + n for n in geo.BOX3)]
    df = spark.createDataFrame([tuple([0.0] * 12)], ", ".join(f"{c} double" for c in cols))
    p, g = geo.box3(prefix="p_"), geo.box3(prefix="g_")
    r = one(df.select(geo.iou3d(p, g).alias("iou"), geo.giou3d_loss(p, g).alias("loss")))
    assert r["iou"] == 0.0 and r["loss"] == pytest.approx(1.0)


def test_split_counts_and_error(spark):  # T22
    cases = spark.createDataFrame([(f"s{i:04d}",) for i in range(208)], "case_id string")
    n = {r.split: r["count"] for r in sp.hash_split(cases).groupBy("split").count().collect()}
    assert n == {"train": 150, "dev": 30, "test": 28}
    with pytest.raises(Exception, match="too few cases"):
        sp.hash_split(cases.limit(100)).collect()


def test_merges(spark):  # T23, T24
    p = vox(spark, [(0, 0, 0)], mask=3).union(vox(spark, [(0, 0, 0), (0, 0, 1)], mask=2))
    assert sorted(r.mask_id for r in vx.first_writer_merge(p).collect()) == [2, 2]
    assert vx.flip_vote(vox(spark, [(0, 0, 0)]), vox(spark, [(0, 0, 1)])).count() == 2
    bad = spark.createDataFrame([(5, 0, 5, 9)], "x1 int, y1 int, x2 int, y2 int")
    assert not one(bad.select(geo.bbox_valid(F.struct("*")).alias("ok")))["ok"]


def test_foreign_box_document(spark):  # T24: a whole-case document, nulls, wrong length
    doc = '{"1":{"raw":{"prompt":"p","boxes":[null,[1,2,3,4]],"gt_pos":1,"pred_pos":2},"structured":{"prompt":"q","boxes":[null],"gt_pos":1,"pred_pos":0}}}'
    df = spark.createDataFrame([("a", doc)], "case_id string, json string")
    rows = tb.boxes_explode(df, 2).collect()
    assert [(r.mask_id, r.mode, r.z, r.x1, r.y2) for r in rows] == [(1, "raw", 1, 1, 4)]


def test_text_map_keys(spark):
    df = spark.createDataFrame([("a", '{"2": "x", "instance_label": "0", "1": "y", "b7": "z"}')], "case_id string, json string")
    assert [(r.mask_id, r.pos, r.text) for r in tb.text_map_explode(df).collect()] == [(2, 0, "x"), (1, 2, "y")]


def test_required_inputs_raise(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    with pytest.raises(ValueError, match="b"):
        lb.required_inputs(cases, cases.where("case_id = 'a'"))


def test_atlas_side_conflict(spark):  # T17
    df = texts(spark, "left gallbladder mass", "left aorta mass", "left elbow")
    r = [x.asDict() for x in pr.atlas_prior(tx.with_packet(df)).orderBy("i").collect()]
    assert (r[0]["atlas_x_min"], r[0]["atlas_x_max"]) == (0.5, 0.5)
    assert (r[1]["atlas_x_min"], r[1]["atlas_x_max"]) == (0.3, 0.7)
    assert (r[2]["atlas_x_min"], r[2]["atlas_z_max"]) == (0.5, 1.0)


def test_golden_paired_figures(spark):
    rows = [("a", i, "raw", d, r, o) for i, (d, r, o) in enumerate([(0.5, 0.6, 0.8), (0.2, 0.2, 0.0), (0.4, 0.1, 0.5), (None, 0.3, None)])]
    df = spark.createDataFrame(rows, "case_id string, mask_id int, mode string, direct double, refined double, oracle double")
    r = one(rp.paired_delta(df, "direct", "refined"))
    assert (r["n"], r["wins"], r["ties"], r["losses"]) == (3, 1, 1, 1)
    c = one(rp.ceiling_retention(df, "refined", "oracle"))
    assert c["n"] == 2 and c["mean_retention"] == pytest.approx((0.75 + 0.2) / 2)


def test_size_bin_bounds(spark):
    df = spark.createDataFrame([(49,), (50,), (499,), (500,), (4999,), (5000,), (50000,), (50001,)], "v int")
    got = [r[0] for r in df.select(rp.size_bin(F.col("v"))).collect()]
    assert got == ["<50", "50-500", "50-500", "500-5K", "500-5K", "5K-50K", "5K-50K", ">50K"]


def test_bce_is_stable(spark):
    df = spark.createDataFrame([(800.0, 1), (-800.0, 1)], "x double, y int")
    assert [r[0] for r in df.select(bce_with_logits(F.col("x"), F.col("y"))).collect()] == [0.0, 800.0]
