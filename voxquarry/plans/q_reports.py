"""Queries: overlap metrics, classification metrics, run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.losses import bce_with_logits, binary_kl, mean_of, sigmoid, smooth_l1
from ..operators import metrics as mt
from ..operators import reports as rp
from ..operators.boxes import box3d_half_open
from ..operators.ordering import topk_generic
from .fixtures import D, H, W
from .q_voxels import PAIRS, box_pairs
from .registry import query, rounded

T = ["case_id", "mask_id"]
V = ["case_id", "mask_id", "z", "y", "x"]


def targets(d):
    """Targets 1-5 of every case; 4 and 5 are empty in both masks."""
    return d.gt.select("case_id").distinct().withColumn(
        "mask_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint")))
    )


SCORED = """t AS (SELECT case_id, cast(unnest(generate_series(1, 5)) AS bigint) AS mask_id FROM (SELECT DISTINCT case_id FROM gt)),
   c AS (SELECT case_id, mask_id, cast(sum(p) AS bigint) AS pred_pos, cast(sum(g) AS bigint) AS gt_pos, cast(sum(p * g) AS bigint) AS i FROM vox GROUP BY case_id, mask_id),
   n AS (SELECT t.case_id, t.mask_id, coalesce(pred_pos, 0) AS pred_pos, coalesce(gt_pos, 0) AS gt_pos, coalesce(i, 0) AS "inter" FROM t LEFT JOIN c ON t.case_id = c.case_id AND t.mask_id = c.mask_id),
   scored AS (SELECT *, CASE WHEN pred_pos + gt_pos = 0 THEN 1.0::double ELSE 2.0::double * "inter" / (pred_pos + gt_pos) END AS dice,
     CASE WHEN pred_pos + gt_pos - "inter" = 0 THEN 1.0::double ELSE "inter"::double / (pred_pos + gt_pos - "inter") END AS iou FROM n)"""


def scored(d):
    return mt.overlap_metrics(d.pred, d.gt, targets(d))


@query("dice_score", f'WITH {SCORED} SELECT case_id, mask_id, pred_pos, gt_pos, "inter", round(dice, 6) AS dice FROM scored')
def _(d):
    return rounded(mt.dice_score(d.pred, d.gt, targets(d)))


@query("iou_score", f'WITH {SCORED} SELECT case_id, mask_id, pred_pos, gt_pos, "inter", round(iou, 6) AS iou FROM scored')
def _(d):
    return rounded(mt.iou_score(d.pred, d.gt, targets(d)))


@query(
    "slice_dice",
    """WITH c AS (SELECT case_id, mask_id, z, sum(p) AS pp, sum(g) AS gg, sum(p * g) AS i FROM vox GROUP BY case_id, mask_id, z HAVING sum(g) > 0),
       s AS (SELECT 2.0::double * i / (pp + gg) AS dice FROM c)
       SELECT count(*) AS n, round(avg(dice), 6) AS mean, count(*) FILTER (WHERE dice >= 0.5) AS ge_50,
         count(*) FILTER (WHERE dice >= 0.7) AS ge_70, count(*) FILTER (WHERE dice >= 0.9) AS ge_90 FROM s""",
)
def _(d):
    return rounded(mt.hit_counts(mt.slice_dice(d.pred, d.gt)))


def _summary(source: str, keys: str = "", metric: str = "dice") -> str:
    k = f"{keys}, " if keys else ""
    tail = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}count({metric}) AS n, round(avg({metric}), 6) AS mean, round(median({metric}), 6) AS median,
        count(*) FILTER (WHERE {metric} >= 0.5) AS hit, round(count(*) FILTER (WHERE {metric} >= 0.5) * 100.0::double / count({metric}), 6) AS hit_pct,
        count(*) FILTER (WHERE {metric} = 0) AS zero, round(count(*) FILTER (WHERE {metric} = 0) * 100.0::double / count({metric}), 6) AS zero_pct
        FROM {source}{tail}"""


@query("result_summary", f"WITH {SCORED} {_summary('scored')}")
def _(d):
    return rounded(rp.result_summary(scored(d)))


@query("result_summary_by_mode", _summary("evals", "mode"))
def _(d):
    return rounded(rp.result_summary(d.evals, keys=["mode"]))


@query("summary_by", _summary("(SELECT * FROM evals WHERE anatomy IN (SELECT anatomy FROM evals GROUP BY anatomy ORDER BY count(*) DESC, anatomy LIMIT 10))", "anatomy"))
def _(d):
    return rounded(rp.summary_by(d.evals, "anatomy", top=10))


@query(
    "grouping_report",
    " UNION ALL ".join(
        [
            _summary("(SELECT *, 'all' AS \"grouping\", 'all' AS level FROM evals)", '"grouping", level'),
            _summary("(SELECT *, 'target_form' AS \"grouping\", target_form AS level FROM evals)", '"grouping", level'),
            _summary("(SELECT *, 'anatomy' AS \"grouping\", anatomy AS level FROM evals)", '"grouping", level'),
        ]
    ),
)
def _(d):
    return rounded(rp.grouping_report(d.evals, ["target_form", "anatomy"]))


@query(
    "size_bins",
    """SELECT CASE WHEN gt_voxels < 50 THEN '<50' WHEN gt_voxels < 500 THEN '50-500' WHEN gt_voxels < 5000 THEN '500-5K'
         WHEN gt_voxels <= 50000 THEN '5K-50K' ELSE '>50K' END AS size_bin, count(*) AS n, round(avg(dice), 6) AS mean_dice,
         round(avg(pred_voxels / gt_voxels), 6) AS mean_ratio FROM evals WHERE gt_voxels > 0 GROUP BY 1""",
)
def _(d):
    return rounded(rp.size_bins(d.evals))


@query(
    "overseg_ratio",
    """SELECT count(*) AS n, round(avg(pred_voxels / gt_voxels), 6) AS mean_ratio,
         count(*) FILTER (WHERE pred_voxels / gt_voxels > 3) AS n_over,
         round(count(*) FILTER (WHERE pred_voxels / gt_voxels > 3) / count(*), 6) AS share_over FROM evals WHERE gt_voxels > 0""",
)
def _(d):
    return rounded(rp.overseg_ratio(d.evals))


@query(
    "empty_stats",
    """SELECT mode, count(*) AS n, count(*) FILTER (WHERE pred_voxels = 0) AS empty_pred, count(*) FILTER (WHERE slices_used > 0) AS any_box
       FROM evals GROUP BY mode""",
)
def _(d):
    return rp.empty_stats(d.evals)


@query("value_counts", "SELECT anatomy, count(*) AS n FROM evals GROUP BY anatomy ORDER BY n DESC, anatomy LIMIT 10")
def _(d):
    return rp.value_counts(d.evals, "anatomy", 10)


def _runs(d):
    r = d.runs
    k = [*T, "mode"]
    direct = r.where("direct IS NOT NULL").select(*k, "direct")
    refined = r.where("refined IS NOT NULL").select(*k, "refined")
    oracle = r.where("oracle IS NOT NULL").select(*T, "oracle")
    return direct, refined, oracle


MERGED = "SELECT case_id, mask_id, mode, direct, refined, oracle FROM runs WHERE direct IS NOT NULL OR refined IS NOT NULL"


@query("runs_merge", MERGED)
def _(d):
    return rp.runs_merge(*_runs(d))


@query("run_compare", "SELECT case_id, mask_id, mode, direct AS a, refined AS b, round(refined - direct, 6) AS delta FROM runs WHERE direct IS NOT NULL AND refined IS NOT NULL")
def _(d):
    direct, refined, _o = _runs(d)
    return rounded(rp.run_compare(direct.withColumnRenamed("direct", "dice"), refined.withColumnRenamed("refined", "dice")))


@query(
    "paired_delta",
    """SELECT mode, count(*) AS n, count(*) FILTER (WHERE refined > direct) AS wins, count(*) FILTER (WHERE refined = direct) AS ties,
       count(*) FILTER (WHERE refined < direct) AS losses, round(avg(refined - direct), 6) AS mean_delta
       FROM runs WHERE direct IS NOT NULL AND refined IS NOT NULL GROUP BY mode""",
)
def _(d):
    return rounded(rp.paired_delta(rp.runs_merge(*_runs(d)), "direct", "refined", ["mode"]))


@query(
    "ceiling_retention",
    f"""WITH m AS ({MERGED}), k AS (SELECT mode, refined / nullif(oracle, 0) AS r FROM m)
        SELECT mode, count(r) AS n, round(avg(r), 6) AS mean_retention, round(median(r), 6) AS median_retention FROM k WHERE r IS NOT NULL GROUP BY mode""",
)
def _(d):
    return rounded(rp.ceiling_retention(rp.runs_merge(*_runs(d)), "refined", "oracle", ["mode"]))


@query(
    "topk_generic",
    """SELECT anatomy, case_id, mask_id, round(dice, 6) AS dice, cast(rank AS int) AS rank FROM
       (SELECT *, row_number() OVER (PARTITION BY anatomy ORDER BY dice DESC, case_id, mask_id) AS rank FROM evals) WHERE rank <= 3""",
)
def _(d):
    top = topk_generic(d.evals, ["anatomy"], [F.col("dice").desc(), F.col("case_id"), F.col("mask_id")], 3)
    return rounded(top.select("anatomy", *T, "dice", "rank"))


@query(
    "running_summary",
    """SELECT case_id, mask_id, round(avg(dice) OVER w, 6) AS running_mean,
         cast(sum(CASE WHEN pred_voxels = 0 THEN 1 ELSE 0 END) OVER w AS bigint) AS running_empty
       FROM evals WINDOW w AS (ORDER BY case_id, mask_id ROWS UNBOUNDED PRECEDING)""",
)
def _(d):
    return rounded(rp.running_summary(d.evals, T).select(*T, "running_mean", "running_empty"))


@query(
    "best_epoch",
    """WITH h AS (SELECT o_custkey AS run, o_orderkey AS epoch, o_totalprice AS score FROM orders),
       b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM h)
       SELECT run, epoch, score, past IS NULL OR score > past AS improved, greatest(score, coalesce(past, score)) AS best_so_far FROM b""",
)
def _(d):
    h = d.table("orders").select(
        F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("score")
    )
    return rp.best_epoch(h, "score")


@query(
    "soft_dice",
    """SELECT case_id, mask_id, z, round(2 * sum(prob * g) / (sum(prob) + sum(g) + 1e-5), 6) AS soft_dice FROM vox GROUP BY case_id, mask_id, z""",
)
def _(d):
    return rounded(mt.soft_dice(d.vox.withColumnRenamed("g", "gt")))


# --- classification and loss-type metrics ------------------------------------

# Slice predictions: logits from the vectors, truth from the label.
SLICE_PRED = """SELECT case_id, label % 3 + 1 AS mask_id, z, 10.0 * cast(embedding[1] AS double) AS logit,
    8.0 * cast(embedding[2] AS double) AS ex_logit, CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS flag,
    cast(embedding[3] AS double) AS e3, cast(embedding[4] AS double) AS e4, cast(embedding[5] AS double) AS e5 FROM emb_slice"""


def slice_pred(d):
    def at(i):
        return F.get("embedding", F.lit(i - 1)).cast("double")

    return d.emb_slice.select(
        "case_id", (F.col("label") % 3 + 1).alias("mask_id"), "z",
        (at(1) * 10.0).alias("logit"), (at(2) * 8.0).alias("ex_logit"),
        F.when(F.col("label") % 2 == 0, 1).otherwise(0).alias("flag"),
        at(3).alias("e3"), at(4).alias("e4"), at(5).alias("e5"),
    )


def _f1(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""WITH s AS ({SLICE_PRED}), c AS (SELECT {k}count(*) FILTER (WHERE logit > 0 AND flag = 1) AS tp, count(*) FILTER (WHERE logit > 0 AND flag = 0) AS fp,
        count(*) FILTER (WHERE logit <= 0 AND flag = 1) AS fn FROM s {g}),
        q AS (SELECT *, tp / greatest(1, tp + fp) AS pr, tp / greatest(1, tp + fn) AS rc FROM c)
        SELECT {k}tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / greatest(1e-9, pr + rc), 6) AS f1 FROM q"""


def _flags(d):
    return slice_pred(d).withColumns({"pred": (sigmoid(F.col("logit")) > 0.5).cast("int"), "gt": F.col("flag")})


@query("slice_f1", _f1("case_id, mask_id"))
def _(d):
    return rounded(mt.slice_f1(_flags(d), T))


@query("slice_f1_micro", _f1(""))
def _(d):
    return rounded(mt.slice_f1(_flags(d), []))


@query("existence_acc", f"WITH s AS ({SLICE_PRED}) SELECT round(avg(CASE WHEN (ex_logit > 0) = (flag = 1) THEN 1.0::double ELSE 0.0 END), 6) AS existence_acc FROM s")
def _(d):
    return rounded(mt.existence_acc(slice_pred(d).withColumn("prob", sigmoid(F.col("ex_logit"))), "prob", "flag"))


@query(
    "clf_metrics",
    """WITH s AS (SELECT quality AS y, 1 / (1 + exp(-(cast(n_chars % 100 AS double) - 40) / 20)) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
       SELECT round(count(*) FILTER (WHERE (p >= 0.5) = (y = 1)) / count(*), 6) AS acc,
         round(count(*) FILTER (WHERE p >= 0.5 AND y = 1) / greatest(1, count(*) FILTER (WHERE p >= 0.5)), 6) AS precision,
         round(count(*) FILTER (WHERE p >= 0.5 AND y = 1) / greatest(1, count(*) FILTER (WHERE y = 1)), 6) AS recall FROM s""",
)
def _(d):
    s = d.table("labels").join(d.table("documents").select("doc_id", "n_chars"), "doc_id")
    logit = ((F.col("n_chars") % 100).cast("double") - 40) / 20
    return rounded(mt.clf_metrics(s.withColumn("prob", sigmoid(logit)), "prob", "quality"))


_HEADS = {"z1": "abs(e3)", "y1": "abs(e4)", "x1": "abs(e5)", "z2": "abs(e3) + 0.5", "y2": "abs(e4) + 0.5", "x2": "abs(e5) + 0.5",
          "cz": "abs(e3) + 0.25", "cy": "abs(e4) + 0.25", "cx": "abs(e5) + 0.25", "z_lo": "abs(e3)", "z_hi": "abs(e3) + 0.5"}
CASE_AGG = f"""SELECT case_id, mask_id, {', '.join(f'coalesce(avg({e}) FILTER (WHERE logit > 0), avg({e})) AS {n}' for n, e in _HEADS.items())},
    1 / (1 + exp(-max(ex_logit))) AS existence_prob FROM ({SLICE_PRED}) GROUP BY case_id, mask_id"""


def case_agg(d):
    s = slice_pred(d).select(
        *T, F.col("logit").alias("slice_logit"), F.col("ex_logit").alias("existence_logit"),
        *[F.expr(e).alias(n) for n, e in _HEADS.items()],
    )
    return mt.case_aggregate(s)


@query("case_aggregate", f"SELECT case_id, mask_id, {', '.join(f'round({c}, 6) AS {c}' for c in [*_HEADS, 'existence_prob'])} FROM ({CASE_AGG})")
def _(d):
    return rounded(case_agg(d))


AUX_BOX = f"""SELECT t.case_id, t.mask_id, CASE WHEN z1 IS NULL THEN 0 ELSE 1 END AS existence,
    {', '.join(f'coalesce({c}, 0.0::double) AS {c}' for c in ('z1', 'y1', 'x1', 'z2', 'y2', 'x2', 'cz', 'cy', 'cx'))} FROM
    (SELECT case_id, cast(unnest(generate_series(1, 5)) AS bigint) AS mask_id FROM (SELECT DISTINCT case_id FROM gt)) t
    LEFT JOIN (SELECT case_id, mask_id, min(z) / {D}.0::double AS z1, (max(z) + 1) / {D}.0::double AS z2, avg(z) / {D}.0 AS cz,
     min(y) / {H}.0::double AS y1, (max(y) + 1) / {H}.0::double AS y2, avg(y) / {H}.0 AS cy,
     min(x) / {W}.0::double AS x1, (max(x) + 1) / {W}.0::double AS x2, avg(x) / {W}.0 AS cx FROM gt GROUP BY case_id, mask_id) b
    ON t.case_id = b.case_id AND t.mask_id = b.mask_id"""


def aux_box(d):
    """Auxiliary boxes of targets 1-5; 4 and 5 are absent."""
    box = box3d_half_open(d.gt, D, H, W)
    j = targets(d).join(box, T, "left").withColumn("existence", F.when(F.col("z1").isNotNull(), 1).otherwise(0))
    j = j.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("z1", "y1", "x1", "z2", "y2", "x2", "cz", "cy", "cx")})
    return j.withColumns({"z_lo": F.col("z1"), "z_hi": F.col("z2")})


@query(
    "aux_metrics",
    f"""WITH p AS ({CASE_AGG}), a AS ({AUX_BOX}),
        j AS (SELECT p.case_id, p.mask_id, existence, existence_prob,
          {', '.join(f'p.{c} AS p_{c}, a.{c} AS g_{c}' for c in ('z1', 'y1', 'x1', 'z2', 'y2', 'x2', 'cz', 'cy', 'cx'))} FROM p JOIN a ON p.case_id = a.case_id AND p.mask_id = a.mask_id),
        v AS (SELECT *, {' * '.join(f'greatest(0.0, least(p_{a}2, g_{a}2) - greatest(p_{a}1, g_{a}1))' for a in 'zyx')} AS i,
          (p_z2 - p_z1) * (p_y2 - p_y1) * (p_x2 - p_x1) + (g_z2 - g_z1) * (g_y2 - g_y1) * (g_x2 - g_x1) AS s FROM j),
        f AS ({_f1('case_id, mask_id')})
        SELECT v.case_id, v.mask_id, existence AS existence_gt, round(existence_prob, 6) AS existence_prob, f1 AS slice_exist_f1,
          CASE WHEN existence = 1 THEN round(i / (s - i), 6) END AS bbox_iou_3d,
          CASE WHEN existence = 1 THEN round(sqrt((p_cz - g_cz) ** 2 + (p_cy - g_cy) ** 2 + (p_cx - g_cx) ** 2) / sqrt(3), 6) END AS centroid_err_norm,
          CASE WHEN existence = 1 THEN round(greatest(0.0, least(p_z2, g_z2) - greatest(p_z1, g_z1)) / greatest(1e-9, g_z2 - g_z1), 6) END AS z_range_recall
        FROM v JOIN f ON v.case_id = f.case_id AND v.mask_id = f.mask_id""",
)
def _(d):
    return rounded(mt.aux_metrics(case_agg(d), mt.slice_f1(_flags(d), T), aux_box(d)))


@query(
    "dev_summary",
    f"""WITH s AS (SELECT abs(e3) AS sd, logit, ex_logit, flag, abs(e4) AS iou, abs(e5) AS ce, abs(e3 - e4) AS zr, CASE WHEN z % 4 = 0 THEN 0 ELSE 1 END AS ex FROM ({SLICE_PRED})),
        c AS (SELECT count(*) FILTER (WHERE logit > 0 AND flag = 1) AS tp, count(*) FILTER (WHERE logit > 0 AND flag = 0) AS fp, count(*) FILTER (WHERE logit <= 0 AND flag = 1) AS fn,
          avg(sd) AS main_dice, avg(CASE WHEN (ex_logit > 0) = (ex = 1) THEN 1.0::double ELSE 0.0 END) AS existence_acc,
          coalesce(avg(iou) FILTER (WHERE ex = 1), 0) AS bi, coalesce(avg(ce) FILTER (WHERE ex = 1), 0) AS ce, coalesce(avg(zr) FILTER (WHERE ex = 1), 0) AS zr FROM s),
        q AS (SELECT *, tp / greatest(1, tp + fp) AS pr, tp / greatest(1, tp + fn) AS rc FROM c)
        SELECT round(main_dice, 6) AS main_dice, round(existence_acc, 6) AS existence_acc, round(bi, 6) AS bbox_iou_pos, round(ce, 6) AS centroid_err_norm,
          round(zr, 6) AS z_range_recall, round(2 * pr * rc / greatest(1e-9, pr + rc), 6) AS slice_exist_f1 FROM q""",
)
def _(d):
    s = slice_pred(d).select(
        F.abs("e3").alias("soft_dice"), sigmoid(F.col("logit")).alias("slice_prob"), F.col("flag").alias("slice_gt"),
        sigmoid(F.col("ex_logit")).alias("existence_prob"), F.when(F.col("z") % 4 == 0, 0).otherwise(1).alias("existence"),
        F.abs("e4").alias("iou"), F.abs("e5").alias("centroid_err"), F.abs(F.col("e3") - F.col("e4")).alias("z_recall"),
    )
    return rounded(mt.dev_summary(s))


@query("log_loss", f"WITH s AS ({SLICE_PRED}) SELECT round(avg(-(flag * ln(1 / (1 + exp(-logit))) + (1 - flag) * ln(1 - 1 / (1 + exp(-logit))))), 6) AS log_loss FROM s")
def _(d):
    return rounded(slice_pred(d).agg(F.avg(bce_with_logits(F.col("logit"), F.col("flag"))).alias("log_loss")))


def _coords(d):
    return box_pairs(d).withColumn("m", F.when(F.col("case_id") % 3 == 0, 0.0).otherwise(1.0))


def _sl1(c: str) -> str:
    return f"(CASE WHEN abs(p_{c} - g_{c}) < 1 THEN 0.5 * (p_{c} - g_{c}) ** 2 ELSE abs(p_{c} - g_{c}) - 0.5 END)"


_B6 = ["z1", "y1", "x1", "z2", "y2", "x2"]


@query(
    "smooth_l1",
    f"""WITH {PAIRS}, s AS (SELECT ({' + '.join(_sl1(c) for c in _B6)}) / 6 AS l, CASE WHEN case_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS m FROM bp)
        SELECT round(avg(l), 6) AS smooth_l1, round(sum(l * m) / greatest(sum(m), 1), 6) AS masked FROM s""",
)
def _(d):
    per = mean_of([smooth_l1(F.col("p_" + c), F.col("g_" + c)) for c in _B6])
    s = _coords(d).select(per.alias("l"), "m")
    return rounded(s.agg(F.avg("l").alias("smooth_l1"), mt.masked_mean(F.col("l"), F.col("m")).alias("masked")))


@query(
    "centroid_mse",
    f"""WITH {PAIRS}, s AS (SELECT ((p_cz - g_cz) ** 2 + (p_cy - g_cy) ** 2 + (p_cx - g_cx) ** 2) / 3 AS l, CASE WHEN case_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS m FROM bp)
        SELECT round(sum(l * m) / greatest(sum(m), 1), 6) AS centroid_mse FROM s""",
)
def _(d):
    per = mean_of([F.pow(F.col("p_" + c) - F.col("g_" + c), F.lit(2.0)) for c in ("cz", "cy", "cx")])
    s = _coords(d).select(per.alias("l"), "m")
    return rounded(s.agg(mt.masked_mean(F.col("l"), F.col("m")).alias("centroid_mse")))


@query(
    "binary_kl",
    f"""WITH s AS (SELECT least(greatest(1 / (1 + exp(-ex_logit * 5)), 1e-6), 1 - 1e-6) AS p, least(greatest(1 / (1 + exp(-logit)), 1e-6), 1 - 1e-6) AS q FROM ({SLICE_PRED}))
        SELECT round(avg(p * (ln(p) - ln(q)) + (1 - p) * (ln(1 - p) - ln(1 - q))), 6) AS kl FROM s""",
)
def _(d):
    kl = binary_kl(sigmoid(F.col("ex_logit") * 5), sigmoid(F.col("logit")))
    return rounded(slice_pred(d).agg(F.avg(kl).alias("kl")))


_TERMS = ["main", "existence", "slice_exist", "bbox", "centroid", "zrange"]


@query(
    "composite_score",
    """WITH t AS (SELECT o_orderkey % 4 AS epoch, ['main','existence','slice_exist','bbox','centroid','zrange'][cast(o_custkey % 6 + 1 AS int)] AS term, avg(o_totalprice) / 100000 AS v FROM orders GROUP BY 1, 2),
       w AS (SELECT * FROM (VALUES ('existence', 0.3::double), ('slice_exist', 0.5), ('bbox', 0.3), ('centroid', 0.1), ('zrange', 0.2)) x(term, lam))
       SELECT epoch, round(sum(v * CASE WHEN t.term = 'main' THEN 1 ELSE lam * least(1.0, (epoch + 1) / 2.0) END), 6) AS total FROM t LEFT JOIN w ON t.term = w.term GROUP BY epoch""",
)
def _(d):
    term = F.get(F.array(*[F.lit(t) for t in _TERMS]), (F.col("o_custkey") % 6).cast("int"))
    t = d.table("orders").groupBy((F.col("o_orderkey") % 4).alias("epoch"), term.alias("term")).agg(
        (F.avg("o_totalprice") / 100000).alias("value")
    )
    return rounded(mt.composite_score(t))


@query(
    "main_seg_loss",
    f"""WITH v AS (SELECT case_id, mask_id, z, 4 * (prob - 0.5) AS logit, g FROM vox),
        s AS (SELECT case_id, mask_id, z, 2 * sum(g / (1 + exp(-logit))) / (sum(1 / (1 + exp(-logit))) + sum(g) + 1e-5) AS d,
          sum(greatest(logit, 0) - logit * g + ln(1 + exp(-abs(logit)))) AS b, count(*) AS n FROM v GROUP BY case_id, mask_id, z)
        SELECT round(0.5 * (1 - avg(d)) + 0.5 * sum(b) / sum(n), 6) AS main_loss FROM s""",
)
def _(d):
    logit = F.lit(4.0) * (F.col("prob") - 0.5)
    v = d.vox.select(*T, "z", sigmoid(logit).alias("prob"), F.col("g").alias("gt"), bce_with_logits(logit, F.col("g")).alias("b"))
    per = mt.soft_dice(v).join(v.groupBy(*T, "z").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")), [*T, "z"])
    return rounded(
        per.agg((F.lit(0.5) * (1 - F.avg("soft_dice")) + F.lit(0.5) * F.sum("b") / F.sum("n")).alias("main_loss"))
    )


@query(
    "class_weight",
    """SELECT count(*) FILTER (WHERE quality = 0) AS n_neg, count(*) FILTER (WHERE quality = 1) AS n_pos,
         round(greatest(count(*) FILTER (WHERE quality = 0), 1) / greatest(count(*) FILTER (WHERE quality = 1), 1), 6) AS pos_weight FROM labels""",
)
def _(d):
    return rounded(mt.class_weight(d.table("labels"), "quality"))
