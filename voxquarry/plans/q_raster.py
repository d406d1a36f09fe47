"""Queries: thresholds, components, post-processing, composed runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as bx
from ..operators import components as cc
from ..operators import labels as lb
from ..operators import metrics as mt
from ..operators import quality as ql
from ..operators import reports as rp
from ..operators import retrieval as rt
from ..operators import thresholds as th
from ..operators import tiles as tl
from ..operators import tricks as tr
from ..operators import voxels as vx
from ..session import cut_lineage
from .fixtures import D, DENSE, H, W
from .q_reports import _summary
from .q_text import BLEND, blended
from .q_voxels import JITTER
from .registry import query, rounded

T = ["case_id", "mask_id"]
V = ["case_id", "mask_id", "z", "y", "x"]
PX = DENSE * DENSE


def otsu_sql(source: str, pixels: int) -> str:
    return f"""os AS (SELECT case_id, mask_id, z, count(*) AS n, CASE WHEN count(*) < {pixels} THEN least(0.0, min(prob)) ELSE min(prob) END AS lo, max(prob) AS hi FROM {source} GROUP BY case_id, mask_id, z),
   ob AS (SELECT d.case_id, d.mask_id, d.z, least(255, floor((prob - lo) / (hi - lo) * 256)) AS b, 1 AS c FROM {source} d JOIN os USING (case_id, mask_id, z) WHERE hi > lo
     UNION ALL SELECT case_id, mask_id, z, floor((0.0 - lo) / (hi - lo) * 256), {pixels} - n FROM os WHERE n < {pixels} AND hi > lo),
   oh AS (SELECT case_id, mask_id, z, cast(b AS bigint) AS b, cast(sum(c) AS bigint) AS c FROM ob GROUP BY ALL),
   oc AS (SELECT *, sum(c) OVER w AS w1, sum(c * b) OVER w AS s1, sum(c) OVER a AS wt, sum(c * b) OVER a AS st FROM oh
     WINDOW a AS (PARTITION BY case_id, mask_id, z), w AS (PARTITION BY case_id, mask_id, z ORDER BY b ROWS UNBOUNDED PRECEDING)),
   ov AS (SELECT case_id, mask_id, z, b, w1::double * (wt - w1) * (s1::double / w1 - (st - s1)::double / (wt - w1)) ** 2 AS v FROM oc WHERE w1 < wt),
   ox AS (SELECT case_id, mask_id, z, b FROM (SELECT *, row_number() OVER (PARTITION BY case_id, mask_id, z ORDER BY v DESC, b) AS r FROM ov) WHERE r = 1),
   ot AS (SELECT os.*, CASE WHEN b IS NULL THEN lo ELSE lo + (b + 0.5) * (hi - lo) / 256 END AS t0 FROM os LEFT JOIN ox USING (case_id, mask_id, z)),
   otsu AS (SELECT *, CASE WHEN t0 < 0.2 OR t0 > 0.9 THEN 0.5 ELSE t0 END AS t FROM ot)"""


@query("otsu_threshold", f"WITH {otsu_sql('dense', PX)} SELECT case_id, mask_id, z, round(t, 6) AS threshold FROM otsu")
def _(d):
    return rounded(th.otsu_threshold(d.dense, DENSE, DENSE))


@query("otsu_mask", f"WITH {otsu_sql('dense', PX)} SELECT d.case_id, d.mask_id, d.z, d.y, d.x FROM dense d JOIN otsu o USING (case_id, mask_id, z) WHERE prob > t")
def _(d):
    return th.otsu_mask(d.dense, DENSE, DENSE).select(*V)


PCT = f"""pr AS (SELECT *, row_number() OVER (PARTITION BY case_id, mask_id, z ORDER BY prob) - 1 + {PX} - count(*) OVER (PARTITION BY case_id, mask_id, z) AS i FROM dense),
   pt AS (SELECT case_id, mask_id, z, coalesce(max(prob) FILTER (WHERE i = floor(0.9 * {PX - 1})), 0) AS lo, coalesce(max(prob) FILTER (WHERE i = ceil(0.9 * {PX - 1})), 0) AS hi FROM pr GROUP BY case_id, mask_id, z),
   pm AS (SELECT d.*, count(*) OVER (PARTITION BY d.case_id, d.mask_id, d.z) AS n FROM dense d JOIN pt USING (case_id, mask_id, z) WHERE prob > lo + (hi - lo) * (0.9 * {PX - 1} - floor(0.9 * {PX - 1}))),
   pct AS (SELECT case_id, mask_id, z, y, x FROM pm WHERE n >= 20)"""


@query("percentile_mask", f"WITH {PCT} SELECT * FROM pct")
def _(d):
    return th.percentile_mask(d.dense, DENSE, DENSE)


@query(
    "threshold_fallback",
    """WITH a AS (SELECT case_id, mask_id, z, count(*) FILTER (WHERE prob > 0.5) AS n FROM dense GROUP BY case_id, mask_id, z)
       SELECT d.case_id, d.mask_id, d.z, d.y, d.x FROM dense d JOIN a USING (case_id, mask_id, z) WHERE prob > CASE WHEN n < 40 THEN 0.3 ELSE 0.5 END""",
)
def _(d):
    return th.threshold_fallback(d.dense, min_area=40)


# --- components ----------------------------------------------------------------

_FACE2 = "(abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.z = b.z)"
_EIGHT = "(greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1 AND a.z = b.z)"
_FACE3 = "(abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1)"


def comp_sql(source: str, near: str = _FACE3) -> str:
    """Smallest position that reaches each voxel; labels travel upwards only."""
    return f"""RECURSIVE cv AS (SELECT case_id, mask_id, z, y, x, z * 1099511627776 + y * 1048576 + x AS k FROM {source}),
   ce AS (SELECT a.case_id, a.mask_id, a.k AS ka, b.k AS kb FROM cv a JOIN cv b ON a.case_id = b.case_id AND a.mask_id = b.mask_id AND b.z BETWEEN a.z - 1 AND a.z + 1 AND {near}),
   cr(case_id, mask_id, k, label) AS (SELECT case_id, mask_id, k, k FROM cv UNION SELECT e.case_id, e.mask_id, e.kb, r.label FROM cr r JOIN ce e ON r.case_id = e.case_id AND r.mask_id = e.mask_id AND r.k = e.ka WHERE r.label < e.kb),
   cl AS (SELECT case_id, mask_id, k, min(label) AS label FROM cr GROUP BY case_id, mask_id, k),
   comp AS (SELECT case_id, mask_id, z, y, x, cl.label FROM cv JOIN cl USING (case_id, mask_id, k)),
   csize AS (SELECT case_id, mask_id, label, count(*) AS n FROM comp GROUP BY case_id, mask_id, label)"""


@query("components", f"WITH {comp_sql('dense')} SELECT case_id, mask_id, z, y, x, label FROM comp")
def _(d):
    return cc.components(d.dense)


# Thin blocks: components are put together across block borders by contraction.
@query("components_across_blocks", f"WITH {comp_sql('dense')} SELECT case_id, mask_id, z, y, x, label FROM comp")
def _(d):
    return cc.components(d.dense, block=4)


# Tiles along all axes: faces in z, y and x are contracted.
@query("components_in_tiles", f"WITH {comp_sql('dense')} SELECT case_id, mask_id, z, y, x, label FROM comp")
def _(d):
    return tl.tiled_components(d.dense, tile=(4, 5, 6))


@query("components_2d", f"WITH {comp_sql('dense', _FACE2)} SELECT case_id, mask_id, z, y, x, label FROM comp")
def _(d):
    return cc.components(d.dense, dim=2)


@query("component_count", f"WITH {comp_sql('gt')} SELECT case_id, mask_id, count(*) AS component_count FROM csize GROUP BY case_id, mask_id")
def _(d):
    return cc.component_count(d.gt)


def largest_sql(source: str, near: str, scope: str) -> str:
    return f"""{comp_sql(source, near)}, cz AS (SELECT c.*, count(*) OVER (PARTITION BY case_id, mask_id, label) AS n FROM comp c),
   cb AS (SELECT *, first_value(label) OVER (PARTITION BY {scope} ORDER BY n DESC, label) AS best FROM cz),
   big AS (SELECT case_id, mask_id, z, y, x FROM cb WHERE label = best)"""


@query("largest_cc", f"WITH {largest_sql('dense', _FACE3, 'case_id, mask_id')} SELECT * FROM big")
def _(d):
    return cc.largest_cc(d.dense)


@query("largest_cc_2d", f"WITH {largest_sql('pred', _FACE2, 'case_id, mask_id, z')} SELECT * FROM big")
def _(d):
    return cc.largest_cc(d.pred, dim=2)


@query("min_size_filter", f"WITH {comp_sql('dense')} SELECT case_id, mask_id, z, y, x FROM comp JOIN csize USING (case_id, mask_id, label) WHERE n >= 5")
def _(d):
    return cc.min_size_filter(d.dense)


_PRIOR = "pri AS (SELECT DISTINCT case_id, mask_id, 0.25::double AS z_min, 0.5::double AS z_max, 0.2::double AS y_min, 0.71::double AS y_max, 0.13::double AS x_min, 0.9::double AS x_max FROM SRC)"


def _prior(df):
    ext = {"z_min": 0.25, "z_max": 0.5, "y_min": 0.2, "y_max": 0.71, "x_min": 0.13, "x_max": 0.9}
    return df.select(*T).distinct().withColumns({k: F.lit(v) for k, v in ext.items()})


def nearest_sql(n: int) -> str:
    return f"""cn AS (SELECT case_id, mask_id, label, sqrt((avg(z) - (z_min + z_max) / 2 * {D}) ** 2 + (avg(y) - (y_min + y_max) / 2 * {n}) ** 2 + (avg(x) - (x_min + x_max) / 2 * {n}) ** 2) AS dist
     FROM comp JOIN pri USING (case_id, mask_id) GROUP BY case_id, mask_id, label, z_min, z_max, y_min, y_max, x_min, x_max),
   near AS (SELECT case_id, mask_id, label FROM (SELECT *, row_number() OVER (PARTITION BY case_id, mask_id ORDER BY round(dist, 9), label) AS r FROM cn) WHERE r = 1)"""


@query("nearest_component", f"WITH {comp_sql('dense')}, {_PRIOR.replace('SRC', 'dense')}, {nearest_sql(DENSE)} SELECT case_id, mask_id, z, y, x FROM comp JOIN near USING (case_id, mask_id, label)")
def _(d):
    return cc.nearest_component(d.dense, _prior(d.dense), D, DENSE, DENSE)


_RULE = "CASE WHEN case_id % 3 = 0 THEN 'keep_nearest' WHEN case_id % 3 = 1 THEN 'keep_multi' ELSE 'organ_roi' END"


@query(
    "postprocess_route",
    f"""WITH {comp_sql('dense')}, {_PRIOR.replace('SRC', 'dense')}, {nearest_sql(DENSE)}
        SELECT case_id, mask_id, z, y, x FROM comp c WHERE ({_RULE} = 'keep_nearest' AND EXISTS (SELECT 1 FROM near n WHERE n.case_id = c.case_id AND n.mask_id = c.mask_id AND n.label = c.label))
          OR ({_RULE} <> 'keep_nearest' AND EXISTS (SELECT 1 FROM csize s WHERE s.case_id = c.case_id AND s.mask_id = c.mask_id AND s.label = c.label AND s.n >= 5))""",
)
def _(d):
    rules = d.dense.select(*T).distinct().withColumn("post_rule", F.expr(_RULE))
    return cc.postprocess_route(d.dense, rules, _prior(d.dense), D, DENSE, DENSE)


@query(
    "pseudo_boxes",
    f"""WITH {largest_sql('pred', _FACE2, 'case_id, mask_id, z')}, b AS (SELECT case_id, mask_id, z, greatest(0, min(x) - 5) AS x1, greatest(0, min(y) - 5) AS y1, least({W}, max(x) + 5) AS x2, least({H}, max(y) + 5) AS y2 FROM big GROUP BY case_id, mask_id, z),
        g AS (SELECT case_id, mask_id, unnest(generate_series(0, {D - 1})) AS z FROM descr)
        SELECT g.case_id, g.mask_id, g.z, cast(x1 AS int) AS x1, cast(y1 AS int) AS y1, cast(x2 AS int) AS x2, cast(y2 AS int) AS y2 FROM g LEFT JOIN b ON g.case_id = b.case_id AND g.mask_id = b.mask_id AND g.z = b.z""",
)
def _(d):
    return cc.pseudo_boxes(d.pred, d.descr, D, H, W)


@query(
    "saliency_bbox",
    f"""WITH {largest_sql("(SELECT case_id, mask_id, z, y, x FROM dense WHERE prob > 0.5)", _EIGHT, 'case_id, mask_id, z')}
        SELECT case_id, mask_id, z, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM big GROUP BY case_id, mask_id, z""",
)
def _(d):
    return cc.saliency_bbox(d.dense.where("prob > 0.5"), DENSE, DENSE)


@query(
    "top2_cc",
    f"""WITH {comp_sql('dense')}, rk AS (SELECT *, row_number() OVER (PARTITION BY case_id, mask_id ORDER BY n DESC, label) AS cc_rank FROM csize),
        kept AS (SELECT case_id, mask_id, z, y, x, cc_rank FROM comp JOIN rk USING (case_id, mask_id, label) WHERE cc_rank <= 2)
        SELECT case_id, mask_id, z, cast(cc_rank AS int) AS cc_rank, cast(greatest(0, min(x) - 5) AS int) AS x1, cast(greatest(0, min(y) - 5) AS int) AS y1, cast(least({DENSE}, max(x) + 5) AS int) AS x2, cast(least({DENSE}, max(y) + 5) AS int) AS y2 FROM kept GROUP BY ALL""",
)
def _(d):
    return lb.top2_boxes(cc.top_components(d.dense), DENSE, DENSE)


AUX = f"""ax AS (SELECT case_id, mask_id, count(*) AS n, min(z) AS z1, max(z) + 1 AS z2, min(y) AS y1, max(y) + 1 AS y2, min(x) AS x1, max(x) + 1 AS x2, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx, list_sort(list_distinct(list(z))) AS zs FROM gt GROUP BY case_id, mask_id),
   ac AS (SELECT case_id, mask_id, count(*) AS component_count FROM csize GROUP BY case_id, mask_id),
   aux AS (SELECT t.case_id, t.mask_id, t.text, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS existence, list_transform(range(0, {D}), lambda i : CASE WHEN list_contains(coalesce(zs, []), i) THEN 1 ELSE 0 END) AS slice_exist,
     {', '.join(f'coalesce({c} / {float(s)}::double, 0) AS {c}' for s, cs in ((D, ('z1', 'z2', 'cz')), (H, ('y1', 'y2', 'cy')), (W, ('x1', 'x2', 'cx'))) for c in cs)},
     coalesce(n / {float(D * H * W)}::double, 0) AS volume, coalesce(component_count, 0) AS component_count
     FROM descr t LEFT JOIN ax ON t.case_id = ax.case_id AND t.mask_id = ax.mask_id LEFT JOIN ac ON t.case_id = ac.case_id AND t.mask_id = ac.mask_id)"""
_AUX_COLS = ["z1", "y1", "x1", "z2", "y2", "x2", "cz", "cy", "cx"]


def aux_of(d):
    return lb.aux_labels(d.gt, d.descr.select(*T, "text"), D, H, W)


@query(
    "aux_labels",
    f"""WITH {comp_sql('gt')}, {AUX} SELECT case_id, mask_id, existence, array_to_string(slice_exist, ',') AS slice_exist,
        {', '.join(f'round({c}, 9) AS {c}' for c in _AUX_COLS)}, round(z1, 9) AS z_lo, round(z2, 9) AS z_hi, round(volume, 9) AS volume, component_count FROM aux""",
)
def _(d):
    a = aux_of(d).drop("text")
    return rounded(a.withColumn("slice_exist", F.array_join(F.transform("slice_exist", lambda v: v.cast("string")), ",")), 9)


# --- composed runs ----------------------------------------------------------------


@query(
    "tricks_chain",
    f"""WITH {otsu_sql('dense', PX)}, m AS (SELECT d.case_id, d.mask_id, d.z, d.y, d.x, prob FROM dense d JOIN otsu USING (case_id, mask_id, z) WHERE prob > t),
        e AS (SELECT a.* FROM m a JOIN m b ON b.case_id = a.case_id AND b.z = a.z AND b.y = a.y AND b.x = a.x + 1 JOIN m c ON c.case_id = a.case_id AND c.z = a.z AND c.y = a.y AND c.x = a.x - 1
          JOIN m f ON f.case_id = a.case_id AND f.z = a.z AND f.y = a.y + 1 AND f.x = a.x JOIN m g ON g.case_id = a.case_id AND g.z = a.z AND g.y = a.y - 1 AND g.x = a.x),
        k AS (SELECT case_id, mask_id, z FROM e GROUP BY case_id, mask_id, z HAVING avg(prob) >= 0.7503)
        SELECT e.case_id, e.mask_id, e.z, e.y, e.x FROM e JOIN k USING (case_id, mask_id, z)""",
)
def _(d):
    return tr.refine(d.dense, {"otsu", "erosion", "confidence_gate"}, DENSE, DENSE, min_conf=0.7503)


@query(
    "box_refine",
    f"""WITH b AS (SELECT case_id, mask_id, z, greatest(0, min(x) - least(15, greatest(2, cast(trunc(0.1 * greatest(max(x) - min(x), max(y) - min(y))) AS bigint)))) AS x1,
            greatest(0, min(y) - least(15, greatest(2, cast(trunc(0.1 * greatest(max(x) - min(x), max(y) - min(y))) AS bigint)))) AS y1,
            least({W}, max(x) + least(15, greatest(2, cast(trunc(0.1 * greatest(max(x) - min(x), max(y) - min(y))) AS bigint)))) AS x2,
            least({H}, max(y) + least(15, greatest(2, cast(trunc(0.1 * greatest(max(x) - min(x), max(y) - min(y))) AS bigint)))) AS y2 FROM gt GROUP BY case_id, mask_id, z)
        SELECT v.case_id, v.mask_id, v.z, v.y, v.x FROM vox v JOIN b USING (case_id, mask_id, z) WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2 AND prob > 0.65""",
)
def _(d):
    return tr.refine(d.vox.select(*V, "prob"), {"adaptive_margin", "threshold_0.65"}, H, W, prompt=d.gt)


@query(
    "tricks_ensemble",
    f"""WITH {JITTER}, m AS (SELECT v.case_id, v.mask_id, v.z, v.y, v.x, sum(prob) / 5 AS prob FROM vox v JOIN jitter b USING (case_id, mask_id, z)
          WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY ALL) SELECT case_id, mask_id, z, y, x FROM m WHERE prob > 0.4503""",
)
def _(d):
    return tr.refine(d.vox.select(*V, "prob"), {"ensemble", "threshold_0.4503"}, H, W, prompt=d.gt, seed=7)


_CUT = "(SELECT case_id, mask_id, z, y, x FROM dense WHERE prob > 0.65)"


@query("tricks_cc2d", f"WITH {largest_sql(_CUT, _FACE2, 'case_id, mask_id, z')} SELECT * FROM big")
def _(d):
    return tr.refine(d.dense, {"threshold_0.65", "cc2d"}, DENSE, DENSE)


@query("tricks_cc3d", f"WITH {largest_sql(_CUT, _FACE3, 'case_id, mask_id')} SELECT * FROM big")
def _(d):
    return tr.refine(d.dense, {"threshold_0.65", "cc3d"}, DENSE, DENSE)


_GRID = [(f"t{t}_c{c}", t, c) for t in (0.3, 0.5, 0.65) for c in (0.0, 0.6503, 0.7503)]


@query(
    "ablation_sweep",
    f"""WITH gr(config, t, c) AS (VALUES {', '.join(f"('{n}', {t}::double, {c}::double)" for n, t, c in _GRID)}),
        s AS (SELECT config, c, case_id, mask_id, z, sum(g) AS gp, count(*) FILTER (WHERE prob > t) AS p, count(*) FILTER (WHERE prob > t AND g = 1) AS i, avg(prob) FILTER (WHERE prob > t) AS m FROM vox CROSS JOIN gr GROUP BY config, c, case_id, mask_id, z),
        k AS (SELECT config, case_id, mask_id, cast(sum(gp) AS bigint) AS gt_pos, cast(sum(CASE WHEN m >= c THEN p ELSE 0 END) AS bigint) AS pred_pos, cast(sum(CASE WHEN m >= c THEN i ELSE 0 END) AS bigint) AS "inter" FROM s GROUP BY config, case_id, mask_id)
        SELECT *, round(CASE WHEN gt_pos + pred_pos = 0 THEN 1.0::double ELSE 2.0::double * "inter" / (gt_pos + pred_pos) END, 6) AS dice FROM k""",
)
def _(d):
    return rounded(tr.ablation_sweep(d.vox, _GRID))


# Text -> prior -> box -> mask -> clean-up -> score, for every target of the findings.
GUIDED = f"""{BLEND.replace('packet AS', 'packet AS', 1)},
   px AS (SELECT *, greatest(0, cast(trunc(z_min * {D}) AS int) - 1) AS z0, least({D - 1}, cast(trunc(z_max * {D}) AS int) + 1) AS z1, greatest(0, cast(trunc(x_min * {W}) AS int) - 2) AS bx1, least({W}, cast(trunc(x_max * {W}) AS int) + 2) AS bx2,
     greatest(0, cast(trunc(y_min * {H}) AS int) - 2) AS by1, least({H}, cast(trunc(y_max * {H}) AS int) + 2) AS by2 FROM blend),
   fx AS (SELECT *, CASE WHEN bx2 <= bx1 THEN 0 ELSE bx1 END AS x1, CASE WHEN bx2 <= bx1 THEN {W} ELSE bx2 END AS x2, CASE WHEN by2 <= by1 THEN 0 ELSE by1 END AS y1, CASE WHEN by2 <= by1 THEN {H} ELSE by2 END AS y2 FROM px),
   gp AS (SELECT f.case_id, f.mask_id, v.z, v.y, v.x FROM fx f JOIN vox v ON v.case_id = f.case_id AND v.mask_id = f.mask_id AND v.z BETWEEN f.z0 AND f.z1 AND v.x >= f.x1 AND v.x < f.x2 AND v.y >= f.y1 AND v.y < f.y2 AND v.prob > 0.5)"""


@query(
    "guided_report",
    f"""WITH {comp_sql('gp').replace('RECURSIVE ', 'RECURSIVE ' + GUIDED + ', ', 1)}, pri AS (SELECT case_id, mask_id, {', '.join(rt.EXTENT)} FROM blend), {nearest_sql(H)},
        kept AS (SELECT c.case_id, c.mask_id, c.z, c.y, c.x FROM comp c JOIN fx f ON c.case_id = f.case_id AND c.mask_id = f.mask_id
          WHERE (post_rule = 'keep_nearest' AND EXISTS (SELECT 1 FROM near n WHERE n.case_id = c.case_id AND n.mask_id = c.mask_id AND n.label = c.label))
            OR (post_rule <> 'keep_nearest' AND EXISTS (SELECT 1 FROM csize s WHERE s.case_id = c.case_id AND s.mask_id = c.mask_id AND s.label = c.label AND s.n >= 2))),
        kc AS (SELECT case_id, mask_id, count(*) AS p FROM kept GROUP BY case_id, mask_id), gc AS (SELECT case_id, mask_id, count(*) AS g FROM gt GROUP BY case_id, mask_id),
        ic AS (SELECT k.case_id, k.mask_id, count(*) AS i FROM kept k JOIN gt g ON g.case_id = k.case_id AND g.mask_id = k.mask_id AND g.z = k.z AND g.y = k.y AND g.x = k.x GROUP BY k.case_id, k.mask_id),
        gscored AS (SELECT fx.target_form, fx.anatomy, CASE WHEN coalesce(p, 0) + coalesce(g, 0) = 0 THEN 1.0::double ELSE 2.0::double * coalesce(i, 0) / (coalesce(p, 0) + coalesce(g, 0)) END AS dice
          FROM fx LEFT JOIN kc USING (case_id, mask_id) LEFT JOIN gc USING (case_id, mask_id) LEFT JOIN ic USING (case_id, mask_id))
        {_summary('gscored', 'target_form')}""",
)
def _(d):
    priors = cut_lineage(blended(d).select(*T, "target_form", "anatomy", "post_rule", *rt.EXTENT))
    boxes = bx.prior_slices(bx.prior_to_pixels(priors, D, H, W, margin=2)).select(*T, "z", "x1", "y1", "x2", "y2")
    prob = tr.inside_box(d.vox.select(*V, "prob"), boxes)
    raw = vx.threshold_fixed(prob, 0.5).select(*V)
    clean = cc.postprocess_route(raw, priors, priors.select(*T, *rt.EXTENT), D, H, W, min_size=2)
    scored = mt.overlap_metrics(clean, d.gt, priors.select(*T, "target_form", "anatomy"))
    return rounded(rp.result_summary(scored, keys=["target_form"]))


@query(
    "failure_modes",
    f"""WITH {largest_sql('pred', _FACE2, 'case_id, mask_id, z')}, b AS (SELECT case_id, mask_id, z, greatest(0, min(x) - 5) AS x1, greatest(0, min(y) - 5) AS y1, least({W}, max(x) + 5) AS x2, least({H}, max(y) + 5) AS y2 FROM big GROUP BY case_id, mask_id, z),
        t AS (SELECT case_id, mask_id, z, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM gt GROUP BY case_id, mask_id, z),
        j AS (SELECT case_id, mask_id, z, CASE WHEN b.x1 IS NULL THEN 'empty' WHEN t.x1 IS NULL THEN 'wrong_slice' WHEN (b.x2 - b.x1) * (b.y2 - b.y1) > 3 * (t.x2 - t.x1) * (t.y2 - t.y1) THEN 'too_large'
           WHEN sqrt(((b.x1 + b.x2) / 2 - (t.x1 + t.x2) / 2) ** 2 + ((b.y1 + b.y2) / 2 - (t.y1 + t.y2) / 2) ** 2) > 0.5003 * sqrt(((t.x2 - t.x1) / 2) ** 2 + ((t.y2 - t.y1) / 2) ** 2) THEN 'off_centre' ELSE 'ok' END AS failure
           FROM b FULL JOIN t USING (case_id, mask_id, z))
        SELECT failure, count(*) AS n FROM j GROUP BY failure""",
)
def _(d):
    boxes = bx.bbox2d_fixed(cc.largest_cc(d.pred, dim=2), H, W)
    truth = d.gt.groupBy(*T, "z").agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2")
    )
    return ql.failure_modes(boxes, truth, off_centre=0.5003).groupBy("failure").agg(F.count(F.lit(1)).alias("n"))


# Dice of a target under each wording, from the value columns of the events.
@query(
    "robustness_report",
    """WITH v AS (SELECT case_id, mask_id, mode, 'raw' AS variant, direct AS dice FROM runs WHERE direct IS NOT NULL
         UNION ALL SELECT case_id, mask_id, mode, 'short', refined FROM runs WHERE refined IS NOT NULL UNION ALL SELECT case_id, mask_id, mode, 'keyword', oracle FROM runs WHERE oracle IS NOT NULL)
       SELECT v.variant, count(*) AS n, round(avg(v.dice - b.dice), 6) AS mean_delta, round(avg(abs(v.dice - b.dice)), 6) AS mean_abs_delta, count(*) FILTER (WHERE v.dice < b.dice) AS worse
       FROM v JOIN v b USING (case_id, mask_id) WHERE b.variant = 'raw' AND v.variant <> 'raw' GROUP BY v.variant""",
)
def _(d):
    wording = F.explode(
        F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("dice")) for n, c in (("raw", "direct"), ("short", "refined"), ("keyword", "oracle"))])
    )
    v = d.runs.select(*T, wording.alias("w")).select(*T, "w.*").where("dice IS NOT NULL")
    return rounded(rp.robustness_report(v))
