"""Queries: masks as runs, distance maps, summed-volume tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distance as ds
from ..operators import runs as rn
from ..operators import summed as sm
from .fixtures import DENSE, D, H, W
from .q_reports import SCORED, targets
from .registry import query, rounded

T = ["case_id", "mask_id"]


def islands(voxels: str) -> str:
    """SQL of the maximal runs of a voxel subquery."""
    return f"""SELECT case_id, mask_id, z, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *,
      x - row_number() OVER (PARTITION BY case_id, mask_id, z, y ORDER BY x) AS k FROM ({voxels})) GROUP BY case_id, mask_id, z, y, k"""


def sets(where: str) -> str:
    return islands(f"SELECT case_id, mask_id, z, y, x FROM vox WHERE {where}")


@query("mask_runs", sets("g = 1"))
def _(d):
    return rn.mask_runs(d.gt)


@query(
    "runs_algebra",
    f"""SELECT 'and' AS op, * FROM ({sets("p = 1 AND g = 1")}) UNION ALL SELECT 'or', * FROM ({sets("p = 1 OR g = 1")})
        UNION ALL SELECT 'minus', * FROM ({sets("p = 1 AND g = 0")}) UNION ALL SELECT 'xor', * FROM ({sets("p <> g")})""",
)
def _(d):
    a, b = rn.stored_runs(d.pred), rn.stored_runs(d.gt)
    made = {"and": rn.runs_and, "or": rn.runs_or, "minus": rn.runs_minus, "xor": rn.runs_xor}
    out = None
    for op, fn in made.items():
        part = fn(a, b).select(F.lit(op).alias("op"), *rn.RUN)
        out = part if out is None else out.unionByName(part)
    return out


@query("runs_overlap", f'WITH {SCORED} SELECT case_id, mask_id, pred_pos, gt_pos, "inter", round(dice, 6) AS dice, round(iou, 6) AS iou FROM scored')
def _(d):
    return rounded(rn.runs_overlap(rn.stored_runs(d.pred), rn.stored_runs(d.gt), targets(d)))


OUTSIDE = f"""grid AS (SELECT unnest(range(-1, {DENSE + 1})) AS i),
   slices AS (SELECT DISTINCT case_id, mask_id, z FROM dense),
   outside AS (SELECT s.case_id, s.mask_id, s.z, a.i AS y, b.i AS x FROM slices s, grid a, grid b
     WHERE NOT EXISTS (SELECT 1 FROM dense m WHERE m.case_id = s.case_id AND m.z = s.z AND m.y = a.i AND m.x = b.i)),
   dist AS (SELECT m.case_id, m.mask_id, m.z, m.y, m.x, min(abs(m.y - o.y) + abs(m.x - o.x)) AS distance
     FROM dense m JOIN outside o ON m.case_id = o.case_id AND m.z = o.z GROUP BY m.case_id, m.mask_id, m.z, m.y, m.x)"""


@query("distance_map", f"WITH {OUTSIDE} SELECT * FROM dist")
def _(d):
    return ds.distance_map(d.dense)


@query("erode_by_distance", f"WITH {OUTSIDE} SELECT k AS iterations, case_id, mask_id, z, y, x FROM dist, (SELECT unnest([1, 2, 3]) AS k) WHERE distance > k")
def _(d):
    far = ds.distance_map(d.dense, limit=3, tile=8)
    return far.withColumn("iterations", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))).where("distance > iterations").drop("distance")


BOXES = """ends AS (SELECT case_id, mask_id, min(z) AS az, max(z) + 1 AS bz, min(y) AS ay, max(y) + 1 AS by_, min(x) AS ax, max(x) + 1 AS bx
     FROM pred GROUP BY case_id, mask_id),
   boxes AS (SELECT case_id, mask_id, m AS margin, az - m AS z0, bz + m AS z1, ay - m AS y0, by_ + m AS y1, ax - m AS x0, bx + m AS x1
     FROM ends, (SELECT unnest([-9, -6, -3, -1, 0, 2]) AS m))"""


@query(
    "box_mass",
    f"""WITH {BOXES} SELECT b.*, count(v.x) AS mass FROM boxes b LEFT JOIN gt v ON v.case_id = b.case_id AND v.mask_id = b.mask_id
        AND v.z >= z0 AND v.z < z1 AND v.y >= y0 AND v.y < y1 AND v.x >= x0 AND v.x < x1 GROUP BY ALL""",
)
def _(d):
    """Voxels of the truth inside candidate boxes: the predicted box of every target with several margins."""
    ends = d.pred.groupBy(*T).agg(*[f(a).alias(f"{n}{a}") for a in "zyx" for n, f in (("lo_", F.min), ("hi_", F.max))])
    margin = F.explode(F.array(*[F.lit(m) for m in (-9, -6, -3, -1, 0, 2)])).alias("margin")
    sides = [c for a in "zyx" for c in ((F.col(f"lo_{a}") - F.col("margin")).alias(f"{a}0"), (F.col(f"hi_{a}") + 1 + F.col("margin")).alias(f"{a}1"))]
    boxes = ends.select("*", margin).select(*T, "margin", *sides)
    return sm.box_mass(sm.summed_volume(d.gt, D, H, W), boxes, D, H, W)
