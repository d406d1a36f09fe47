"""Queries: sources and sinks, labels, splits, samples, learning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import boxes as bx
from ..operators import labels as lb
from ..operators import learning as ml
from ..operators import sampling as sp
from ..operators import shuffle as sh
from ..operators import slices as sl
from ..operators import store as st
from ..operators import voxels as vx
from ..session import cut_lineage, scratch_path, ship_package
from ..sources import documents as dc
from ..sources import tables as tb
from ..sources import volumes as vol
from .fixtures import D, H, W
from .q_raster import AUX, aux_of, comp_sql
from .q_voxels import DUCK_PICTURE, FIXED_BOX, pictures
from .registry import query, rounded

T = ["case_id", "mask_id"]

# --- files ------------------------------------------------------------------------


def write_case_files(d) -> str:
    """Write every labelled case as ``<root>/c<id>/mask.npy``; one task per case."""
    ship_package(d.spark)
    root = scratch_path(d.spark, "cases")

    def save(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((1, D, H, W), dtype=np.float32)
        grid[0, pdf.z, pdf.y, pdf.x] = pdf.mask_id
        fs, base = vol.open_filesystem(root)
        fs.create_dir(f"{base}/c{key[0]}")
        with fs.open_output_stream(f"{base}/c{key[0]}/mask.npy") as out:
            np.save(out, grid)
        return pd.DataFrame({"n": [len(pdf)]})

    # A case is one dense grid of fixed size, so the group is bounded.
    d.gt.groupBy("case_id").applyInPandas(save, "n long").agg(F.sum("n")).collect()
    return root


@query("volume_ingest", "SELECT concat('c', cast(case_id AS varchar)) AS case_id, cast(mask_id AS int) AS mask_id, cast(z AS int) AS z, cast(y AS int) AS y, cast(x AS int) AS x FROM gt")
def _(d):
    return vol.volume_ingest(d.spark, write_case_files(d), kind="mask", emit="voxels")


@query(
    "volume_slices_needed",
    """SELECT concat('c', cast(case_id AS varchar)) AS case_id, cast(mask_id AS int) AS mask_id, cast(z AS int) AS z, cast(y AS int) AS y, cast(x AS int) AS x
       FROM gt g WHERE EXISTS (SELECT 1 FROM gt t WHERE t.case_id = g.case_id AND t.z = g.z AND t.mask_id = 3 AND t.x < 3)""",
)
def _(d):
    """Only the slices on which a label touches the margin are read from the files."""
    wanted = vx.slice_needed(d.gt.where("mask_id = 3 AND x < 3")).withColumn("case_id", F.concat(F.lit("c"), "case_id"))
    return vol.volume_ingest(d.spark, write_case_files(d), kind="mask", emit="voxels", slices=wanted)


@query("case_scan", f"SELECT DISTINCT concat('c', cast(case_id AS varchar)) AS case_id, 'mask' AS kind, cast({D * H * W * 4 + 128} AS bigint) AS length FROM gt")
def _(d):
    return tb.case_scan(d.spark, write_case_files(d)).select("case_id", "kind", "length")


FILES = "SELECT DISTINCT o_custkey AS case_id, ['ct', 'mask', 'text', 'notes'][cast(o_orderkey % 4 + 1 AS int)] AS kind FROM orders"


@query("case_complete", f"SELECT case_id FROM ({FILES}) WHERE kind <> 'notes' GROUP BY case_id HAVING count(DISTINCT kind) = 3")
def _(d):
    kind = F.get(F.array(*[F.lit(k) for k in ("ct", "mask", "text", "notes")]), (F.col("o_orderkey") % 4).cast("int"))
    files = d.table("orders").select(F.col("o_custkey").alias("case_id"), kind.alias("kind"))
    return lb.case_complete(files, ["ct", "mask", "text"])


@query("case_limit", "SELECT case_id, mask_id, dice FROM evals WHERE case_id IN (SELECT DISTINCT case_id FROM evals ORDER BY case_id LIMIT 7)")
def _(d):
    return lb.case_limit(d.evals, 7).select(*T, "dice")


def text_maps(d):
    """Findings as one JSON map per case, with an extra non-target key."""
    entry = F.struct(F.col("mask_id").cast("string").alias("k"), F.col("text").alias("v"))
    # A case lists its findings in one document, as a case folder does.
    per_case = d.descr.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("pos", entry.alias("e")))).alias("es"))
    extra = F.array(*[F.struct(F.lit(k).alias("k"), F.lit("x").alias("v")) for k in ("instance_label", "n/a")])
    entries = F.concat(F.transform("es", lambda e: e["e"]), extra)
    return per_case.select("case_id", F.to_json(F.map_from_entries(entries)).alias("json"))


@query("text_map_explode", "SELECT case_id, cast(mask_id AS int) AS mask_id, cast(pos AS int) AS pos, text FROM descr")
def _(d):
    return tb.text_map_explode(text_maps(d))


@query(
    "label_fallback",
    """WITH t AS (SELECT case_id, mask_id, text FROM descr)
       SELECT case_id, mask_id, text FROM t UNION ALL SELECT DISTINCT case_id, mask_id, '' FROM gt g WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.case_id = g.case_id)""",
)
def _(d):
    return lb.label_fallback(d.descr, d.gt)


def box_rows(d):
    boxes = bx.bbox2d_fixed(d.gt, H, W)
    n = d.gt.groupBy(*T).agg(F.count(F.lit(1)).alias("gt_pos"))
    return boxes.join(n, T).withColumns({"mode": F.lit("raw"), "prompt": F.lit('a "quoted", text'), "pred_pos": F.col("gt_pos") - 1})


@query(
    "boxes_pack",
    f"""WITH b AS ({FIXED_BOX}), g AS (SELECT case_id, mask_id, unnest(generate_series(0, {D - 1})) AS z FROM (SELECT DISTINCT case_id, mask_id FROM gt)),
        s AS (SELECT g.case_id, g.mask_id, string_agg(CASE WHEN x1 IS NULL THEN 'null' ELSE concat('[', concat_ws(',', x1, y1, x2, y2), ']') END, ',' ORDER BY g.z) AS t FROM g LEFT JOIN b USING (case_id, mask_id, z) GROUP BY g.case_id, g.mask_id),
        n AS (SELECT case_id, mask_id, count(*) AS c FROM gt GROUP BY case_id, mask_id)
        SELECT s.case_id, concat('{{"', s.mask_id, '":{{"raw":{{"prompt":"a \\"quoted\\", text","boxes":[', t, '],"gt_pos":', c, ',"pred_pos":', c - 1, '}}}}}}') AS json FROM s JOIN n USING (case_id, mask_id)""",
)
def _(d):
    return tb.boxes_pack(box_rows(d), D)


@query(
    "boxes_explode",
    f"WITH b AS ({FIXED_BOX}) SELECT case_id, mask_id, 'raw' AS mode, 'a \"quoted\", text' AS prompt, cast(z AS int) AS z, x1, y1, x2, y2 FROM b WHERE case_id % 4 <> 1",
)
def _(d):
    whole = tb.boxes_pack(box_rows(d).where("case_id % 4 <> 1"), D)
    short = tb.boxes_pack(box_rows(d).where("case_id % 4 = 1"), D - 1)  # wrong length: dropped
    return tb.boxes_explode(whole.unionByName(short), D)


@query(
    "aux_json_io",
    f"""WITH {comp_sql('gt')}, {AUX} SELECT case_id, mask_id, existence, array_to_string(slice_exist, '') AS flags, round(z1, 9) AS z1, round(x2, 9) AS x2, round(cy, 9) AS cy,
        round(volume, 9) AS volume, component_count FROM aux""",
)
def _(d):
    back = tb.aux_from_json(tb.aux_to_json(aux_of(d)))
    flags = F.array_join(F.transform("slice_exist", lambda v: v.cast("string")), "")
    flat = back.select(*T, "existence", flags.alias("flags"), "z1", "x2", "cy", "volume", "component_count")
    return rounded(flat, 9)


AUX_NUMBERS = ["z1", "y1", "x1", "z2", "y2", "x2", "cz", "cy", "cx"]


@query(
    "aux_case_documents",
    f"""WITH {comp_sql('gt')}, {AUX} SELECT cast(case_id AS varchar) AS case_id, mask_id, existence, array_to_string(slice_exist, '') AS flags,
        {', '.join(f'round({c}, 9) AS {c}' for c in AUX_NUMBERS)}, round(z1, 9) AS z_lo, round(z2, 9) AS z_hi, round(volume, 9) AS volume, component_count FROM aux""",
)
def _(d):
    """All numbers of the auxiliary labels through one JSON file per case and back."""
    root = scratch_path(d.spark, "aux-documents")
    dc.write_aux_documents(aux_of(d), root)
    flags = F.array_join(F.transform("slice_exist", lambda v: v.cast("string")), "").alias("flags")
    back = dc.read_aux_documents(d.spark, root)
    return rounded(back.select("case_id", "mask_id", "existence", flags, *AUX_NUMBERS, "z_lo", "z_hi", "volume", "component_count"), 9)


@query(
    "box_case_documents",
    f"""WITH b AS ({FIXED_BOX}), n AS (SELECT case_id, mask_id, count(*) AS c FROM gt GROUP BY case_id, mask_id)
        SELECT cast(b.case_id AS varchar) AS case_id, b.mask_id, m AS mode, 'a "quoted", text' AS prompt, cast(b.z AS int) AS z, x1, y1, x2, y2,
          n.c AS gt_pos, n.c - 1 AS pred_pos FROM b JOIN n USING (case_id, mask_id), (SELECT unnest(['raw', 'structured']) AS m)""",
)
def _(d):
    """Boxes of every target and mode through one nested JSON file per case and back."""
    root = scratch_path(d.spark, "box-documents")
    both = F.explode(F.array(F.lit("raw"), F.lit("structured")))
    dc.write_box_documents(box_rows(d).withColumn("mode", both), D, root)
    return dc.read_box_documents(d.spark, root, D)


@query("split_list_io", "SELECT DISTINCT concat('s', cast(o_custkey AS varchar)) AS case_id FROM orders")
def _(d):
    path = scratch_path(d.spark, "split")
    names = d.table("orders").select(F.concat(F.lit("  s"), F.col("o_custkey"), F.lit(" ")).alias("case_id")).distinct()
    blanks = d.table("orders").where("o_orderkey % 100 = 0").select(F.lit("   ").alias("case_id"))
    tb.write_split_list(names.unionByName(blanks), path)
    return tb.read_split_list(d.spark, path)


RESULT = """SELECT e.case_id, e.mask_id, e.mode, concat('say "left, right" ', repeat('x', 110), cast(e.mask_id AS varchar(10))) AS text,
   e.gt_voxels, e.pred_voxels, e.dice, e.dice / 2 AS iou FROM evals e"""


def _results(d):
    return d.sql(RESULT)


@query("results_load", "SELECT cast(case_id AS varchar) AS case_id, cast(mask_id AS int) AS mask_id, mode, round(dice, 4) AS dice_a FROM evals")
def _(d):
    path = tb.results_write(_results(d), scratch_path(d.spark, "results"), "a")
    schema = "case_id string, mask_id int, text string, gt_voxels bigint, pred_voxels bigint, dice double, iou double, mode string"
    return tb.results_load(d.spark, path, schema, "a")


@query("results_write", f"SELECT cast(case_id AS varchar) AS case_id, cast(mask_id AS int) AS mask_id, mode, substr(text, 1, 120) AS text, gt_voxels, pred_voxels, round(dice, 4) AS dice, round(iou, 4) AS iou FROM ({RESULT})")
def _(d):
    path = tb.results_write(_results(d), scratch_path(d.spark, "results"))
    schema = "case_id string, mask_id int, text string, gt_voxels bigint, pred_voxels bigint, dice double, iou double, mode string"
    return d.spark.read.schema(schema).csv(path, header=True, quote='"', escape='"')


@query("metrics_append", "SELECT o_orderkey % 3 AS epoch, count(*) AS n, round(avg(o_totalprice), 4) AS score FROM orders GROUP BY 1")
def _(d):
    path = scratch_path(d.spark, "metrics")
    for epoch in range(3):
        row = d.table("orders").where(F.col("o_orderkey") % 3 == epoch).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("score"))
        tb.metrics_append(row.withColumn("epoch", F.lit(epoch).cast("bigint")), path)
    return tb.metrics_read(d.spark, path, "epoch bigint, n bigint, score double")


# More cases are drawn than described, so some lack their texts.
@query("missing_inputs", "SELECT DISTINCT case_id FROM gt WHERE case_id NOT IN (SELECT case_id FROM descr)")
def _(d):
    return lb.missing_inputs(d.gt, d.descr)


@query("required_inputs", "SELECT DISTINCT case_id FROM gt WHERE case_id IN (SELECT case_id FROM descr)")
def _(d):
    """Passes only if no case lacks its texts, so the cases are completed first."""
    complete = d.gt.select("case_id").distinct().join(lb.missing_inputs(d.gt, d.descr), "case_id", "left_anti")
    return lb.required_inputs(complete, d.descr)


# --- indexes, splits, samples --------------------------------------------------------

TRAIN = """tc AS (SELECT case_id FROM (SELECT case_id, row_number() OVER (ORDER BY sha256(concat('42|', cast(case_id AS varchar)))) AS r, count(*) OVER () AS n
   FROM (SELECT DISTINCT case_id FROM descr)) WHERE r <= floor(n * 0.8::double))"""
AUX_FLAGS = f"""{TRAIN}, gz AS (SELECT DISTINCT case_id, mask_id, z FROM gt),
   fl AS (SELECT t.case_id, t.mask_id, cast(i AS int) AS z, CASE WHEN gz.z IS NULL THEN 0 ELSE 1 END AS is_positive
   FROM descr t JOIN tc USING (case_id) CROSS JOIN (SELECT unnest(generate_series(0, {D - 1})) AS i) s
   LEFT JOIN gz ON gz.case_id = t.case_id AND gz.mask_id = t.mask_id AND gz.z = i)"""


def train_cases(d):
    return sp.random_case_split(d.descr.select("case_id")).where("split = 'train'")


def slice_flags(d):
    """Index of the training cases over all their targets."""
    aux = lb.aux_labels(d.gt, d.descr.select(*T, "text"), D, H, W)
    return lb.slice_index(aux, train_cases(d))


@query("slice_index", f"WITH {AUX_FLAGS} SELECT * FROM fl")
def _(d):
    return slice_flags(d)


@query("case_index", f"WITH {TRAIN} SELECT case_id, mask_id FROM descr JOIN tc USING (case_id)")
def _(d):
    return lb.case_index(d.descr, train_cases(d))


TRAINING_SQL = f"""WITH RECURSIVE {AUX_FLAGS}, s AS (SELECT case_id, z, list_sum(px) AS s FROM ({DUCK_PICTURE})), tri AS (SELECT case_id, z, coalesce(lag(s) OVER w, s) AS p, s AS c, coalesce(lead(s) OVER w, s) AS n FROM s WINDOW w AS (PARTITION BY case_id ORDER BY z)),
        m AS (SELECT case_id, mask_id, z, count(*) AS n FROM gt GROUP BY case_id, mask_id, z), b AS (SELECT case_id, mask_id, min(z) / {float(D)}::double AS z1 FROM gt GROUP BY case_id, mask_id)
        SELECT fl.case_id, fl.mask_id, fl.z, is_positive, t.text, coalesce(m.n, 0) AS gt_pixels, round(tri.p, 6) AS prev, round(tri.c, 6) AS curr, round(tri.n, 6) AS next, round(coalesce(z1, 0), 6) AS z1
        FROM fl JOIN descr t ON t.case_id = fl.case_id AND t.mask_id = fl.mask_id LEFT JOIN tri ON tri.case_id = fl.case_id AND tri.z = fl.z
        LEFT JOIN m ON m.case_id = fl.case_id AND m.mask_id = fl.mask_id AND m.z = fl.z LEFT JOIN b ON b.case_id = fl.case_id AND b.mask_id = fl.mask_id"""


@query("training_rows", TRAINING_SQL.replace("WITH RECURSIVE", "WITH", 1))
def _(d):
    aux = lb.aux_labels(d.gt, d.descr.select(*T, "text"), D, H, W)
    index = lb.slice_index(aux, train_cases(d))
    return sample_sums(sl.training_rows(index, sl.slice_triplet(pictures(d)), aux, d.descr, d.gt))


def sample_sums(rows, *more):
    total = lambda c: F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda a, v: a + v).alias(c)
    n = F.greatest(F.coalesce(F.size("gt_pixels"), F.lit(0)), F.lit(0)).cast("bigint").alias("gt_pixels")
    return rounded(rows.select(*T, "z", "is_positive", "text", n, total("prev"), total("curr"), total("next"), "z1", *more))


def _names(d):
    return d.table("orders").select(F.concat(F.lit("s"), F.col("o_custkey")).alias("case_id"))


NAMES = "SELECT DISTINCT concat('s', cast(o_custkey AS varchar)) AS case_id FROM orders"


@query(
    "hash_split",
    f"""WITH r AS (SELECT case_id, row_number() OVER (ORDER BY sha256(case_id)) AS r FROM ({NAMES}))
        SELECT case_id, CASE WHEN r <= 50 THEN 'train' WHEN r <= 80 THEN 'dev' ELSE 'test' END AS split FROM r WHERE r <= 98""",
)
def _(d):
    return sp.hash_split(_names(d), 50, 30, 18)


@query(
    "random_case_split",
    f"""WITH r AS (SELECT case_id, row_number() OVER (ORDER BY sha256(concat('42|', case_id))) AS r, count(*) OVER () AS n FROM ({NAMES}))
        SELECT case_id, CASE WHEN r <= floor(n * 0.8::double) THEN 'train' ELSE 'val' END AS split FROM r""",
)
def _(d):
    return sp.random_case_split(_names(d))


@query(
    "negative_sample",
    f"""WITH {AUX_FLAGS}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id, mask_id, is_positive ORDER BY sha256(concat_ws('|', 0, case_id, mask_id, z))) AS r,
          sum(is_positive) OVER (PARTITION BY case_id, mask_id) AS p FROM fl)
        SELECT case_id, mask_id, z, is_positive FROM r WHERE is_positive = 1 OR r <= greatest(3 * p, 3)""",
)
def _(d):
    return sp.negative_sample(slice_flags(d))


def _draw(*parts):
    return f"('0x' || substr(sha256(concat_ws('|', {', '.join(map(str, parts))})), 1, 15))::bigint"


@query(
    "posneg_sample",
    f"""WITH {AUX_FLAGS}, r AS (SELECT *, row_number() OVER (PARTITION BY is_positive ORDER BY case_id, mask_id, z) - 1 AS r FROM fl),
        n AS (SELECT is_positive, count(*) AS size FROM fl GROUP BY is_positive), t AS (SELECT count(*) AS n, cast(round_even(count(*) * 0.7, 0) AS bigint) AS p FROM fl),
        dr AS (SELECT draw, CASE WHEN draw < p THEN 1 ELSE 0 END AS is_positive FROM t, LATERAL (SELECT unnest(range(t.n)) AS draw)),
        k AS (SELECT draw, is_positive, {_draw(3, 0, 'draw')} % size AS r, {_draw(3, 0, "'order'", 'draw')} AS order_key FROM dr JOIN n USING (is_positive))
        SELECT k.is_positive, draw, order_key, case_id, mask_id, z FROM k JOIN r ON r.is_positive = k.is_positive AND r.r = k.r""",
)
def _(d):
    return sp.posneg_sample(slice_flags(d), seed=3)


def feistel_sql(rows: str, seed: int, epoch: int) -> str:
    """Checking SQL of the epoch order: numbered ``rows`` go round by round, those outside 0..n-1 again."""
    parts = [f"""nm AS (SELECT *, row_number() OVER (ORDER BY case_id, mask_id, z) - 1 AS number FROM ({rows})),
        sz AS (SELECT count(*) AS n, cast(floor(sqrt(count(*) - 1)) AS bigint) + 1 AS a FROM nm),
        sd AS (SELECT n, a, cast(ceil(n / a::double) AS bigint) AS b FROM sz),
        start AS (SELECT number, number AS x, n, a, b, true AS outside FROM nm, sd)"""]
    inner = "SELECT number, n, a, b, x % a AS l, x // a AS r FROM walk WHERE outside"
    for k, (f, g, h) in enumerate(sh.keys_of(seed, epoch)):
        stays, moves, size = ("r", "l", "a") if k % 2 == 0 else ("l", "r", "b")
        inner = f"""SELECT * REPLACE (({moves} + ((({stays} % {sh.PRIME} * {f} + {g}) % {sh.PRIME}) * (({stays} % {sh.PRIME} * {f} + {g}) % {sh.PRIME}) + {h})
          % {sh.PRIME}) % {size} AS {moves}) FROM ({inner})"""
    parts.append(f"walk AS (SELECT * FROM start UNION ALL SELECT number, r * a + l AS x, n, a, b, r * a + l >= n FROM ({inner}))")
    return ",\n".join(parts)


EPOCH = (5, 2)  # seed and epoch


@query(
    "epoch_order",
    f"""WITH RECURSIVE {AUX_FLAGS}, {feistel_sql('SELECT * FROM fl', *EPOCH)}
        SELECT case_id, mask_id, z, is_positive, number, x AS place FROM nm JOIN walk USING (number) WHERE NOT outside""",
)
def _(d):
    rows = sh.numbered(slice_flags(d), [*T, "z"])
    n = rows.count()
    return sh.epoch_order(rows, n, *EPOCH).select(*T, "z", "is_positive", "number", "place")


@query(
    "training_epoch",
    f"""WITH RECURSIVE {AUX_FLAGS}, {feistel_sql('SELECT * FROM fl', *EPOCH)}, made AS ({TRAINING_SQL.replace('WITH RECURSIVE', 'WITH', 1)})
        SELECT made.*, x AS place FROM made JOIN nm USING (case_id, mask_id, z) JOIN walk USING (number) WHERE NOT outside""",
)
def _(d):
    """An epoch of all training rows from two stores in the same buckets."""
    aux = lb.aux_labels(d.gt, d.descr.select(*T, "text"), D, H, W)
    samples = st.sample_store(lb.slice_index(aux, train_cases(d)), aux, d.descr, d.gt, 8)
    store = st.picture_store(sl.slice_triplet(pictures(d)), 8)
    return sample_sums(st.epoch_rows(samples, store, samples.count(), *EPOCH), "place")


@query(
    "posneg_sample_counts",
    f"WITH {AUX_FLAGS}, n AS (SELECT count(*) AS n, cast(round_even(count(*) * 0.7, 0) AS bigint) AS p FROM fl) SELECT 1 AS is_positive, p AS draws FROM n UNION ALL SELECT 0, n - p FROM n",
)
def _(d):
    return sp.posneg_sample(slice_flags(d), seed=3).groupBy("is_positive").agg(F.count(F.lit(1)).alias("draws"))


# --- learning --------------------------------------------------------------------------


def _pairs(d):
    text = d.table("embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("txt"))
    ask = d.emb_slice.withColumn("ask", (F.col("case_id") % 10).cast("int"))
    return ask.join(text.withColumnRenamed("label", "ask"), "ask").select(
        "case_id", "z", F.col("embedding").alias("img"), "txt", (F.col("label") == F.col("ask")).cast("int").alias("label")
    )


@query(
    "pair_features",
    """WITH t AS (SELECT label, arg_min(embedding, vec_id)::double[] AS t FROM embeddings GROUP BY label),
       p AS (SELECT s.case_id, s.z, list_transform(s.embedding::double[], lambda v : v / sqrt(list_inner_product(s.embedding::double[], s.embedding::double[]))) AS a,
         list_transform(t.t, lambda v : v / sqrt(list_inner_product(t.t, t.t))) AS b FROM emb_slice s JOIN t ON t.label = s.case_id % 10),
       i AS (SELECT *, unnest(range(1, 65)) AS j FROM p)
       SELECT case_id, z, cast(j - 1 AS int) AS i, round(a[j], 6) AS v FROM i UNION ALL SELECT case_id, z, cast(j + 63 AS int), round(b[j], 6) FROM i
       UNION ALL SELECT case_id, z, cast(j + 127 AS int), round(a[j] * b[j], 6) FROM i UNION ALL SELECT case_id, z, cast(j + 191 AS int), round(abs(a[j] - b[j]), 6) FROM i""",
)
def _(d):
    f = ml.pair_features(_pairs(d), "img", "txt")
    return rounded(f.select("case_id", "z", F.posexplode("features").alias("i", "v")))


def _scored_pairs(d):
    f = ml.pair_features(_pairs(d), "img", "txt").select("case_id", "z", "features", "label")
    split = sp.random_case_split(f.select(F.col("case_id").cast("string").alias("case_id")), seed=1)
    f = cut_lineage(f.withColumn("case_id", F.col("case_id").cast("string")).join(split, "case_id"))
    model = ml.slice_classifier(f.where("split = 'train'"), f.where("split = 'val'"), reg_params=(0.01, 0.1), max_iter=10)
    return ml.slice_probability(model, f)


@query("slice_classifier")
def _(d):
    return rounded(_scored_pairs(d).select("case_id", "z", "label", "prob"))


# What can be checked of a fitted model: every row of both splits has a probability.
@query(
    "slice_classifier_facts",
    """WITH c AS (SELECT case_id, row_number() OVER (ORDER BY sha256(concat('1|', cast(case_id AS varchar)))) AS r, count(*) OVER () AS n
         FROM (SELECT DISTINCT case_id FROM emb_slice)), s AS (SELECT case_id, CASE WHEN r <= floor(n * 0.8::double) THEN 'train' ELSE 'val' END AS split FROM c)
       SELECT split, CASE WHEN e.label = case_id % 10 THEN 1 ELSE 0 END AS label, count(*) AS n, count(*) AS n_scored FROM emb_slice e JOIN s USING (case_id) GROUP BY ALL""",
)
def _(d):
    scored = _scored_pairs(d).groupBy("split", "label")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prob").between(0.0, 1.0)).alias("n_scored"))


def _demo_model():
    """A deterministic stand-in for a user's network: mean absolute value of a row."""
    return lambda batch: np.abs(batch.astype(np.float64)).mean(axis=1)


@query("batch_score", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v : abs(v::double))) / 64, 6) AS score FROM embeddings")
def _(d):
    scored = ml.batch_score(d.table("embeddings"), _demo_model, "embedding", 64)
    return rounded(scored.select("vec_id", "score"))
