"""Views that turn the supplied tables into annotation data.

The same SQL text runs on Spark and on the checking database.  All keys are
cut from running ids, so every view grows with its table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import path_exists, scratch_path, spread_rows

D, H, W = 16, 32, 32  # grid of one case
DENSE = 16  # side of the folded frame
STOP_WORDS = ["and", "at", "in", "the", "is", "with", "both", "several"]

VIEWS = {
    # One row per claimed voxel: several masks may claim the same position.
    "raw_vox": """
        SELECT cast(floor(l_orderkey / 375) AS bigint) AS case_id, l_partkey % 16 AS z, l_suppkey % 32 AS y,
          cast(floor(l_extendedprice) AS bigint) % 32 AS x, cast(l_linenumber % 3 + 1 AS bigint) AS mask_id,
          CASE WHEN l_discount >= 0.03 THEN 1 ELSE 0 END AS g,
          CASE WHEN l_quantity > 15 THEN 1 ELSE 0 END AS p, l_quantity / 50.0 AS prob,
          l_linenumber % 2 AS variant, l_tax AS tax
        FROM lineitem""",
    # Labelled grid: one mask per voxel, ground truth g, prediction p, probability.
    "vox": """
        SELECT case_id, z, y, x, min(mask_id) AS mask_id, max(g) AS g, max(p) AS p, max(prob) AS prob
        FROM raw_vox GROUP BY case_id, z, y, x""",
    "gt": "SELECT case_id, mask_id, z, y, x FROM vox WHERE g = 1",
    "pred": "SELECT case_id, mask_id, z, y, x FROM vox WHERE p = 1",
    # The same voxels folded onto a quarter of the frame, one mask: large touching blobs.
    "dense": """
        SELECT case_id, cast(1 AS bigint) AS mask_id, z, y % 16 AS y, x % 16 AS x, max(prob) AS prob
        FROM raw_vox GROUP BY case_id, z, y % 16, x % 16""",
    # Findings; ids above 3 are targets with an empty mask.
    "descr": """
        SELECT doc_id, cast(floor(doc_id / 25) AS bigint) AS case_id, doc_id % 25 + 1 AS mask_id, doc_id % 25 AS pos,
          concat('A ', split_part('|multiple |diffuse |several ', '|', cast(floor(doc_id / 3) AS int) % 4 + 1),
            split_part('left |right |bilateral ||both |left and right ', '|', cast(doc_id % 6 AS int) + 1),
            split_part('liver|renal|lung|spleen|cardiac|aorta|gallbladder|bladder|vertebral|lumbar disc|soft tissue|pelvic', '|', cast(floor(doc_id / 6) AS int) % 12 + 1), ' ',
            split_part('mass|nodules|cyst|calcification|effusion|fracture|lymph nodes|thickening|enlargement|finding', '|', cast(floor(doc_id / 5) AS int) % 10 + 1),
            split_part('| at C5| at L4| in the upper pole| (considered benign), is seen with enhancement. It is stable over a long period of time, which is reassuring', '|', cast((doc_id * 13) % 5 AS int) + 1)) AS text
        FROM documents""",
    # Three experiment runs with gaps.
    "runs": """
        SELECT cast(floor(event_id / 200) AS bigint) AS case_id, event_id % 200 AS mask_id,
          CASE WHEN event_id % 2 = 0 THEN 'raw' ELSE 'structured' END AS mode,
          CASE WHEN event_id % 10 <> 0 THEN (CASE WHEN event_type = 'error' THEN 0.0 ELSE round(value - floor(value), 2) END) END AS direct,
          CASE WHEN event_id % 7 <> 0 THEN (CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 0.0 ELSE round(value * 3 - floor(value * 3), 2) END) END AS refined,
          CASE WHEN event_id % 5 = 0 THEN round(value * 7 - floor(value * 7), 2) END AS oracle
        FROM events""",
    # Result rows with volumes over five orders of magnitude.
    "evals": """
        SELECT cast(floor(o_orderkey / 100) AS bigint) AS case_id, o_orderkey % 100 AS mask_id,
          CASE WHEN o_orderkey % 2 = 0 THEN 'raw' ELSE 'structured' END AS mode,
          CASE WHEN o_orderstatus = 'F' THEN 'focal' WHEN o_orderstatus = 'O' THEN 'diffuse' ELSE 'bony' END AS target_form,
          concat('organ', cast(o_custkey % 17 AS varchar(10))) AS anatomy,
          cast(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE floor(o_totalprice / (1 + (o_custkey % 10) * (o_custkey % 10) * (o_custkey % 100))) END AS bigint) AS gt_voxels,
          cast(floor(o_totalprice / (1 + (o_custkey % 10) * (o_custkey % 10) * (o_custkey % 100)) * (o_orderkey % 7) / 1.5) AS bigint) AS pred_voxels,
          cast(o_orderkey * 37 % 101 AS double) / 101 AS dice, o_custkey % 4 AS slices_used
        FROM orders""",
    # Vectors of slices; the picture of a slice is its vector, some are blank.
    "emb_slice": """
        SELECT cast(floor(vec_id / 16) AS bigint) AS case_id, vec_id % 16 AS z, vec_id, label, embedding
        FROM embeddings""",
}


def _used(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def ctes(sql: str, stored: frozenset[str] = frozenset()) -> str:
    """Prefix a query with the definitions of the views it uses, ``stored`` ones excepted."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in stored:
            return
        for dep in _used(VIEWS[name]):
            if dep != name:
                add(dep)
        if name not in order:
            order.append(name)

    for name in _used(sql):
        add(name)
    if not order:
        return sql.strip()
    defs = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {defs},\n{rest[10:]}"
        return f"WITH {defs},\n{rest}"
    return f"WITH {defs}\n{body}"


TABLES = ["lineitem", "documents", "events", "orders", "embeddings", "labels", "customer"]


# Views written once per application and folder, as annotation data would be stored.
STORED = frozenset({"vox", "dense", "descr"})

_SCHEMAS: dict[str, object] = {}
_PATHS: dict[tuple[str, str, str], str] = {}


class Data:
    """The supplied tables and the views above, as DataFrames of one session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self._read(f"{self.sf_dir}/{name}.parquet")

    def _read(self, path: str) -> DataFrame:
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def _stored(self, view: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, view)
        if key not in _PATHS or not path_exists(self.spark, _PATHS[key]):
            path = scratch_path(self.spark, view)
            self._view(view).write.parquet(path)
            _PATHS[key] = path
        return self._read(_PATHS[key])

    def _view(self, view: str) -> DataFrame:
        """Rows of ``raw_vox`` are grouped by slices dealt to tasks of bounded size."""
        if "FROM raw_vox" not in VIEWS[view]:
            return self.sql(VIEWS[view])
        raw = spread_rows(self.raw_vox, self.table("lineitem").count(), "case_id", "z")
        return self.spark.sql(VIEWS[view].replace("FROM raw_vox", "FROM {raw_vox}"), raw_vox=raw)

    def sql(self, text: str) -> DataFrame:
        full = ctes(text, STORED)
        used = {}
        for name in [*TABLES, *STORED]:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", full):
                used[name] = self._stored(name) if name in STORED else self.table(name)
                full = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", full)
        return self.spark.sql(full, **used)

    def __getattr__(self, view: str) -> DataFrame:
        if view not in VIEWS:
            raise AttributeError(view)
        return self._stored(view) if view in STORED else self.sql(VIEWS[view])
