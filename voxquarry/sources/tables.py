"""Readers and writers of the file formats around the data: JSON, CSV, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.voxels import TARGET

PSEUDO_BOX_SCHEMA = (
    "map<string,map<string,struct<prompt:string,boxes:array<array<int>>,gt_pos:bigint,pred_pos:bigint>>>"
)
AUX_SCHEMA = (
    "map<string,struct<existence:int,slice_exist:array<int>,bbox_3d:array<double>,"
    "centroid_3d:array<double>,z_range:array<double>,volume:double,component_count:bigint>>"
)


def case_scan(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root/<case>/`` as (case_id, kind, path, length); contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    )
    part = F.split("path", "/")
    return files.select(
        F.element_at(part, -2).alias("case_id"),
        F.regexp_replace(F.element_at(part, -1), r"\.[^.]*$", "").alias("kind"),
        "path", "length",
    )


def text_map_explode(files: DataFrame, json: str = "json") -> DataFrame:
    """JSON object {id: text} per case -> one row per integer id, in key order."""
    entries = F.map_entries(F.from_json(F.col(json), "map<string,string>"))
    return (
        files.select("case_id", F.posexplode(entries).alias("pos", "e"))
        .where(F.col("e.key") != "instance_label")
        .select("case_id", F.expr("try_cast(e.key AS int)").alias("mask_id"), "pos", F.col("e.value").alias("text"))
        .where(F.col("mask_id").isNotNull())
    )


def boxes_pack(boxes: DataFrame, d: int) -> DataFrame:
    """Per-slice boxes -> one JSON document per target, gaps as null, length ``d``.

    A document holds the d slices of one target; documents of a case are not
    gathered, so a large case stays many rows (``sources.documents`` writes
    one file a case).
    """
    entries = box_entries(boxes, d)
    nested = F.create_map(F.col("mask_id").cast("string"), F.create_map(F.col("mode"), F.col("entry")))
    return entries.select("case_id", F.to_json(nested, {"ignoreNullFields": "false"}).alias("json"))


def box_entries(boxes: DataFrame, d: int) -> DataFrame:
    """``case_id, mask_id, mode, entry``: prompt, ``d`` slots and counts of each target and mode.

    Input: case_id, mask_id, mode, prompt, z, x1..y2 (NULL = no box), gt_pos, pred_pos.
    """
    has = F.col("x1").isNotNull()
    per_mode = boxes.groupBy(*TARGET, "mode").agg(
        F.first("prompt", ignorenulls=True).alias("prompt"),
        F.collect_list(
            F.when(has, F.struct(F.col("z").cast("int").alias("z"), F.array("x1", "y1", "x2", "y2").cast("array<int>").alias("b")))
        ).alias("items"),
        F.max("gt_pos").alias("gt_pos"),
        F.max("pred_pos").alias("pred_pos"),
    )
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda z: F.try_element_at(F.map_from_entries(F.col("items")), z),
    )
    return per_mode.select(*TARGET, "mode", F.struct("prompt", slots.alias("boxes"), "gt_pos", "pred_pos").alias("entry"))


def boxes_explode(docs: DataFrame, d: int, json: str = "json") -> DataFrame:
    """Inverse of ``boxes_pack``; entries whose box list is not ``d`` long are dropped.

    A document may hold any number of masks and modes of its case.
    """
    return (
        docs.select("case_id", F.explode(F.from_json(F.col(json), PSEUDO_BOX_SCHEMA)).alias("mask", "modes"))
        .select("case_id", F.col("mask").cast("bigint").alias("mask_id"), F.explode("modes").alias("mode", "e"))
        .where(F.size("e.boxes") == d)
        .select("case_id", "mask_id", "mode", F.col("e.prompt").alias("prompt"), F.posexplode("e.boxes").alias("z", "b"))
        .where(F.col("b").isNotNull())
        .select(
            *TARGET, "mode", "prompt", "z",
            *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        )
    )


def aux_body() -> Column:
    """All numbers of one target's auxiliary labels."""
    return F.struct(
        "existence", "slice_exist",
        F.array("z1", "y1", "x1", "z2", "y2", "x2").alias("bbox_3d"),
        F.array("cz", "cy", "cx").alias("centroid_3d"),
        F.array("z_lo", "z_hi").alias("z_range"),
        "volume", "component_count",
    )


def aux_to_json(aux: DataFrame) -> DataFrame:
    """Auxiliary labels -> one JSON object per case, keyed by mask id in ascending order.

    An object has each key once: rows that repeat a target go to further
    objects of their case.
    """
    copy = F.row_number().over(Window.partitionBy(*TARGET).orderBy("mask_id"))
    rows = aux.select("case_id", "mask_id", aux_body().alias("body"), copy.alias("copy"))
    per_case = rows.groupBy("case_id", "copy").agg(F.sort_array(F.collect_list(F.struct("mask_id", "body"))).alias("es"))
    entries = F.transform("es", lambda e: F.struct(e["mask_id"].cast("string"), e["body"]))
    return per_case.select("case_id", F.to_json(F.map_from_entries(entries)).alias("json"))


def aux_from_json(docs: DataFrame, json: str = "json") -> DataFrame:
    """Inverse of ``aux_to_json``: one row per case and mask id."""
    rows = docs.select("case_id", F.explode(F.from_json(F.col(json), AUX_SCHEMA)).alias("mask", "a"))

    def item(field: str, names: list[str]) -> list[Column]:
        return [F.get(f"a.{field}", F.lit(i)).alias(n) for i, n in enumerate(names)]

    return rows.select(
        "case_id", F.col("mask").cast("bigint").alias("mask_id"), "a.existence", "a.slice_exist",
        *item("bbox_3d", ["z1", "y1", "x1", "z2", "y2", "x2"]),
        *item("centroid_3d", ["cz", "cy", "cx"]),
        *item("z_range", ["z_lo", "z_hi"]),
        "a.volume", "a.component_count",
    )


def read_split_list(spark: SparkSession, path: str) -> DataFrame:
    """One case id per line; blanks are trimmed and empty lines dropped."""
    line = F.trim(F.col("value"))
    return spark.read.text(path).select(line.alias("case_id")).where(F.col("case_id") != "")


def write_split_list(cases: DataFrame, path: str) -> None:
    """Sorted ids as text; part files follow the order."""
    cases.select(F.col("case_id").cast("string")).orderBy("case_id").write.mode("overwrite").text(path)


# Canonical result rows; names other writers use are mapped on load.
RESULT_SCHEMA = (
    "case_id string, mask_id int, mode string, text string, gt_voxels bigint, pred_voxels bigint, "
    "dice double, iou double"
)
COLUMN_ALIASES = {
    "case": "case_id", "gt_pos": "gt_voxels", "pred_pos": "pred_voxels", "label_desc": "text", "prompt": "text",
}


def results_load(spark: SparkSession, path: str, schema: str, tag: str, keep: list[str] | None = None) -> DataFrame:
    """CSV run results -> canonical names, the metric suffixed with the run tag.

    Quoted fields may contain commas, doubled quotes and line breaks.
    """
    raw = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)
    df = raw.withColumnsRenamed({k: v for k, v in COLUMN_ALIASES.items() if k in raw.columns})
    keys = keep or [c for c in ("case_id", "mask_id", "mode") if c in df.columns]
    return df.select(*keys, F.col("dice").alias(f"dice_{tag}"))


def results_rows(df: DataFrame) -> DataFrame:
    """Rows as written: metrics with 4 decimals, text cut at 120 characters."""
    metrics = {c: F.round(c, 4) for c in ("dice", "iou") if c in df.columns}
    return df.withColumns({**metrics, "text": F.substring("text", 1, 120)})


def results_write(df: DataFrame, path: str, tag: str = "") -> str:
    """One CSV folder per mode below ``path`` (suffixed with the tag); returns the path."""
    out = f"{path}_{tag}" if tag else path
    results_rows(df).write.mode("overwrite").partitionBy("mode").csv(out, header=True, quote='"', escape='"')
    return out


def metrics_append(row: DataFrame, path: str) -> None:
    row.write.mode("append").json(path)


def metrics_read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
