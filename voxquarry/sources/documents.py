"""One JSON document per case as a Spark data source, written in two steps.

``write_documents(rows, root, "aux_labels.json")`` takes ``(case_id, key,
body)`` rows, ``body`` being JSON, and writes ``root/<case>/aux_labels.json``
with one object a case.  Rows are sorted, so a task streams them into one open
file, however large a case is.  Tasks write to a staging folder below the root
and report their files; only the commit, after all tasks have ended, moves
them to their places.  A failing job leaves none.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import ship_package
from .tables import AUX_SCHEMA, PSEUDO_BOX_SCHEMA, aux_body, box_entries
from .volumes import open_filesystem

SCHEMA = "case_id string, key string, body string"


@dataclass
class _Staged(WriterCommitMessage):
    """Files of one task: where they lie and where they belong."""

    files: list[tuple[str, str]]


class _OpenCase:
    """The document of one case while its rows arrive."""

    def __init__(self, fs, path: str):
        self.stream = fs.open_output_stream(path)
        self.stream.write(b"{")
        self.last: str | None = None

    def add(self, key: str, body: str) -> None:
        if key is None or body is None:
            raise ValueError("a document needs keys and bodies")
        if key == self.last:
            raise ValueError(f"key {key!r} twice in a case")
        self.stream.write(f"{'' if self.last is None else ', '}{json.dumps(key)}: {body}".encode())
        self.last = key

    def close(self) -> None:
        self.stream.write(b"}\n")
        self.stream.close()


class CaseDocumentWriter(DataSourceWriter):
    def __init__(self, options):
        self.root, self.file = options["path"].rstrip("/"), options["file"]
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows) -> _Staged:
        fs, root = open_filesystem(self.root)
        attempt = posixpath.join(root, self.staging, uuid.uuid4().hex)  # of this attempt alone
        fs.create_dir(attempt)
        files, now, open_case = [], None, None
        for case, key, body in rows:
            if open_case is None or case != now:
                if open_case:
                    open_case.close()
                if not case or "/" in case or case in (".", ".."):
                    raise ValueError(f"{case!r} is no name of a case")
                staged = posixpath.join(attempt, f"{len(files)}.json")
                files.append((staged, posixpath.join(root, case, self.file)))
                now, open_case = case, _OpenCase(fs, staged)
            open_case.add(key, body)
        if open_case:
            open_case.close()
        return _Staged(files)

    def commit(self, messages) -> None:
        fs, root = open_filesystem(self.root)
        files = [f for m in messages if m is not None for f in m.files]
        places = {place for _, place in files}
        if len(places) < len(files):
            self.abort(messages)
            raise ValueError("rows of a case reached several tasks; partition by case and sort")
        for staged, place in files:
            fs.create_dir(posixpath.dirname(place))
            fs.move(staged, place)
        self._clear(fs, root)

    def abort(self, messages) -> None:
        self._clear(*open_filesystem(self.root))

    def _clear(self, fs, root: str) -> None:
        folder = posixpath.join(root, self.staging)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class CaseDocuments(DataSource):
    """Write ``path/<case>/<file>``; options: path, file."""

    @classmethod
    def name(cls):
        return "case_documents"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return CaseDocumentWriter(self.options)


def write_documents(rows: DataFrame, root: str, file: str, order: str = "key") -> None:
    """Write ``rows(case_id, key, body)``, keys in the given order; documents of the same name are replaced.

    One shuffle by case.  Keys repeated within a case, null keys or bodies and
    case names that leave the folder are errors, and then nothing is written.
    """
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(CaseDocuments)
    rows = rows.repartition("case_id").sortWithinPartitions("case_id", order)
    rows = rows.select(F.col("case_id").cast("string"), F.col("key").cast("string"), "body")
    rows.write.format("case_documents").option("path", root).option("file", file).mode("append").save()


def read_documents(spark: SparkSession, root: str, file: str, schema: str) -> DataFrame:
    """``case_id, key, value``: the entries of every ``root/<case>/<file>``; ``schema`` is that of the whole object."""
    text = spark.read.option("wholetext", "true").option("pathGlobFilter", file).option("recursiveFileLookup", "true").text(root)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    decoded = F.try_url_decode(name)
    return text.select(decoded.alias("case_id"), F.explode(F.from_json("value", schema)).alias("key", "value"))


def write_aux_documents(aux: DataFrame, root: str, file: str = "aux_labels.json") -> None:
    """Auxiliary labels, one object per case, keyed by mask id in ascending order."""
    rows = aux.select("case_id", F.col("mask_id").alias("key"), F.to_json(aux_body(), {"ignoreNullFields": "false"}).alias("body"))
    write_documents(rows, root, file)


def read_aux_documents(spark: SparkSession, root: str, file: str = "aux_labels.json") -> DataFrame:
    rows = read_documents(spark, root, file, AUX_SCHEMA)

    def item(field: str, names: list[str]) -> list[Column]:
        return [F.get(f"value.{field}", F.lit(i)).alias(n) for i, n in enumerate(names)]

    return rows.select(
        "case_id", F.col("key").cast("bigint").alias("mask_id"), "value.existence", "value.slice_exist",
        *item("bbox_3d", ["z1", "y1", "x1", "z2", "y2", "x2"]),
        *item("centroid_3d", ["cz", "cy", "cx"]),
        *item("z_range", ["z_lo", "z_hi"]),
        "value.volume", "value.component_count",
    )


def write_box_documents(boxes: DataFrame, d: int, root: str, file: str = "pseudo_boxes.json") -> None:
    """Per-slice boxes, one object per case: mask id, then mode, then prompt, ``d`` slots and counts."""
    modes = box_entries(boxes, d).groupBy("case_id", "mask_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("mode", "entry")))).alias("modes"))
    rows = modes.select("case_id", F.col("mask_id").alias("key"), F.to_json("modes", {"ignoreNullFields": "false"}).alias("body"))
    write_documents(rows, root, file)


def read_box_documents(spark: SparkSession, root: str, d: int, file: str = "pseudo_boxes.json") -> DataFrame:
    rows = read_documents(spark, root, file, PSEUDO_BOX_SCHEMA)
    modes = rows.select("case_id", F.col("key").cast("bigint").alias("mask_id"), F.explode("value").alias("mode", "e")).where(F.size("e.boxes") == d)
    slots = modes.select("case_id", "mask_id", "mode", "e.prompt", "e.gt_pos", "e.pred_pos", F.posexplode("e.boxes").alias("z", "b"))
    return slots.where(F.col("b").isNotNull()).select(
        "case_id", "mask_id", "mode", "prompt", "z", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], "gt_pos", "pred_pos"
    )
