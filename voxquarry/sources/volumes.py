"""Volume files (``.npy``) as a Spark data source.

``spark.dataSource.register(NpyVolumeSource)`` and then
``spark.read.format("npy_volume").option("path", root).option("kind", "ct").load()``
gives one row per slice; with ``option("emit", "voxels")`` the non-zero labels.

``volume_ingest`` lists the files by a Spark job, joins the listing with the
slices that are wanted, and hands the source this manifest: files of other
cases are not opened, and of a wanted file only the bytes of the wanted slices
are read.  The source has no ``pushFilters``: Spark 4.1 keeps one pushed set
per loaded table, so two filters on one DataFrame would read the same slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import cut_lineage, ship_package

SLICE_SCHEMA = "case_id string, z int, h int, w int, px array<float>"
VOXEL_SCHEMA = "case_id string, mask_id int, z int, y int, x int"


class _Piece(InputPartition):
    """Some files with their wanted slices, or one z-range share (part of parts) of a large file."""

    def __init__(self, files: list[tuple[str, list[int] | None]], part: int, parts: int):
        self.files, self.part, self.parts = files, part, parts


def open_filesystem(root: str):
    """File system of a path or URI, and the path inside it."""
    if root.startswith("file:"):
        root = "/" + root[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


def _header(stream) -> tuple[tuple[int, int, int], np.dtype, int]:
    """Shape, kind of number and first byte of a C-ordered volume."""
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(stream)
    if len(shape) == 4 and shape[0] == 1:
        shape = shape[1:]
    if len(shape) != 3 or fortran:
        raise ValueError(f"expected a C-ordered (D,H,W) volume, found shape {shape}")
    return shape, dtype, stream.tell()


class NpyVolumeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.kind = options.get("kind", "ct")
        self.emit = options.get("emit", "slices")
        self.target = int(options.get("bytes_per_task", str(64 << 20)))
        self.manifest = options.get("manifest")
        self.bytes_read = 0

    def _files(self) -> list[tuple[str, int, list[int] | None]]:
        """Paths, sizes and wanted slices, from the stored manifest if there is one."""
        if not self.manifest:
            fs, root = open_filesystem(self.root)
            infos = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            return sorted((i.path, i.size, None) for i in infos if i.is_file and i.base_name == f"{self.kind}.npy")
        fs, place = open_filesystem(self.manifest)
        rows: list[tuple] = []
        for part in fs.get_file_info(pafs.FileSelector(place)):
            if part.path.endswith(".parquet"):
                with fs.open_input_file(part.path) as stream:
                    for batch in pq.ParquetFile(stream).iter_batches(columns=["path", "length", "wanted"], use_threads=False):
                        rows += zip(*[c.to_pylist() for c in batch.columns])
        return sorted(rows, key=lambda r: r[0])

    def partitions(self):
        """Plan from the listing alone: small files together, large ones split by z."""
        pieces, group, size = [], [], 0
        for path, nbytes, wanted in self._files():
            parts = -(-nbytes // self.target)
            if parts > 1:
                pieces += [_Piece([(path, wanted)], p, parts) for p in range(parts)]
                continue
            if group and size + nbytes > self.target:
                pieces.append(_Piece(group, 0, 1))
                group, size = [], 0
            group.append((path, wanted))
            size += nbytes
        if group:
            pieces.append(_Piece(group, 0, 1))
        return pieces

    def read(self, piece: _Piece | None):
        if piece is None:  # without any file there is one empty partition
            return
        fs, _ = open_filesystem(self.root)
        for path, wanted in piece.files:
            case = path.rsplit("/", 2)[-2]
            with fs.open_input_file(path) as stream:
                for first, slab in self._slabs(stream, piece, wanted):
                    yield self._voxels(case, first, slab) if self.emit == "voxels" else self._slices(case, first, slab)

    def _slabs(self, stream, piece: _Piece, wanted: list[int] | None) -> Iterator[tuple[int, np.ndarray]]:
        """First slice number and slices of each stretch of wanted slices in a share of a volume."""
        (d, h, w), dtype, start = _header(stream)
        step = h * w * dtype.itemsize
        lo, hi = d * piece.part // piece.parts, d * (piece.part + 1) // piece.parts
        left = [z for z in (range(lo, hi) if wanted is None else sorted(set(wanted))) if lo <= z < hi]
        most = max(1, self.target // max(step, 1))
        while left:
            n = 1
            while n < len(left) and n < most and left[n] == left[0] + n:
                n += 1
            stream.seek(start + left[0] * step)
            data = stream.read(n * step)
            self.bytes_read += len(data)
            yield left[0], np.frombuffer(data, dtype=dtype).reshape(n, h, w)
            left = left[n:]

    def _slices(self, case: str, first: int, slab: np.ndarray) -> pa.RecordBatch:
        n, h, w = slab.shape
        flat = pa.array(slab.astype(np.float32).ravel())
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (h * w))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([case] * n), pa.array(np.arange(first, first + n, dtype=np.int32)),
                pa.array(np.full(n, h, np.int32)), pa.array(np.full(n, w, np.int32)),
                pa.ListArray.from_arrays(offsets, flat),
            ],
            names=["case_id", "z", "h", "w", "px"],
        )

    def _voxels(self, case: str, first: int, slab: np.ndarray) -> pa.RecordBatch:
        labels = np.rint(slab).astype(np.int32)
        z, y, x = np.nonzero(labels)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([case] * len(z)), pa.array(labels[z, y, x]),
                pa.array((z + first).astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)),
            ],
            names=["case_id", "mask_id", "z", "y", "x"],
        )


class NpyVolumeSource(DataSource):
    """Read ``root/<case>/<kind>.npy``; options: path, kind, emit, bytes_per_task, manifest."""

    @classmethod
    def name(cls):
        return "npy_volume"

    def schema(self):
        return VOXEL_SCHEMA if self.options.get("emit") == "voxels" else SLICE_SCHEMA

    def reader(self, schema):
        return NpyVolumeReader(self.options)


def volume_files(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """``(case_id, path, length)`` of the volumes below a root; Spark lists the folders in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{kind}.npy").load(root)
    case = F.element_at(F.split("path", "/"), -2)
    # paths as the readers' file systems take them: without a scheme
    bare = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^[a-z0-9]+://", "")
    return files.select(case.alias("case_id"), bare.alias("path"), "length")


def manifest(spark: SparkSession, root: str, kind: str, slices: DataFrame | None = None, cases: Column | str | None = None) -> DataFrame:
    """Stored ``(path, length, wanted)``: the files to open, and their wanted slices (null: all)."""
    files = volume_files(spark, root, kind)
    if cases is not None:
        files = files.where(cases)
    if slices is None:
        return cut_lineage(files.select("path", "length", F.lit(None).cast("array<int>").alias("wanted")))
    # no more entries a case than it has slices
    wanted = slices.select(F.col("case_id").cast("string"), F.col("z").cast("int").alias("z")).groupBy("case_id").agg(F.sort_array(F.collect_set("z")).alias("wanted"))
    return cut_lineage(files.join(wanted, "case_id").select("path", "length", "wanted"))


def volume_ingest(
    spark: SparkSession,
    root: str,
    kind: str = "ct",
    emit: str = "slices",
    slices: DataFrame | None = None,
    cases: Column | str | None = None,
    bytes_per_task: int = 64 << 20,
) -> DataFrame:
    """Slices of intensity volumes, or labelled voxels of mask volumes.

    ``slices`` is a table of the wanted ``(case_id, z)``, as of
    ``voxels.slice_needed``, and ``cases`` a condition on ``case_id``: other
    files are not opened and other slices' bytes not read.  Wanted slices that
    a volume doesn't have give no rows.
    """
    ship_package(spark)
    spark.dataSource.register(NpyVolumeSource)
    reader = spark.read.format("npy_volume").option("path", root).option("kind", kind).option("emit", emit)
    listing = manifest(spark, root, kind, slices, cases).stage_path
    return reader.option("bytes_per_task", str(bytes_per_task)).option("manifest", listing).load()
