"""Summed-volume tables: how many voxels any box holds, from eight look-ups.

A mask is cut into cubes.  Three passes, one along each axis, turn counts into
prefix sums: within a line of cubes the last face of each is carried into the
next; lines stream through a task, many summed at once.  Cubes that come before every voxel in some
axis are absent and stand for zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .components import _begins, whole_parts
from .voxels import TARGET, VOXEL

SIDE = 8  # voxels along an edge of a cube
CUBE = ["bz", "by", "bx"]
AT_ONCE = 2048  # cubes summed together in a worker


def _local(voxels: DataFrame, side: int, weight: str | None) -> DataFrame:
    """Cubes with the counts (or whole-number weights) of their voxels in (z, y, x) order."""
    axes = {"bz": "z", "by": "y", "bx": "x"}
    spot = ((F.col("z") % side) * side + F.col("y") % side) * side + F.col("x") % side
    value = F.lit(1) if weight is None else F.col(weight)
    placed = voxels.select(
        *TARGET, *[F.floor(F.col(a) / side).cast("int").alias(b) for b, a in axes.items()], spot.cast("int").alias("at"), value.cast("bigint").alias("v")
    )
    one = F.max("v") if weight is None else F.sum("v")  # repeated voxels count once, their weights add up
    placed = placed.groupBy(*TARGET, *CUBE, "at").agg(one.alias("v"))
    # at most side ** 3 entries a cube
    return placed.groupBy(*TARGET, *CUBE).agg(F.collect_list("at").alias("at"), F.collect_list("v").alias("v"))


def _along(axis: int, side: int, cubes: int):
    """Arrow function: prefix sums along lines of cubes, each cube taking over the last face of the one before.

    Cubes come sorted by line and place.  Many lines are summed at once; a worker
    holds an Arrow batch, one line that goes on in the next and ``AT_ONCE`` cubes.
    """
    name, size = CUBE[axis], side**3
    line = [*TARGET, *[c for c in CUBE if c != name]]

    def dense(lines: pa.RecordBatch, kind: type) -> np.ndarray:
        if "sums" in lines.schema.names:
            return lines.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, side, side, side)
        at, v = lines.column("at"), lines.column("v")
        out = np.zeros((len(lines), size), kind)
        row = np.repeat(np.arange(len(lines)), at.value_lengths().to_numpy(zero_copy_only=False))
        out[row, at.flatten().to_numpy(zero_copy_only=False)] = v.flatten().to_numpy(zero_copy_only=False)
        return out.reshape(-1, side, side, side)

    def summed(lines: pa.RecordBatch, kind: type) -> Iterator[pa.RecordBatch]:
        place = lines.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.flatnonzero(_begins(lines, line))
        ends = np.append(starts[1:], len(lines))
        count = cubes - place[starts]  # from a line's first cube to the end of the frame
        group = (np.cumsum(count) - count) // AT_ONCE
        for g in np.unique(group):
            chosen = np.flatnonzero(group == g)
            begin, end, n = starts[chosen], ends[chosen], count[chosen]
            rows = slice(begin[0], end[-1])
            base = np.cumsum(n) - n
            at = np.repeat(base - place[begin], end - begin) + place[rows]
            sums = np.zeros((n.sum(), side, side, side), kind)
            sums[at] = dense(lines.slice(rows.start, rows.stop - rows.start), kind)
            np.cumsum(sums, axis=axis + 1, out=sums)
            last = sums.take([-1], axis=axis + 1)
            before = last.cumsum(axis=0, dtype=np.int64) - last
            before -= np.repeat(before[base], n, axis=0)
            sums += before.astype(kind)
            cols = {c: lines.column(c).take(pa.array(np.repeat(begin, n))) for c in line}
            cols[name] = pa.array((np.arange(len(sums)) - np.repeat(base - place[begin], n)).astype(np.int32))
            cols["sums"] = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * size), pa.array(sums.ravel()))
            names = [*TARGET, *CUBE, "sums"]
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return line, summed


def _pass(cubes: DataFrame, axis: int, side: int, n: int, ddl: str, kind: type) -> DataFrame:
    line, summed = _along(axis, side, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in whole_parts(batches, line):
            yield from summed(lines, kind)

    return cubes.repartition(*line).sortWithinPartitions(*line, CUBE[axis]).mapInArrow(run, ddl)


def summed_volume(voxels: DataFrame, d: int, h: int, w: int, side: int = SIDE, weight: str | None = None) -> DataFrame:
    """Stored ``(case_id, mask_id, bz, by, bx, sums)`` of masks inside a ``d, h, w`` frame.

    ``sums`` lists, for each voxel of a cube, the voxels (or the ``weight``, a
    whole number) at or before it on all three axes, over the whole mask.
    """
    ship_package(voxels.sparkSession)
    inside = F.col("z").between(0, d - 1) & F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1)
    cubes = _local(voxels.where(inside), side, weight)
    small = weight is None and d * h * w < 2**31  # counts fit four bytes
    kinds = dict(cubes.dtypes)
    ddl = ", ".join(f"{c} {kinds[c]}" for c in TARGET) + f", bz int, by int, bx int, sums array<{'int' if small else 'bigint'}>"
    now = cubes
    for axis, size in ((2, w), (1, h), (0, d)):
        now = _pass(now, axis, side, -(-size // side), ddl, np.int32 if small else np.int64)
    return cut_lineage(now)


def box_mass(table: DataFrame, boxes: DataFrame, d: int, h: int, w: int, side: int = SIDE) -> DataFrame:
    """``boxes`` with ``mass``, the voxels inside ``[z0, z1) x [y0, y1) x [x0, x1)``, from a summed-volume table.

    Boxes are cut to the frame; an empty box, or a target without voxels, holds
    none.  Columns of ``boxes`` besides the key and the six ends stay.
    """
    ends = {"z": d, "y": h, "x": w}
    cut = {f"_{a}{k}": F.least(F.greatest(F.col(f"{a}{k}"), F.lit(0)), F.lit(n)).cast("int") for a, n in ends.items() for k in (0, 1)}
    numbered = boxes.withColumn("_box", F.struct(*boxes.columns)).withColumns(cut)
    solid = (F.col("_z0") < F.col("_z1")) & (F.col("_y0") < F.col("_y1")) & (F.col("_x0") < F.col("_x1"))
    corner = F.explode(F.array(*[
        F.struct(*[(F.col(f"_{a}{k}") - 1).alias(a) for a, k in zip("zyx", ks)], F.lit((-1) ** (3 - sum(ks))).alias("sign"))
        for ks in np.ndindex(2, 2, 2)
    ]))
    corners = numbered.where(solid).select("_box", *TARGET, corner.alias("c")).select("_box", *TARGET, "c.*")
    corners = corners.where((F.col("z") >= 0) & (F.col("y") >= 0) & (F.col("x") >= 0))
    # the corners are hashed, so the wide rows of the table needn't be sorted
    corners = corners.select(
        "_box", *TARGET, "sign", *[F.floor(F.col(a) / side).cast("int").alias(b) for b, a in zip(CUBE, "zyx")],
        (((F.col("z") % side) * side + F.col("y") % side) * side + F.col("x") % side + 1).cast("int").alias("_at"),
    )
    found = table.join(corners.hint("shuffle_hash"), [*TARGET, *CUBE]).groupBy("_box").agg(F.sum(F.col("sign") * F.element_at("sums", F.col("_at"))).alias("mass"))
    every = numbered.select("_box").distinct().join(found, "_box", "left")
    return every.select("_box.*", F.coalesce("mass", F.lit(0).cast("bigint")).alias("mass"))


def box_voxels(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """The same by comparing every box with every voxel of its target; for tests."""
    inside = (F.col("z") >= F.col("z0")) & (F.col("z") < F.col("z1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    inside = inside & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    met = boxes.join(voxels.select(*VOXEL).distinct(), TARGET, "left").groupBy(*boxes.columns)
    return met.agg(F.count(F.when(inside, 1)).alias("mass"))
