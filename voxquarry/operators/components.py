"""Connected components of sparse masks, 2-D per slice or 3-D per volume.

1. Voxels become horizontal runs (one window over single image rows).
2. Runs of one block - a slice, or ``BLOCK`` slices of one mask - are labelled
   together.  They stream to Python block by block; a block is bounded by its
   pixel count (at most BLOCK * H * W / 2 runs); lower ``block`` for very large
   frames.
3. For 3-D, labels of neighbouring blocks that touch are edges; they are
   contracted by alternating large-star and small-star joins, which need
   O(log) rounds and never gather a volume in one task.

A component is named by the packed position of its first voxel in (z, y, x)
order, so names are stable and the smallest name is the earliest component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, drop_stage, ship_package, shuffled
from .boxes import bbox2d_fixed
from .voxels import SLICE, TARGET, VOXEL

BLOCK = 16
Z_SHIFT, Y_SHIFT = 40, 20  # coordinates stay below 2**20


def packed_position(z: Column, y: Column, x: Column) -> Column:
    return F.shiftleft(z.cast("bigint"), Z_SHIFT) + F.shiftleft(y.cast("bigint"), Y_SHIFT) + x


def voxel_runs(voxels: DataFrame) -> DataFrame:
    """Maximal horizontal runs ``(case_id, mask_id, z, y, x0, x1)``; repeated voxels count once."""
    row = Window.partitionBy(*SLICE, "y").orderBy("x")
    return (
        voxels.withColumn("_island", F.col("x") - F.dense_rank().over(row))
        .groupBy(*SLICE, "y", "_island")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("_island")
    )


def _touching(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, reach: int):
    """Index pairs (i, j): run j lies in row ``want[i]`` and overlaps run i.

    Runs are sorted by (row, start) and disjoint within a row, so the partners
    of a run are one contiguous range.
    """
    span = 1 << (Y_SHIFT + 2)
    first = np.searchsorted(key * span + hi, want * span + np.maximum(lo - reach, 0), side="left")
    last = np.searchsorted(key * span + lo, want * span + hi + reach, side="right")
    count = np.maximum(last - first, 0)
    left = np.repeat(np.arange(len(key)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return left, np.repeat(first, count) + step


def _label_blocks(block, z, y, a, b, reach):
    """Smallest member index of the component of every run, all blocks at once."""
    # One integer per (block, z, y) row, with gaps so that +1 never hits another block.
    zs, ys = z - z.min(), y - y.min()
    width_y = int(ys.max()) + 2
    width_z = int(zs.max()) + 2
    key = (block * width_z + zs) * width_y + ys
    order = np.lexsort((a, key))
    key, lo, hi = key[order], a[order], b[order]
    i1, j1 = _touching(key, lo, hi, key + 1, reach)
    i2, j2 = _touching(key, lo, hi, key + width_y, 0)
    i, j = np.concatenate([i1, i2]), np.concatenate([j1, j2])
    label = np.arange(len(key))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:  # pointer jumping
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    first = (z[order] << Z_SHIFT) + (y[order] << Y_SHIFT) + lo
    out = np.empty(len(key), dtype=np.int64)
    out[order] = first[label]
    return out


def _begins(runs: pa.RecordBatch, part: list[str]) -> np.ndarray:
    """Marks the rows that begin a part; null equals null."""
    new = np.zeros(len(runs), dtype=bool)
    new[0] = True
    for c in part:
        code = runs.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def whole_parts(batches: Iterator[pa.RecordBatch], part: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``part``, cut anew so that no part is spread over two; holds one batch and one part."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    held = []  # the last part so far
    for batch in batches:
        if not len(batch):
            continue
        if held and _begins(joined([held[-1].slice(len(held[-1]) - 1), batch.slice(0, 1)]), part)[1]:
            yield joined(held)
            held = []
        cut = int(np.flatnonzero(_begins(batch, part))[-1])
        if cut:
            yield joined([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield joined(held)


def _labeller(part: list[str], reach: int):
    """Arrow function that adds labels to runs sorted by ``part``."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in whole_parts(batches, part):
            z, y, a, b = (runs.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("z", "y", "x0", "x1"))
            labels = _label_blocks(np.cumsum(_begins(runs, part)), z, y, a, b, reach)
            yield pa.RecordBatch.from_arrays([*runs.columns, pa.array(labels)], [*runs.schema.names, "label"])

    return label


def label_parts(runs: DataFrame, part: list[str], diagonal: bool) -> DataFrame:
    """``runs`` with the ``label`` of each, found within the parts that the columns ``part`` name.

    Runs stream to Python in Arrow batches, sorted by part, so a worker's memory
    depends on the largest part alone.
    """
    ship_package(runs.sparkSession)
    whole = {c: F.col(c).cast("bigint") for c in ("z", "y", "x0", "x1")}
    sorted_ = runs.withColumns(whole).repartition(*part).sortWithinPartitions(*part)
    schema = T.StructType([*sorted_.schema.fields, T.StructField("label", T.LongType())])
    return sorted_.mapInArrow(_labeller(part, 1 if diagonal else 0), schema)


def _label_in_blocks(runs: DataFrame, depth: int, diagonal: bool) -> DataFrame:
    placed = runs.withColumn("_block", F.floor(F.col("z") / depth))
    return label_parts(placed, [*TARGET, "_block"], diagonal).select(*SLICE, "y", "x0", "x1", "label")


def _star_roots(edges: DataFrame) -> DataFrame:
    """Map every label that is not a root to the smallest label of its component.

    ``edges`` is (case_id, mask_id, hi, lo) with hi > lo.  The result has the
    same shape, each ``lo`` being a root.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.where(F.col("hi") > F.col("lo")).distinct()

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(*TARGET, F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            e.select(*TARGET, F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = both.groupBy(*TARGET, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return ordered(
            both.where(F.col("v") > F.col("u"))
            .join(shuffled(low), [*TARGET, "u"])
            .select(*TARGET, F.col("v").alias("hi"), F.col("m").alias("lo"))
        )

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy(*TARGET, "hi").agg(F.min("lo").alias("m"))
        moved = e.join(shuffled(low), [*TARGET, "hi"]).select(*TARGET, F.col("lo").alias("hi"), F.col("m").alias("lo"))
        return ordered(moved.union(low.select(*TARGET, "hi", F.col("m").alias("lo"))))

    def state(e: DataFrame):
        digest = F.sum(F.xxhash64(*TARGET, "hi", "lo").cast("decimal(38,0)"))
        return e.agg(F.count(F.lit(1)), digest).first()  # two numbers

    edges = cut_lineage(ordered(edges))
    before = state(edges)
    while before[0]:
        read, edges = edges, cut_lineage(small_star(large_star(edges)))
        after = state(edges)
        drop_stage(read)  # the new generation is stored and no longer needs it
        if after == before:
            break
        before = after
    return edges


def component_runs(voxels: DataFrame, dim: int = 3, diagonal: bool = False, block: int = BLOCK) -> DataFrame:
    """Labelled runs ``(case_id, mask_id, z, y, x0, x1, label)``.

    ``dim=2`` labels every slice on its own (``diagonal`` switches from 4- to
    8-connectivity); ``dim=3`` uses the six face neighbours.
    """
    runs = voxel_runs(voxels)
    if dim == 2:
        return _label_in_blocks(runs, 1, diagonal)
    local = cut_lineage(_label_in_blocks(runs, block, False))
    upper = local.where(F.col("z") % block == block - 1).select(
        *TARGET, (F.col("z") + 1).alias("z"), "y", F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("label").alias("lo")
    )
    lower = local.where(F.col("z") % block == 0).withColumnRenamed("label", "hi")
    touch = lower.join(shuffled(upper), [*TARGET, "z", "y"]).where(
        (F.col("x0") <= F.col("b")) & (F.col("a") <= F.col("x1"))
    )
    roots = _star_roots(touch.select(*TARGET, "hi", "lo"))
    return (
        local.join(shuffled(roots.withColumnRenamed("hi", "label")), [*TARGET, "label"], "left")
        .withColumn("label", F.coalesce("lo", "label"))
        .select(*SLICE, "y", "x0", "x1", "label")
    )


def explode_runs(runs: DataFrame) -> DataFrame:
    return runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def components(voxels: DataFrame, dim: int = 3, diagonal: bool = False, block: int = BLOCK) -> DataFrame:
    """Voxels with the label of their component."""
    return explode_runs(component_runs(voxels, dim, diagonal, block)).select(*VOXEL, "label")


def _scope(dim: int) -> list[str]:
    return SLICE if dim == 2 else TARGET


def _length() -> Column:
    return F.col("x1") - F.col("x0") + 1


def component_sizes(runs: DataFrame, dim: int = 3) -> DataFrame:
    return runs.groupBy(*_scope(dim), "label").agg(F.sum(_length()).alias("size"))


def component_count(voxels: DataFrame, dim: int = 3) -> DataFrame:
    """Number of components per target (or per slice)."""
    sizes = component_sizes(component_runs(voxels, dim), dim)
    return sizes.groupBy(*_scope(dim)).agg(F.count(F.lit(1)).alias("component_count"))


def _keep(runs: DataFrame, chosen: DataFrame, dim: int) -> DataFrame:
    keys = [*_scope(dim), "label"]
    return explode_runs(runs.join(shuffled(chosen.select(*keys)), keys, "left_semi")).select(*VOXEL)


def largest_cc(voxels: DataFrame, dim: int = 3, diagonal: bool = False) -> DataFrame:
    """Biggest component per volume or slice; the earliest one wins a tie."""
    runs = component_runs(voxels, dim, diagonal)
    best = (
        component_sizes(runs, dim)
        .groupBy(*_scope(dim))
        .agg(F.max_by("label", F.struct(F.col("size"), -F.col("label"))).alias("label"))
    )
    return _keep(runs, best, dim)


def top_components(voxels: DataFrame, n: int = 2, dim: int = 3) -> DataFrame:
    """Voxels of the ``n`` biggest components with their size rank."""
    runs = component_runs(voxels, dim)
    w = Window.partitionBy(*_scope(dim)).orderBy(F.col("size").desc(), F.col("label"))
    ranked = component_sizes(runs, dim).withColumn("cc_rank", F.row_number().over(w)).where(F.col("cc_rank") <= n)
    return explode_runs(runs.join(ranked, [*_scope(dim), "label"])).select(*VOXEL, "label", "cc_rank", "size")


def min_size_filter(voxels: DataFrame, min_size: int = 5) -> DataFrame:
    runs = component_runs(voxels)
    return _keep(runs, component_sizes(runs).where(F.col("size") >= min_size), 3)


def _nearest(runs: DataFrame, priors: DataFrame, d: int, h: int, w: int) -> DataFrame:
    length = _length()
    centre = runs.groupBy(*TARGET, "label").agg(
        (F.sum(F.col("z") * length) / F.sum(length)).alias("cz"),
        (F.sum(F.col("y") * length) / F.sum(length)).alias("cy"),
        (F.sum((F.col("x0") + F.col("x1")) * length) / F.lit(2.0) / F.sum(length)).alias("cx"),
    )

    def gap(axis: str, n: int) -> Column:
        mid = (F.col(f"{axis}_min") + F.col(f"{axis}_max")) / F.lit(2.0) * F.lit(n)
        return (F.col(f"c{axis}") - mid) * (F.col(f"c{axis}") - mid)

    dist = F.sqrt(gap("z", d) + gap("y", h) + gap("x", w))
    return (
        centre.join(shuffled(priors), TARGET)
        .groupBy(*TARGET)
        .agg(F.min_by("label", F.struct(dist.alias("d"), F.col("label").alias("l"))).alias("label"))
    )


def nearest_component(voxels: DataFrame, priors: DataFrame, d: int, h: int, w: int) -> DataFrame:
    """Component whose centroid is nearest the centre of the normalised prior."""
    runs = component_runs(voxels)
    return _keep(runs, _nearest(runs, priors, d, h, w), 3)


def postprocess_route(
    voxels: DataFrame, rules: DataFrame, priors: DataFrame, d: int, h: int, w: int, min_size: int = 5
) -> DataFrame:
    """Clean every target by its rule: nearest component, or drop tiny ones.

    ``rules`` is (case_id, mask_id, post_rule).  Labelled runs are stored once
    and read by every branch.
    """
    runs = cut_lineage(component_runs(voxels).join(shuffled(rules.select(*TARGET, "post_rule")), TARGET))
    near = runs.where(F.col("post_rule") == "keep_nearest")
    many = runs.where(F.col("post_rule").isin("keep_multi", "organ_roi"))
    rest = runs.where(~F.col("post_rule").isin("keep_nearest", "keep_multi", "organ_roi"))
    return (
        _keep(near, _nearest(near, priors, d, h, w), 3)
        .unionByName(_keep(many, component_sizes(many).where(F.col("size") >= min_size), 3))
        .unionByName(explode_runs(rest).select(*VOXEL))
    )


def pseudo_boxes(
    pred: DataFrame, targets: DataFrame, d: int, h: int, w: int, margin: int = 5, largest: bool = True
) -> DataFrame:
    """One row per slice of every target; NULL coordinates where nothing is predicted."""
    kept = largest_cc(pred, dim=2) if largest else pred
    boxes = bbox2d_fixed(kept, h, w, margin)
    grid = targets.select(*TARGET).distinct().withColumn(
        "z", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(d - 1).cast("bigint")))
    )
    return grid.join(boxes, SLICE, "left")


def saliency_bbox(binary: DataFrame, h: int, w: int) -> DataFrame:
    """Box of the largest 8-connected blob per slice, far side exclusive.

    The blob is chosen by pixel count.
    """
    blob = largest_cc(binary, dim=2, diagonal=True)
    return blob.groupBy(*SLICE).agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"),
        (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"),
    )
