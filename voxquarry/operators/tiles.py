"""Connected components in tiles along all three axes.

``components.component_runs`` labels whole slices, so its blocks grow with the
frame.  Here runs end at the sides of tiles too: a tile of ``(tz, ty, tx)``
voxels holds at most ``tz * ty * ceil(tx / 2)`` runs, whatever the frame.  Parts
that touch across the faces of tiles (and across edges, for 8 neighbours) are
joined by contraction.  Labels are the same for every tiling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import _star_roots, explode_runs, label_parts
from .voxels import SLICE, TARGET, VOXEL

TILE = (16, 256, 256)


def _number(at: str, side: int) -> Column:
    return F.floor(F.col(at) / side).cast("bigint")


def tile_runs(voxels: DataFrame, tx: int) -> DataFrame:
    """Runs that end at multiples of ``tx``: ``(case_id, mask_id, z, y, _tx, x0, x1)``; repeated voxels count once."""
    row = Window.partitionBy(*SLICE, "y", "_tx").orderBy("x")
    marked = voxels.select(*VOXEL, _number("x", tx).alias("_tx")).withColumn("_island", F.col("x") - F.dense_rank().over(row))
    return marked.groupBy(*SLICE, "y", "_tx", "_island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_island")


def _placed(runs: DataFrame, tile: tuple[int, int, int]) -> DataFrame:
    return runs.withColumns({"_tz": _number("z", tile[0]), "_ty": _number("y", tile[1])})


def gathered(runs: DataFrame, tile: tuple[int, int, int]) -> DataFrame:
    """One row a tile with its runs in an array; for tests."""
    entry = F.struct(*[F.col(c).cast("bigint").alias(n) for c, n in (("z", "z"), ("y", "y"), ("x0", "a"), ("x1", "b"))])
    return _placed(runs, tile).groupBy(*TARGET, "_tz", "_ty", "_tx").agg(F.collect_list(entry).alias("runs"))


def _faces(local: DataFrame, tile: tuple[int, int, int], dim: int, diagonal: bool) -> DataFrame:
    """Pairs of labels that touch across sides of tiles."""
    tz, ty, tx = tile

    def other(moved: dict[str, Column], where: Column) -> DataFrame:
        cols = {c: F.col(c) for c in (*SLICE, "y", "_tx")} | moved
        return local.where(where).select(*[v.alias(k) for k, v in cols.items()], F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("label").alias("other"))

    reach = 1 if diagonal else 0
    row = [*SLICE, "y", "_tx"]
    found = []

    def meet(here: Column, there: DataFrame, reach: int) -> None:
        touch = (F.col("x0") <= F.col("b") + reach) & (F.col("a") <= F.col("x1") + reach)
        found.append(local.where(here).join(there, row).where(touch).select(*TARGET, "label", "other"))

    if dim == 3:
        meet(F.col("z") % tz == 0, other({"z": F.col("z") + 1}, F.col("z") % tz == tz - 1), 0)
    meet(F.col("y") % ty == 0, other({"y": F.col("y") + 1}, F.col("y") % ty == ty - 1), reach)
    # runs that end at a side meet those that begin behind it, for 8 neighbours in the rows above and below too
    ends = local.where(F.col("x1") % tx == tx - 1)
    rows = F.explode(F.array(*[F.col("y") + d for d in ((-1, 0, 1) if diagonal else (0,))]))
    ends = ends.select(*SLICE, rows.alias("y"), (F.col("x1") + 1).alias("x0"), F.col("label").alias("other"))
    found.append(local.where(F.col("x0") % tx == 0).join(ends, [*SLICE, "y", "x0"]).select(*TARGET, "label", "other"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.select(*TARGET, F.greatest("label", "other").alias("hi"), F.least("label", "other").alias("lo"))


def tiled_component_runs(voxels: DataFrame, dim: int = 3, diagonal: bool = False, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """Labelled runs ``(case_id, mask_id, z, y, x0, x1, label)``, cut at the sides of tiles.

    ``dim=2`` labels every slice on its own (``diagonal``: 8 neighbours), ``dim=3``
    takes the six face neighbours.  A component is named by its first voxel.
    """
    if dim == 3 and diagonal:
        raise ValueError("diagonal neighbours are for slices")
    tile = (1, *tile[1:]) if dim == 2 else tile
    placed = _placed(tile_runs(voxels, tile[2]), tile)
    labelled = label_parts(placed, [*TARGET, "_tz", "_ty", "_tx"], diagonal)
    local = cut_lineage(labelled.select(*SLICE, "y", "_tx", "x0", "x1", "label"))
    roots = _star_roots(_faces(local, tile, dim, diagonal))
    return (
        local.join(roots.withColumnRenamed("hi", "label"), [*TARGET, "label"], "left")
        .withColumn("label", F.coalesce("lo", "label"))
        .select(*SLICE, "y", "x0", "x1", "label")
    )


def tiled_components(voxels: DataFrame, dim: int = 3, diagonal: bool = False, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """Voxels with the label of their component."""
    return explode_runs(tiled_component_runs(voxels, dim, diagonal, tile)).select(*VOXEL, "label")
