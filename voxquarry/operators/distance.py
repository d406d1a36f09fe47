"""City-block distance of mask voxels to the outside of their slice's mask.

Distances along the image row come from runs; a sweep down and one up the
columns carry ``distance + 1`` from voxel to voxel.  A voxel survives ``k``
erosions with the cross exactly if its distance is above ``k``, so any number
of erosions is one filter on a map made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread_rows
from .voxels import SLICE, VOXEL

TILE = 256  # side of a tile when distances are limited


def _tiles(at: str, limit: int, tile: int) -> Column:
    """Numbers of the tiles that see a coordinate, in their own part or in the halo of ``limit``."""
    return F.array_distinct(F.array(*[F.floor((F.col(at) + d) / tile).cast("bigint") for d in (-limit, 0, limit)]))


def distance_map(mask: DataFrame, limit: int | None = None, tile: int = TILE) -> DataFrame:
    """``case_id, mask_id, z, y, x, distance``: steps to the nearest voxel outside, all around the mask.

    Without a ``limit`` a slice of a mask is one piece.  With one, distances
    above it stand as ``limit + 1`` and slices are cut into tiles with a halo
    of ``limit`` voxels, so no piece depends on the size of the frame.  Either
    way rows are shuffled once, into tasks of bounded size (the mask is counted
    first: pass a stored one).  Repeated voxels count once.
    """
    piece = SLICE if limit is None else [*SLICE, "_ty", "_tx"]
    df = mask.select(*VOXEL)
    if limit is not None:
        if not 0 < limit <= tile:
            raise ValueError("the limit is between 1 and the side of a tile")
        df = df.withColumn("_ty", F.explode(_tiles("y", limit, tile))).withColumn("_tx", F.explode(_tiles("x", limit, tile)))
    copies = 1 if limit is None else (1 + 2 * limit / tile) ** 2  # of a voxel, in the halos of tiles
    df = spread_rows(df, int(mask.count() * copies), *piece).dropDuplicates([*piece, "y", "x"])

    def sweep(df: DataFrame, line: str, along: str, near: Column, out: str) -> DataFrame:
        """``out``: the least of ``near + steps`` over a line's stretch of voxels, one step beyond its ends being outside."""
        order = Window.partitionBy(*piece, line).orderBy(along)
        df = df.withColumn("_stretch", F.col(along) - F.row_number().over(order))
        down = Window.partitionBy(*piece, line, "_stretch").orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        up = Window.partitionBy(*piece, line, "_stretch").orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, 0)
        before = F.least(F.min(near - F.col(along)).over(down), 1 - F.min(along).over(down)) + F.col(along)
        after = F.least(F.min(near + F.col(along)).over(up), F.max(along).over(up) + 1) - F.col(along)
        return df.withColumn(out, F.least(before, after))

    far = F.lit(1 << 40)  # nothing is known of other lines yet
    df = sweep(df, "y", "x", far, "_h")
    df = sweep(df, "x", "y", F.col("_h"), "distance")
    if limit is not None:
        own = (F.col("_ty") == F.floor(F.col("y") / tile)) & (F.col("_tx") == F.floor(F.col("x") / tile))
        df = df.where(own).withColumn("distance", F.least("distance", F.lit(limit + 1)))
    return df.select(*VOXEL, F.col("distance").cast("bigint").alias("distance"))


def erode_by(distances: DataFrame, iterations: int) -> DataFrame:
    """Voxels that survive ``iterations`` erosions, from a distance map (made with at least that limit)."""
    return distances.where(F.col("distance") > iterations).select(*VOXEL)
