"""Hard negatives of anchor vectors, found with bounds along a spanning tree of the anchors.

Anchors of a block form a minimum spanning tree.  For a row ``x`` and an edge
from anchor ``p`` to anchor ``c``, the scores differ by at most
``|c - p| * |x|``, so an interval known at the parent, widened by edge length
times the row's norm, holds the score at the child.  Only rows whose interval
can still matter (reach the top positives, or overlap a window of wanted
negatives) are scored again, exactly; the others pass their interval on.

Anchors are a query set and meet all rows in blocks: a task holds one block
of each.  Positives come first, since they set the windows of the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

ROWS = 4096  # rows of a block
ANCHORS = 1024  # anchors of a block: at most so many intervals of a row are held at once
SAFE = 2**53  # sums of whole numbers below it are exact in doubles
SLOPE = 1 + 1e-9  # bounds are widened by more than doubles can be off
TREE = "block int, anchor bigint, label int, v array<bigint>, place int, parent int, edge double"


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as whole numbers, shorter ones continued by zeros."""
    lists = column.combine_chunks()
    lens = np.diff(np.asarray(lists.offsets))
    values = np.asarray(lists.flatten())
    out = np.zeros((len(lens), width), np.int64)
    out[np.arange(width) < lens[:, None]] = values
    return out


def widest(*columns: pa.ChunkedArray) -> int:
    return max((int(np.diff(np.asarray(c.combine_chunks().offsets)).max(initial=0)) for c in columns), default=0)


class Scorer:
    """Exact inner products of the rows with an anchor; doubles where they are exact, else Python's numbers."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        top = [int(np.abs(m.astype(object)).max(initial=0)) if m.size else 0 for m in (rows, anchors)]
        self.exact = top[0] * top[1] * max(1, rows.shape[1]) < SAFE and max(top) < SAFE
        self.rows = rows.astype(np.float64 if self.exact else object)
        self.anchors = anchors.astype(np.float64 if self.exact else object)
        self.norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1)) * SLOPE

    def score(self, anchor: int, at: np.ndarray | None = None) -> np.ndarray:
        rows = self.rows if at is None else self.rows[at]
        s = rows @ self.anchors[anchor]
        return s if self.exact else np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in s], np.int64)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, parent, edge)``: a minimum spanning tree walked from its root, parents as places in the order."""
    n = len(points)
    f = points.astype(np.float64)
    sq = (f * f).sum(axis=1)
    best, link, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    children: list[list[int]] = [[] for _ in range(n)]
    now = 0
    for _ in range(n):
        left[now] = False
        if link[now] >= 0:
            children[link[now]].append(now)
        d = np.maximum(sq + sq[now] - 2 * (f @ f[now]), 0)
        near = left & (d < best)
        best[near], link[near] = d[near], now
        now = int(np.where(left, best, np.inf).argmin()) if left.any() else -1
        if now >= 0 and not left[now]:  # distances beyond doubles: any anchor that is left
            now = int(left.argmax())
            link[now] = max(link[now], 0)
    order, parent, stack = [], [], [(0, -1)]
    while stack:
        i, p = stack.pop()
        stack += [(c, len(order)) for c in children[i]]
        order.append(i)
        parent.append(p)
    order, parent = np.array(order), np.array(parent)
    diff = f[order] - f[order[np.maximum(parent, 0)]]
    return order, parent, np.sqrt((diff * diff).sum(axis=1)) * SLOPE


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = at[scores >= np.partition(scores, -k)[-k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def reaching(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """Those of ``at`` that can be among the ``k`` highest, given that rows ``sure`` count."""
    if len(sure) < k or not len(at):
        return at
    return at[hi[at] >= np.partition(lo[sure], -k)[-k]]


def walk(scorer: Scorer, parent: np.ndarray, edge: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor in order ``(anchor, rows, exact scores)`` of the rows that ``wanted(anchor, lo, hi)`` asks for."""
    n = len(scorer.norms)
    waiting = np.bincount(parent[parent >= 0], minlength=len(parent))
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for c, p in enumerate(parent.tolist()):
        if p < 0 or not scorer.exact:
            lo = hi = scorer.score(c)
            at = wanted(c, lo, hi)
            yield c, at, lo[at]
        else:
            low, high = held[p]
            reach = edge[c] * scorer.norms + 1e-6
            lo, hi = low - reach, high + reach
            at = wanted(c, lo, hi)
            s = scorer.score(c, at) if 3 * len(at) < n else scorer.score(c)[at]
            lo[at] = hi[at] = s
            yield c, at, s
        if p >= 0:
            waiting[p] -= 1
            if not waiting[p]:
                held.pop(p, None)
        if waiting[c] and scorer.exact:
            held[c] = (lo, hi)


def _cell(rows: pa.Table, anchors: pa.Table) -> tuple:
    anchors = anchors.sort_by("place")
    width = widest(rows.column("v"), anchors.column("v"))
    scorer = Scorer(matrix(rows.column("v"), width), matrix(anchors.column("v"), width))
    columns = [np.asarray(t.column(c)) for t, c in ((rows, "id"), (rows, "label"), (anchors, "anchor"), (anchors, "label"), (anchors, "parent"), (anchors, "edge"))]
    return scorer, *columns


def block_positives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """``anchor, id, score``: the best rows of each anchor's label in one block of rows."""
    out: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        scorer, ids, labels, own, own_label, parent, edge = _cell(rows, anchors)
        same = {x: np.flatnonzero(labels == x) for x in np.unique(own_label).tolist()}

        def wanted(c: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            at = same[int(own_label[c])]
            at = at[ids[at] != own[c]]
            return reaching(lo, hi, at, at, k)

        for c, at, s in walk(scorer, parent, edge, wanted):
            best = first(s, ids[at], k)
            out.append((np.full(len(best), own[c]), ids[at[best]], s[best].astype(np.int64)))
    a, i, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"anchor": pa.array(a, pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})


def block_negatives(rows: pa.Table, anchors: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """``anchor, positive, positive_score, id, score``: the best rows inside each window, in one block of rows."""
    out: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        anchors = anchors.sort_by("place")
        windows = [
            [(p["id"], p["score"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in found or []]
            for found in anchors.column("positives").to_pylist()
        ]
        scorer, ids, labels, own, own_label, parent, edge = _cell(rows, anchors)

        def wanted(c: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            other = labels != own_label[c]
            need = np.zeros(len(ids), bool)
            for _, _, a, b in windows[c]:
                touch = np.flatnonzero(other & (hi >= a) & (lo <= b))
                inside = touch[(lo[touch] >= a) & (hi[touch] <= b)]
                need[reaching(lo, hi, touch, inside, k)] = True
            return np.flatnonzero(need)

        for c, at, s in walk(scorer, parent, edge, wanted):
            for positive, score, a, b in windows[c]:
                inside = at[(s >= a) & (s <= b)]
                value = s[(s >= a) & (s <= b)]
                best = first(value, ids[inside], k)
                n = len(best)
                out.append((np.full(n, own[c]), np.full(n, positive), np.full(n, score), ids[inside[best]], value[best].astype(np.int64)))
    cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
    return pa.table([pa.array(x, pa.int64()) for x in cols], names=["anchor", "positive", "positive_score", "id", "score"])


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | Column = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``; scores are whole inner products,
    higher first, ties by smaller id.  An anchor's positives are its first
    ``positives`` other rows of its label; for each, the first ``negatives``
    rows of another label with ``low * positive_score <= 100 * score <= high *
    positive_score`` are returned.

    Rows with a null id, label or vector, or a null or non-finite component,
    take no part.  Of rows that repeat an id, the one with the smallest label,
    then vector, counts.  Vectors of different lengths: the shorter one goes
    on with zeros; empty ones score 0.  Components and scores beyond 64 bits
    stand at their limit.  A negative positive score has an empty window.
    Other columns are ignored.  No rows or no anchors: no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.col(f"`{vec_col}`")
    label = label_col if isinstance(label_col, Column) else F.col(f"`{label_col}`")
    usable = F.col(f"`{id_col}`").isNotNull() & label.isNotNull() & v.isNotNull()
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(usable & ~odd).select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        label.cast("int").alias("label"),
        F.transform(v, lambda x: F.floor(scale * x.cast("double"))).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    # a repeated id is reduced before and after the shuffle, so a frequent one is no hot key
    rows = cut_lineage(rows.groupBy("id").agg(F.min(F.struct("label", "v", "is_anchor")).alias("r")).select("id", "r.*"))
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("is_anchor"), 1)).alias("a")).first()
    row_blocks, anchor_blocks = max(1, -(-sizes.n // ROWS)), max(1, -(-sizes.a // ANCHORS))

    def plant(table: pa.Table) -> pa.Table:
        table = table.sort_by("anchor")
        order, parent, edge = spanning_tree(matrix(table.column("v"), widest(table.column("v"))))
        table = table.take(pa.array(order))
        for name, x in (("place", np.arange(len(order), dtype=np.int32)), ("parent", parent.astype(np.int32)), ("edge", edge)):
            table = table.append_column(name, pa.array(x))
        return table

    anchors = rows.where("is_anchor").select(
        F.pmod(F.xxhash64("id"), F.lit(anchor_blocks)).cast("int").alias("block"), F.col("id").alias("anchor"), "label", "v"
    )
    trees = cut_lineage(anchors.groupBy("block").applyInArrow(plant, TREE))
    blocks = F.sequence(F.lit(0), F.lit(anchor_blocks - 1))
    cells = rows.select(
        F.explode(blocks).alias("block"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(row_blocks)).cast("int").alias("part"), "id", "label", "v"
    ).groupBy("block", "part")
    parts = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("part")

    found = cells.cogroup(trees.select("*", parts).groupBy("block", "part")).applyInArrow(
        lambda r, a: block_positives(r, a, positives), "anchor bigint, id bigint, score bigint"
    )
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives)
    # at most `positives` entries a list
    mine = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("positives"))
    asked = cut_lineage(trees.join(mine, "anchor", "left").select(*trees.columns, "positives"))

    taken = cells.cogroup(asked.select("*", parts).groupBy("block", "part")).applyInArrow(
        lambda r, a: block_negatives(r, a, negatives, low, high),
        "anchor bigint, positive bigint, positive_score bigint, id bigint, score bigint",
    )
    best = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id")
    taken = taken.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return taken.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
