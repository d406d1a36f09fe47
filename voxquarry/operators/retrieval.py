"""Spatial priors from similar findings of other cases.

Both retrievals exclude the query's own case.  They work on distinct texts or
packets first, and keep for each of them at most ``k`` bank rows per case and
``2k`` rows in all: removing one case takes away at most k of those, so the
best k of any query are among the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm, value_range
from ..session import cut_lineage, shuffled
from .voxels import TARGET

EXTENT = ["z_min", "z_max", "y_min", "x_min", "y_max", "x_max"]
BANK_ORDER = ["case_id", "pos"]
SLOTS = ["anatomy", "side", "finding_type", "target_form", "level", "count"]


def prompt_bank(targets: DataFrame, voxels: DataFrame, d: int, h: int, w: int, normalized: bool = True) -> DataFrame:
    """Targets with the inclusive extent of their mask; -1 where it is empty."""
    size = {"z": d, "y": h, "x": w} if normalized else {"z": 1, "y": 1, "x": 1}
    aggs = [F.count(F.lit(1)).alias("gt_voxels")]
    for e in EXTENT:
        fn = F.min if e.endswith("min") else F.max
        aggs.append((fn(e[0]).cast("double") / F.lit(float(size[e[0]]))).alias(e))
    extent = voxels.groupBy(*TARGET).agg(*aggs)
    return targets.join(shuffled(extent), TARGET, "left").withColumns(
        {
            "gt_voxels": F.coalesce("gt_voxels", F.lit(0).cast("bigint")),
            **{e: F.coalesce(e, F.lit(-1.0)) for e in EXTENT},
        }
    )


def leave_one_out_shortlist(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Rows that can be among the best k of a key once any single case is removed."""
    per_case = Window.partitionBy(*keys, "case_id").orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_r", F.row_number().over(per_case))
        .where(F.col("_r") <= k)
        .withColumn("_r", F.row_number().over(overall))
        .where(F.col("_r") <= 2 * k)
        .drop("_r")
    )


def _bank_order() -> list[Column]:
    return [F.col(c) for c in BANK_ORDER]


def _candidates(bank: DataFrame) -> DataFrame:
    return bank.where(F.col("gt_voxels") > 0)


def _pick(queries: DataFrame, shortlist: DataFrame, keys: list[str], k: int) -> DataFrame:
    """First k shortlisted rows of another case for every query target."""
    hits = queries.join(
        shuffled(shortlist.withColumnsRenamed({"case_id": "m_case_id", "mask_id": "m_mask_id", "pos": "m_pos"})), keys
    ).where(F.col("case_id") != F.col("m_case_id"))
    w = Window.partitionBy(*TARGET).orderBy(F.col("score").desc(), "m_case_id", "m_pos")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def slot_similarity(prefix_a: str = "", prefix_b: str = "m_") -> Column:
    """Score of two packets whose slots are columns with the two prefixes."""

    def same(slot: str) -> Column:
        return F.col(prefix_a + slot) == F.col(prefix_b + slot)

    known = (F.col(prefix_a + "side") != "none") & (F.col(prefix_b + "side") != "none")
    return (
        F.when(same("anatomy"), 4.0).otherwise(0.0)
        + F.when(same("side"), 2.0).when(known, -1.0).otherwise(0.0)
        + F.when(same("finding_type"), 2.0).otherwise(0.0)
        + F.when(same("target_form"), 1.0).otherwise(0.0)
        + F.when(same("level") & (F.col(prefix_a + "level") != ""), 2.0).otherwise(0.0)
        + F.when(same("count"), 0.5).otherwise(0.0)
    )


_FREE_SLOTS = ["anatomy", "finding_type", "target_form", "level", "count"]


def _with_patterns(packets: DataFrame, is_query: bool) -> DataFrame:
    """One row per slot pattern of a packet; ``key`` is the equi-join key.

    A pattern fixes a subset of the slots; the side is fixed to a value or left
    open.  A query also probes side 'none', which costs it no penalty.
    """
    sides = [F.col("side"), F.lit("any")]
    if is_query:
        sides.append(F.when(F.col("side") != "none", F.lit("none")))
    fixed = {s: F.col("_bits").bitwiseAND(1 << i) != 0 for i, s in enumerate(_FREE_SLOTS)}
    rows = packets.withColumn("_bits", F.explode(F.sequence(F.lit(0), F.lit((1 << len(_FREE_SLOTS)) - 1)))).where(
        ~fixed["level"] | (F.col("level") != "")  # an unknown level matches nothing
    )
    rows = rows.withColumn("_side", F.explode(F.array_compact(F.array(*sides))))
    slots = [F.when(on, F.col(s)).otherwise(F.lit("")) for s, on in fixed.items()]
    key = F.concat_ws("|", F.col("_bits").cast("string"), F.col("_side"), *slots)
    return rows.withColumn("key", key).drop("_bits", "_side")


def slot_topk(queries: DataFrame, bank: DataFrame, k: int = 5) -> DataFrame:
    """Best k bank rows of other cases by slot similarity, positive scores only.

    Instead of scoring all packet pairs, bank packets are indexed by every
    subset of slots they could match.  A row that is missing from the shortlist
    of its exact match pattern is preceded there by enough rows that match at
    least as much, so equi-joins on patterns find the true top k.
    """
    cand = _candidates(bank).select(*BANK_ORDER, "mask_id", *EXTENT, *SLOTS)
    # One level: rows of equal packets compete by bank order only.
    cand = cut_lineage(leave_one_out_shortlist(cand, SLOTS, _bank_order(), k))
    index = _with_patterns(cand, False)
    index = leave_one_out_shortlist(index, ["key"], _bank_order(), k).withColumnsRenamed(
        {s: f"m_{s}" for s in SLOTS}
    )
    packets = cut_lineage(queries.select(*SLOTS).distinct())
    found = (
        _with_patterns(packets, True)
        .join(index, "key")
        .drop("key")
        .dropDuplicates([*SLOTS, "case_id", "mask_id"])
        .withColumn("score", slot_similarity())
    )
    best = leave_one_out_shortlist(found, SLOTS, [F.col("score").desc(), *_bank_order()], k)
    best = best.drop(*[f"m_{s}" for s in SLOTS])
    return _pick(queries, best, SLOTS, k).where(F.col("score") > 0)


def weighted_prior(topk: DataFrame, score: str = "score") -> DataFrame:
    """Score-weighted mean extent per query; NULL when all weights are 0."""
    total = F.nullif(F.sum(score), F.lit(0.0))
    return topk.groupBy(*TARGET).agg(
        *[(F.sum(F.col(score) * F.col(e)) / total).alias(e) for e in EXTENT],
        F.avg(score).alias("score"),
        F.count(F.lit(1)).alias("matches"),
    )


def prior_blend(packets: DataFrame, prior: DataFrame, min_score: float = 3.0) -> DataFrame:
    """Mix the atlas range with the retrieved one, trusting high scores more.

    ``packets`` carries ``atlas_*`` columns, ``prior`` the output of
    ``weighted_prior``; weak or missing priors leave the atlas unchanged.
    """
    p = prior.select(*TARGET, "score", *[F.col(e).alias(f"r_{e}") for e in EXTENT])
    alpha = F.least(F.lit(0.9), F.greatest(F.lit(0.3), F.col("score") / F.lit(10.0)))
    usable = F.col("score").isNotNull() & (F.col("score") >= min_score) & F.col("r_z_min").isNotNull()
    return packets.join(shuffled(p), TARGET, "left").withColumns(
        {
            e: F.when(
                usable, alpha * F.col(f"r_{e}") + (F.lit(1.0) - alpha) * F.col(f"atlas_{e}")
            ).otherwise(F.col(f"atlas_{e}"))
            for e in EXTENT
        }
    ).drop(*[f"r_{e}" for e in EXTENT])


def cosine_topk(
    slices: DataFrame, texts: DataFrame, k: int = 10, min_sim: float = -0.5, constant_eps: float = 1e-8, z_block: int = 64
) -> DataFrame:
    """Slices of a case ranked by cosine similarity with each text of that case.

    Constant slices score -1; rows at or below ``min_sim`` go after the cut to k.
    Flags and norms are made before the join, so pixels stay out of it; a case
    is split by blocks of slices, to each of which its few texts go.
    """
    left = slices.select(
        "case_id", "z", F.floor(F.col("z") / z_block).alias("_block"),
        (value_range(F.col("px")) < constant_eps).alias("_flat"),
        F.col("embedding").alias("slice_vec"), norm(F.col("embedding")).alias("_slice_norm"),
    )
    right = texts.select(*TARGET, F.col("embedding").alias("text_vec"), norm(F.col("embedding")).alias("_text_norm"))
    blocks = slices.select("case_id", F.floor(F.col("z") / z_block).alias("_block")).distinct()
    pairs = left.join(right.join(blocks, "case_id"), ["case_id", "_block"])
    sim = F.when(F.col("_flat"), F.lit(-1.0)).otherwise(
        F.try_divide(dot(F.col("slice_vec"), F.col("text_vec")), F.col("_slice_norm") * F.col("_text_norm"))
    )
    scored = pairs.select(*TARGET, "z", sim.alias("sim"))
    w = Window.partitionBy(*TARGET).orderBy(F.col("sim").desc(), "z")
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .where(F.col("sim") > min_sim)
    )


def size_clamp(sweep: DataFrame, prior_size: DataFrame) -> DataFrame:
    """Threshold whose predicted volume is closest to the retrieved volume."""
    return (
        sweep.join(prior_size, TARGET)
        .groupBy(*TARGET)
        .agg(
            F.min_by(
                F.struct("threshold", "voxels"),
                F.struct(F.abs(F.col("voxels") - F.col("prior_voxels")), F.col("threshold")),
            ).alias("b")
        )
        .select(*TARGET, F.col("b.threshold").alias("threshold"), F.col("b.voxels").alias("voxels"))
    )
