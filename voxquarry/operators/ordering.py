"""Global order without a single-task sort: ranks, running sums, exact quantiles.

An unpartitioned window pulls every row into one task.  Here rows are first
cut into order-preserving buckets, each bucket is windowed on its own, and the
bucket totals (at most ``buckets`` rows) give every bucket its start offset.
Split points come from the rows with the smallest key hash, which is a uniform
sample of distinct keys: deterministic, so a retried task sees the same cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PER_TASK = 4  # buckets per shuffle partition, so that uneven ones share tasks


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a keyless order: they grow with the parallelism that the session asks for."""
    return PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where NULL equals NULL."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, cond, how).drop(*[f"_r_{k}" for k in keys])


def order_bucket(df: DataFrame, order_cols: list[str], buckets: int | None = None) -> DataFrame:
    """Append ``_bucket``, non-decreasing in the order of ``order_cols``.

    Eight keys are sampled per bucket and every eighth is a cut, so buckets come
    out even; a row finds its bucket by halving the sorted cuts.
    """
    key = F.struct(*order_cols)
    buckets = buckets or bucket_count(df.sparkSession)
    sample = (
        df.select(key.alias("k"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(8 * buckets)
        .agg(F.sort_array(F.collect_set("k")).alias("all"))
        .select(F.filter("all", lambda k, i: i % 8 == 7).alias("cuts"))
    )
    return (
        df.withColumn("_cuts", sample.scalar())
        .withColumn("_bucket", _cuts_below(F.col("_cuts"), key, buckets))
        .drop("_cuts")
    )


def _cuts_below(cuts: Column, key: Column, most: int) -> Column:
    """Number of sorted ``cuts`` (at most ``most``) that are not above ``key``, by halving."""
    step = 1 << max(0, most.bit_length() - 1)
    steps = []
    while step:
        steps.append(step)
        step //= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(F.coalesce(F.get(cuts, at + s - 1) <= key, F.lit(False)), at + s).otherwise(at),
    )


_MERGE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def running(
    df: DataFrame,
    keys: list[str],
    order_cols: list[str],
    values: dict[str, tuple[str, Column]],
    *,
    exclusive: bool = False,
    bucket: Column | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Append running sums or maxima per key, in the order of ``order_cols``.

    ``values`` maps a new column to ("sum" | "max", input); ``exclusive`` leaves
    the row itself out.  Keys with order columns identify a row; NULL is a
    key like any other.  A key of any size is spread over its buckets.

    The input is read three times (cuts, totals, rows): pass a stored table, or
    cut the lineage of an expensive one first.  Pass ``bucket`` when the order
    already offers an order-preserving prefix.
    """
    base = order_bucket(df, [*keys, *order_cols], buckets) if bucket is None else df.withColumn("_bucket", bucket)
    base = base.withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    at = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy(*at).agg(*[_MERGE[f][0](f"_v_{n}").alias(f"_t_{n}") for n, (f, _) in values.items()])
    offsets = totals.select(*at, *[_MERGE[f][0](f"_t_{n}").over(before).alias(f"_o_{n}") for n, (f, _) in values.items()])
    upto = Window.partitionBy(*at).orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0
    )
    out = join_on(base, offsets, at).withColumns(
        {n: _MERGE[f][1](F.col(f"_o_{n}"), _MERGE[f][0](f"_v_{n}").over(upto)) for n, (f, _) in values.items()}
    )
    return out.drop("_bucket", *[p + n for n in values for p in ("_v_", "_o_")])


def rank_within(df: DataFrame, keys: list[str], order_cols: list[str], out: str = "rank", **kw) -> DataFrame:
    """Append the 1-based position inside the key; for cuts that no small constant bounds."""
    return running(df, keys, order_cols, {out: ("sum", F.lit(1).cast("bigint"))}, **kw)


def global_rank(df: DataFrame, order_cols: list[str], out: str = "rank", **kw) -> DataFrame:
    """Append the 1-based position in the order of ``order_cols`` (a unique key)."""
    return rank_within(df, [], order_cols, out, **kw)


def value_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with their counts, stored once: ``(*keys, value, count)``.

    A value shared by a third of all rows becomes one row, and everything that
    summarises the distribution reads this table instead of the input.  NULL is
    a value too, so a group without any number keeps its row.
    """
    counted = (
        df.groupBy(*keys, F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return cut_lineage(counted)


def quantiles(counted: DataFrame, keys: list[str], probs: dict[str, float], **kw) -> DataFrame:
    """Exact, linearly interpolated quantiles per group of a ``value_table``.

    A group with NULLs alone has NULL quantiles.
    """
    groups, counted = counted.select(*keys).distinct(), counted.where("value IS NOT NULL")
    ranked = running(counted, keys, ["value"], {"_cum": ("sum", F.col("count"))}, **kw)
    if keys:
        joined = join_on(ranked, counted.groupBy(*keys).agg(F.sum("count").alias("_total")), keys)
    else:
        joined = ranked.withColumn("_total", counted.agg(F.sum("count")).scalar())
    joined = joined.withColumns({"_first": F.col("_cum") - F.col("count"), "_last": F.col("_cum") - 1})
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)

        def at(index: Column) -> Column:
            return F.max(F.when((F.col("_first") <= index) & (index <= F.col("_last")), F.col("value")))

        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        frac = F.max(pos - F.floor(pos))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    out = joined.groupBy(*keys).agg(*aggs)
    return join_on(groups, out, keys, "left") if keys else out


def topk_generic(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key under a total order.

    ``row_number() <= k`` lets Spark prune to k rows per key before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
