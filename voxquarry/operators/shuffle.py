"""The shuffled order of an epoch as a keyed permutation of row numbers.

A row of number ``i`` out of ``n`` stands at place ``permuted(i)`` of the
epoch, by arithmetic alone: no sort, no ties, the same places on every run and
every machine.  Numbers are written as ``r * a + l`` over a rectangle just
above ``n``; Feistel rounds add a keyed function of one part to the other, and
a number that falls outside ``0..n-1`` walks on along its cycle until it is
back inside.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import global_rank

PRIME = 2**31 - 1  # squares of remainders stay below 2**62
ROUNDS = 6
WALK = 64  # steps a number may take outside; chance of more is below (1 / sqrt(n)) ** WALK


def keys_of(seed: int, epoch: int) -> list[tuple[int, int, int]]:
    """Three keys a round, drawn from seed and epoch."""
    out = []
    for k in range(ROUNDS):
        raw = hashlib.sha256(f"{seed}|{epoch}|{k}".encode()).digest()
        a, b, c = (int.from_bytes(raw[i : i + 4], "big") % PRIME for i in (0, 4, 8))
        out.append((max(a, 1), b, c))
    return out


def sides(n: int) -> tuple[int, int]:
    """Sides of the smallest rectangle as wide as the square root of ``n`` that holds it."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def walk_steps(n: int) -> int:
    """Steps outside that are enough: every place outside, or ``WALK``."""
    a, b = sides(n)
    return min(a * b - n, WALK)


def _walk(x: Column, n: int, keys: list[tuple[int, int, int]], times: int) -> Column:
    """``x`` permuted within the rectangle up to ``times`` times, until it is below ``n``."""
    a, b = sides(n)
    table = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(c) for v, c in zip(k, "fgh")]) for k in keys])

    def once(s: Column, k: Column) -> Column:
        # the part that stays decides what is added to the other
        even, key = k % 2 == 0, F.get(table, k % ROUNDS)
        u = (F.when(even, s["r"]).otherwise(s["l"]) % PRIME * key["f"] + key["g"]) % PRIME
        v = (u * u + key["h"]) % PRIME
        left = F.when(even, (s["l"] + v) % a).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise((s["r"] + v) % b)
        ends = (k % ROUNDS == ROUNDS - 1) & (right * a + left < n)
        moved = F.struct(left.alias("l"), right.alias("r"), ends.alias("done"))
        return F.when(s["done"], s).otherwise(moved)

    side = F.lit(a).cast("bigint")
    start = F.struct((x % side).alias("l"), F.call_function("div", x, side).alias("r"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(times * ROUNDS - 1)), start, once, lambda s: s["r"] * a + s["l"])


def permuted(i: Column, n: int, seed: int = 0, epoch: int = 0) -> Column:
    """Place of row number ``i`` (0 to n - 1) in the order of an epoch; a bijection of these numbers."""
    if not 0 < n < 2**60:
        raise ValueError("between 1 and 2**60 rows")
    keys, steps = keys_of(seed, epoch), walk_steps(n)
    place = _walk(i.cast("bigint"), n, keys, 1)
    if not steps:
        return place
    lost = F.raise_error(F.lit("the walk did not end")).cast("bigint")

    def onward(x: Column) -> Column:
        end = _walk(x, n, keys, steps)
        return F.when(x < n, x).when(end < n, end).otherwise(lost)

    return F.get(F.transform(F.array(place), onward), F.lit(0))


def numbered(rows: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """Stored rows with consecutive numbers from 0 in the order of a unique key; made once for all epochs."""
    return cut_lineage(global_rank(rows, order, out).withColumn(out, F.col(out) - 1))


def epoch_order(rows: DataFrame, n: int, seed: int = 0, epoch: int = 0, number: str = "number", out: str = "place") -> DataFrame:
    """``rows`` with the place of each in an epoch, exactly 0 to n - 1; a projection, nothing is moved."""
    return rows.withColumn(out, permuted(F.col(number), n, seed, epoch))
