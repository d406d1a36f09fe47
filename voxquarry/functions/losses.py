"""Column expressions behind the loss-type metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def bce_with_logits(logit: Column, y: Column) -> Column:
    """Stable binary cross-entropy of one logit."""
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def smooth_l1(p: Column, g: Column) -> Column:
    d = F.abs(p - g)
    return F.when(d < 1.0, F.lit(0.5) * d * d).otherwise(d - F.lit(0.5))


def mean_of(cols: list[Column]) -> Column:
    return sum(cols[1:], cols[0]) / F.lit(float(len(cols)))


def binary_kl(p: Column, q: Column, eps: float = 1e-6) -> Column:
    """KL(p || q) of two Bernoulli probabilities, both clipped away from 0 and 1."""
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    q = F.least(F.greatest(q, F.lit(eps)), F.lit(1 - eps))
    return p * (F.ln(p) - F.ln(q)) + (1 - p) * (F.ln(1 - p) - F.ln(1 - q))
