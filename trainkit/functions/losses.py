"""Per-row losses as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trainkit.functions.arrays import raised, total

LOG_FLOOR = -100.0  # logarithms of a probability don't fall below this


def floored_ln(p: Column) -> Column:
    """ln(p), at least -100; also for p = 0, where ln is null in one engine and infinite in another."""
    return F.when(p.isNull(), F.lit(None).cast("double")).when(p <= 0, F.lit(LOG_FLOOR)).otherwise(F.greatest(F.ln(F.when(p > 0, p)), F.lit(LOG_FLOOR)))


def bce(p: Column, y: Column) -> Column:
    """-(y ln p + (1 - y) ln(1 - p)), finite for p = 0 and p = 1."""
    return -(y * floored_ln(p) + (F.lit(1.0) - y) * floored_ln(F.lit(1.0) - p))


def bce_sum(p: Column, y: Column) -> Column:
    """Sum of the elements' binary cross-entropies."""
    return total(F.zip_with(p, y, bce))


def cross_entropy(logits: Column, label: Column) -> Column:
    """log-sum-exp of the logits less the label's logit."""
    return F.array_max(logits) + F.ln(total(raised(logits))) - F.get(logits, label.cast("int"))


def gaussian_kl(mu: Column, logvar: Column) -> Column:
    """-1/2 * sum(1 + logvar - mu^2 - e^logvar)."""
    return total(F.zip_with(mu, logvar, lambda m, v: F.lit(1.0) + v - m * m - F.exp(v))) * -0.5


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference of the elements."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def weighted_total_loss(reconstruction: Column, parts: list[tuple[Column, float]]) -> Column:
    """reconstruction + the weighted other losses."""
    out = reconstruction
    for loss, weight in parts:
        out = out + loss * weight
    return out
