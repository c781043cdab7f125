"""Learning rates by step or epoch, and step numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lr_warmup_cosine(step: Column, warmup: int, steps: int, base: float = 1.0, cycles: float = 0.5) -> Column:
    """Linear warm-up, then a half cosine down to zero."""
    progress = (step - warmup) / float(max(1, steps - warmup))
    cosine = F.greatest(F.lit(0.0), (F.cos(F.lit(2.0 * cycles) * F.pi() * progress) + 1.0) * 0.5)
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(cosine) * base


def lr_step_decay(epoch: Column, base: float, at: tuple[int, ...] = (100, 150), factor: float = 0.1) -> Column:
    """The base rate, times the factor from each epoch of `at` on."""
    rate = F.lit(base)
    for k, start in enumerate(at):
        rate = F.when(epoch >= start, F.lit(base * factor ** (k + 1))).otherwise(rate)
    return rate


def global_step(epoch: Column, batch: Column, batches: Column | int) -> Column:
    return epoch * batches + batch
