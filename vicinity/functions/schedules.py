"""Learning-rate schedules and curricula as expressions over an epoch column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def multi_step(epoch: Column, base: float, milestones: list[int], gamma: float = 0.1, warmup: int = 10, factor: float = 0.01, method: str = "linear") -> Column:
    """``base`` times gamma to the number of milestones reached, warmed up at first (linear or constant)."""
    alpha = epoch.cast("double") / warmup
    warm = F.lit(factor) if method == "constant" else F.lit(factor) * (1 - alpha) + alpha
    reached = sum(((epoch >= m).cast("int") for m in milestones), F.lit(0))
    return F.lit(base) * F.when(epoch < warmup, warm).otherwise(1.0) * F.pow(F.lit(float(gamma)), reached)


def cosine(epoch: Column, base: float, t_initial: int, lr_min: float = 0.0, warmup: int = 0, warmup_start: float = 0.0, decay: float = 1.0, cycles: int = 1) -> Column:
    """Cosine from ``base`` to ``lr_min`` over ``t_initial`` epochs, ``cycles`` times, each cycle's start times ``decay`` to its number."""
    cycle = F.floor(epoch / t_initial)
    at = epoch - cycle * t_initial
    top = F.lit(base) * F.pow(F.lit(decay), cycle)
    wave = F.lit(lr_min) + (top - lr_min) * 0.5 * (1 + F.cos(F.lit(math.pi) * at / t_initial))
    late = F.when(cycle < cycles, wave).otherwise(F.lit(lr_min))
    return F.when(epoch < warmup, F.lit(warmup_start) + epoch * ((base - warmup_start) / max(warmup, 1))).otherwise(late)


def curriculum(epoch: Column, stages: list[tuple[int, int]]) -> Column:
    """``stages`` are (value, epochs); the last value stays."""
    values = F.flatten(F.array(*[F.array_repeat(F.lit(v), n) for v, n in stages]))
    return F.element_at(values, F.least(epoch.cast("int") + 1, F.lit(sum(n for _, n in stages))))
