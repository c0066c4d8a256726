"""Learning rates as functions of the epoch or step; they take numbers or Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cos(x):
    return F.cos(x) if isinstance(x, Column) else math.cos(x)


def step_lr(epoch, lr: float, size: int, gamma: float):
    """The rate times gamma for every ``size`` epochs passed."""
    if isinstance(epoch, Column):
        return lr * F.pow(F.lit(gamma), F.floor(epoch / size))
    return lr * gamma ** (epoch // size)


def cosine_lr(epoch, lr: float, lowest: float, epochs: int):
    return lowest + (lr - lowest) * 0.5 * (1 + _cos(math.pi * epoch / epochs))


def onecycle_lr(step, highest: float, steps: int, warm: float = 0.3, start_div: float = 25.0, end_div: float = 1e4):
    """A linear rise over the first share of the steps, then half a cosine down."""
    up = int(steps * warm)
    first, last = highest / start_div, highest / end_div
    rise = first + step / max(up, 1) * (highest - first)
    fall = last + 0.5 * (1 + _cos(math.pi * (step - up) / max(steps - up, 1))) * (highest - last)
    if isinstance(step, Column):
        return F.when(step <= up, rise).otherwise(fall)
    return rise if step <= up else fall
