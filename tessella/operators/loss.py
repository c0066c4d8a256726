"""Values of the training losses as aggregates over ``pred`` and ``target``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from .metrics import EPS, band, mae, smape

PHASES, SMAPE_WEIGHTS, BAND_WEIGHTS, BAND = (100, 300), (0.0, 0.2, 0.15), (0.0, 0.0, 0.05), 0.25


def phase_of(epoch: int, boundaries: tuple[int, ...] = PHASES) -> int:
    return 1 + sum(epoch >= b for b in boundaries)


def phased(epoch: int, boundaries: tuple[int, int] = PHASES) -> Column:
    """Absolute error; from the second phase on with a share of SMAPE, in the third also of predictions outside the band."""
    k = phase_of(epoch, boundaries) - 1
    out = mae()
    if SMAPE_WEIGHTS[k]:
        out = out + SMAPE_WEIGHTS[k] * smape()
    if BAND_WEIGHTS[k]:
        out = out + BAND_WEIGHTS[k] * (1 - band(BAND))
    return out


@dataclass(frozen=True)
class Phase:
    """Weights of the parts of a regression loss; at least one is positive."""

    mae: float = 0.0
    mse: float = 0.0
    huber: float = 0.0
    smape: float = 0.0
    band: float = 0.0
    huber_delta: float = 1.0
    band_threshold: float = 0.25

    def __post_init__(self) -> None:
        if min(self.mae, self.mse, self.huber, self.smape, self.band) < 0 or not any((self.mae, self.mse, self.huber, self.smape, self.band)):
            raise ValueError("a phase needs a positive weight and no negative ones")


PRESETS = {"mae": Phase(mae=1.0), "combined": Phase(mae=0.8, smape=0.15, band=0.05), "smape": Phase(mae=0.5, smape=0.5)}


def huber(delta: float = 1.0) -> Column:
    e = F.abs(F.col("pred") - F.col("target"))
    return F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)))


def phase_value(p: Phase) -> Column:
    """The loss of finite pairs; 0 if there are none."""
    e = F.abs(F.col("pred") - F.col("target"))
    excess = e / F.greatest(F.abs("target"), F.lit(10 * EPS)) - p.band_threshold
    parts = [(p.mae, mae()), (p.mse, F.avg(e * e)), (p.huber, huber(p.huber_delta)), (p.smape, F.avg(e / F.greatest((F.abs("pred") + F.abs("target")) / 2 + EPS, F.lit(10 * EPS)))), (p.band, F.avg(F.greatest(excess, F.lit(0.0))))]
    total = sum((w * x for w, x in parts if w > 0), F.lit(0.0))
    return F.coalesce(total, F.lit(0.0))


def phase_loss(df: DataFrame, p: Phase) -> DataFrame:
    return df.where(finite("pred") & finite("target")).agg(phase_value(p).alias("loss"))


def row_cross_entropy(logits: Column | str = "logits", target: Column | str = "target") -> Column:
    """-log softmax of the target's score, computed around the largest score."""
    logits, target = (F.col(x) if isinstance(x, str) else x for x in (logits, target))
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.log(total) + top - F.get(logits, target.cast("int"))


def cross_entropy(class_weights: tuple[float, ...] = ()) -> Column:
    """Mean over rows; with class weights the weighted mean."""
    ce = row_cross_entropy()
    if not class_weights:
        return F.avg(ce)
    w = F.get(F.array(*[F.lit(float(x)) for x in class_weights]), F.col("target").cast("int"))
    return F.sum(w * ce) / F.sum(w)


def multitask(losses: dict[str, tuple[float, Column]]) -> Column:
    """Weighted sum of several targets' losses; targets without any value are left out."""
    return sum((F.coalesce(w * x, F.lit(0.0)) for w, x in losses.values()), F.lit(0.0))
