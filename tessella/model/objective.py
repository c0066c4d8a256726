"""Losses of all targets of a network on a batch, with the gradients at its heads."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..operators.loss import Phase, phase_of
from ..sources.roles import Target
from .nn import Network


def restored(x: np.ndarray, transform: str) -> np.ndarray:
    return np.expm1(np.clip(x, -88, 88)) if transform == "log1p" else x * x if transform == "sqrt" else x


def transformed(x: np.ndarray, transform: str) -> np.ndarray:
    return np.log1p(x) if transform == "log1p" else np.sqrt(x) if transform == "sqrt" else x


@dataclass
class Objective:
    """What is trained for: targets, the scalers of their values, and the phases of the regression loss."""

    targets: list[Target]
    scalers: dict[str, tuple[float, float]]
    phases: list[Phase]
    boundaries: tuple[int, ...]

    def total(self, parts: dict[str, tuple[float, float]]) -> float:
        """The weighted sum of the targets' means."""
        return sum(t.weight * parts[t.name][0] for t in self.targets)

    def loss(self, net: Network, h: np.ndarray, raw: dict[str, np.ndarray], epoch: int) -> tuple[dict[str, tuple[float, float]], dict[str, np.ndarray]]:
        """Each target's mean loss with the weight that it is a mean over, and the gradients of the total at the heads' outputs."""
        parts, grads = {}, {}
        phase = self.phases[phase_of(epoch, self.boundaries) - 1]
        for t in self.targets:
            of = self._classes if t.task == "classification" else self._values
            mean, over, g = of(t, net.head(t.name, h), raw[t.name], phase)
            parts[t.name], grads[t.name] = (mean, over), t.weight * g
        return parts, grads

    def _classes(self, t: Target, out: np.ndarray, raw: np.ndarray, phase: Phase) -> tuple[float, float, np.ndarray]:
        y, at = raw.astype(int), np.arange(len(raw))
        z = np.exp(out - out.max(1, keepdims=True))
        p = z / z.sum(1, keepdims=True)
        w = np.array(t.class_weights)[y] if t.class_weights else np.ones(len(y))
        over = max(float(w.sum()), 1e-12)
        mean = float(-(w * np.log(p[at, y] + 1e-12)).sum() / over)
        p[at, y] -= 1
        return mean, float(w.sum()), p * w[:, None] / over

    def _values(self, t: Target, out: np.ndarray, truth: np.ndarray, phase: Phase) -> tuple[float, float, np.ndarray]:
        centre, scale = self.scalers[t.name]
        d = out[:, 0] - (transformed(truth, t.transform) - centre) / scale
        n, size = len(d), np.abs(d)
        if not n:
            return 0.0, 0.0, np.zeros((0, 1))
        small = size <= phase.huber_delta
        curve = np.where(small, 0.5 * d * d, phase.huber_delta * (size - 0.5 * phase.huber_delta))
        value = phase.mae * float(size.mean()) + phase.mse * float((d * d).mean()) + phase.huber * float(curve.mean())
        g = (phase.mae * np.sign(d) + phase.mse * 2 * d + phase.huber * np.where(small, d, phase.huber_delta * np.sign(d))) / n
        if phase.smape or phase.band:  # these two are taken in the original scale
            own = out[:, 0] * scale + centre
            original = restored(own, t.transform)
            slope = scale * (original + 1 if t.transform == "log1p" else 2 * np.abs(own) if t.transform == "sqrt" else 1.0)
            e, s = original - truth, np.abs(original) + np.abs(truth) + 1e-8
            value += phase.smape * float((np.abs(e) / s).mean())
            g = g + phase.smape * slope * (np.sign(e) / s - np.abs(e) * np.sign(original) / (s * s)) / n
            most = np.maximum(np.abs(truth), 1e-7)
            over = np.abs(e) / most - phase.band_threshold
            value += phase.band * float(np.maximum(over, 0).mean())
            g = g + phase.band * slope * (over > 0) * np.sign(e) / most / n
        return value, float(n), g[:, None]
