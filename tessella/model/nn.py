"""A multi-task network in numpy: embeddings and continuous features, blocks of linear, batch norm, GELU and dropout, a linear head per target."""

from __future__ import annotations

import zlib

import numpy as np

_A = np.array([0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429])


def erf(x: np.ndarray) -> np.ndarray:
    """Error function, to about 1e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (_A[0] + t * (_A[1] + t * (_A[2] + t * (_A[3] + t * _A[4]))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / np.sqrt(2)))


def gelu_slope(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(x / np.sqrt(2))) + x * np.exp(-0.5 * x * x) / np.sqrt(2 * np.pi)


class Bags:
    """Sparse rows: row k has the values ``value[starts[k]:starts[k + 1]]`` at the columns ``idx[...]``."""

    def __init__(self, starts: np.ndarray, idx: np.ndarray, value: np.ndarray):
        self.starts, self.idx, self.value = starts, idx, value
        self.rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))

    def __getitem__(self, rows: np.ndarray) -> Bags:
        sizes = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[:-1][rows] - starts[:-1], sizes) + np.arange(starts[-1])
        return Bags(starts, self.idx[at], self.value[at])

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """The product with a dense matrix; only the rows of ``matrix`` that occur are read."""
        out = np.zeros((len(self.starts) - 1, matrix.shape[1]))
        np.add.at(out, self.rows, self.value[:, None] * matrix[self.idx])
        return out

    def transposed_times(self, d: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, d.shape[1]))
        np.add.at(out, self.idx, self.value[:, None] * d[self.rows])
        return out


class Network:
    """Parameters in ``p``, running batch-norm statistics in ``stats``; ``heads`` maps targets to output widths.

    ``ids`` of the methods has an array of ids for each embedding, then ``Bags`` for each sparse input, which is
    projected linearly; ``bags`` holds their (vocabulary size, dimension).
    """

    def __init__(self, continuous: int, embeddings: list[tuple[int, int, int]], hidden: tuple[int, ...], heads: dict[str, int], dropout: float = 0.1, seed: int = 0, bags: list[tuple[int, int]] | None = None):
        rng = np.random.default_rng(seed)
        self.embeddings, self.hidden, self.heads, self.dropout, self.bags = embeddings, hidden, heads, dropout, bags or []
        self.p: dict[str, np.ndarray] = {}
        self.stats: dict[str, np.ndarray] = {}
        width = continuous
        for k, (slots, size, dim) in enumerate(embeddings):
            self.p[f"e{k}"] = rng.normal(0, 0.1, (slots, size, dim))
            self.p[f"e{k}"][:, 0] = 0  # what is absent or unknown adds nothing
            width += slots * dim
        for k, (size, dim) in enumerate(self.bags):
            self.p[f"q{k}"] = rng.uniform(-1, 1, (size, dim)) / np.sqrt(max(size, 1))
            width += dim
        for k, n in enumerate(hidden):
            bound = 1 / np.sqrt(max(width, 1))
            self.p |= {f"w{k}": rng.uniform(-bound, bound, (width, n)), f"b{k}": np.zeros(n), f"g{k}": np.ones(n), f"s{k}": np.zeros(n)}
            self.stats |= {f"m{k}": np.zeros(n), f"v{k}": np.ones(n)}
            width = n
        for name, n in heads.items():
            self.p |= {f"hw_{name}": rng.uniform(-1, 1, (width, n)) / np.sqrt(max(width, 1)), f"hb_{name}": np.zeros(n)}

    @property
    def size(self) -> int:
        return sum(x.size for x in self.p.values())

    def latent(self, x: np.ndarray, ids: list[np.ndarray | Bags], rng: np.random.Generator | None = None, keep: list | None = None, batch_stats: bool = False) -> np.ndarray:
        """The last hidden layer. A generator switches dropout on; ``batch_stats`` is for training."""
        parts = [x] + [self.p[f"e{k}"][np.arange(i.shape[1])[None], i].reshape(len(i), -1) for k, i in enumerate(ids[: len(self.embeddings)])]
        parts += [bag.times(self.p[f"q{k}"]) for k, bag in enumerate(ids[len(self.embeddings) :])]
        h = np.concatenate(parts, axis=1)
        for k in range(len(self.hidden)):
            z = h @ self.p[f"w{k}"] + self.p[f"b{k}"]
            if batch_stats and len(z) > 1:
                mean, var = z.mean(0), z.var(0)
                self.stats[f"m{k}"] = 0.9 * self.stats[f"m{k}"] + 0.1 * mean
                self.stats[f"v{k}"] = 0.9 * self.stats[f"v{k}"] + 0.1 * var * len(z) / (len(z) - 1)
            else:
                mean, var = self.stats[f"m{k}"], self.stats[f"v{k}"]
            scale = 1 / np.sqrt(var + 1e-5)
            n = (z - mean) * scale
            y = n * self.p[f"g{k}"] + self.p[f"s{k}"]
            mask = (rng.random(y.shape) >= self.dropout) / (1 - self.dropout) if rng is not None and self.dropout else None
            out = gelu(y) if mask is None else gelu(y) * mask
            if keep is not None:
                keep.append((h, n, scale, y, mask))
            h = out
        return h

    def head(self, name: str, h: np.ndarray) -> np.ndarray:
        return h @ self.p[f"hw_{name}"] + self.p[f"hb_{name}"]

    def backward(self, ids: list[np.ndarray | Bags], keep: list, h: np.ndarray, at_heads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of all parameters from those of the heads' outputs."""
        g: dict[str, np.ndarray] = {}
        dh = np.zeros_like(h)
        for name, d in at_heads.items():
            g[f"hw_{name}"], g[f"hb_{name}"] = h.T @ d, d.sum(0)
            dh += d @ self.p[f"hw_{name}"].T
        for k in reversed(range(len(self.hidden))):
            below, n, scale, y, mask = keep[k]
            dy = (dh if mask is None else dh * mask) * gelu_slope(y)
            g[f"g{k}"], g[f"s{k}"] = (dy * n).sum(0), dy.sum(0)
            dn = dy * self.p[f"g{k}"]
            dz = scale * (dn - dn.mean(0) - n * (dn * n).mean(0)) if len(dn) > 1 else scale * dn
            g[f"w{k}"], g[f"b{k}"] = below.T @ dz, dz.sum(0)
            dh = dz @ self.p[f"w{k}"].T
        at = dh.shape[1] - sum(s * d for s, _, d in self.embeddings) - sum(d for _, d in self.bags)
        for k, (slots, _, dim) in enumerate(self.embeddings):
            d = dh[:, at : at + slots * dim].reshape(-1, slots, dim)
            grad = np.zeros_like(self.p[f"e{k}"])
            np.add.at(grad, (np.broadcast_to(np.arange(slots), ids[k].shape), ids[k]), d)
            grad[:, 0] = 0
            g[f"e{k}"] = grad
            at += slots * dim
        for k, (size, dim) in enumerate(self.bags):
            g[f"q{k}"] = ids[len(self.embeddings) + k].transposed_times(dh[:, at : at + dim], size)
            at += dim
        return g


class UnitRandom:
    """Uniform numbers, as ``Generator.random`` gives them, that depend on a row's unit and the draw alone."""

    def __init__(self, seed: int, units: list):
        self.own = np.array([zlib.crc32(str(u).encode()) | zlib.crc32(str(u).encode(), 1) << 32 for u in units], np.uint64)
        self.draw = np.uint64(seed)

    def random(self, shape: tuple[int, int]) -> np.ndarray:
        with np.errstate(over="ignore"):
            self.draw += np.uint64(1)
            x = self.own[:, None] + self._mixed(self.draw + np.arange(shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
            return (self._mixed(x) >> np.uint64(11)) * 2.0**-53

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        """The finaliser of SplitMix64 (Steele, Lea and Flood, 2014)."""
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class AdamW:
    """Adam with decoupled weight decay; gradients are clipped by their norm together."""

    def __init__(self, p: dict[str, np.ndarray], decay: float = 1e-4, clip: float = 1.0):
        self.m, self.v, self.t, self.decay, self.clip = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0, decay, clip

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], lr: float) -> None:
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, self.clip / (norm + 1e-6))
        self.t += 1
        for k, x in g.items():
            x = x * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * x * x
            p[k] -= lr * ((self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8) + self.decay * p[k])
