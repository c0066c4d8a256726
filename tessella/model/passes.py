"""Data-parallel training: rows are dealt into shards once, and every pass works on all shards at the same time.

A shard is one row of a Parquet table in the shared folder: its units' features, ids and targets as packed arrays, in a
seeded order. It holds about ``SHARD_ROWS`` units, more where that would make over ``MOST`` shards, but never more than about ``SHARD_BYTES``.

A pass sends the weights to the executors. Each shard's share of them takes its own optimiser steps over the shard's
units, in batches of a fresh order; then weights, moments and batch-norm statistics are averaged over the shards, by their numbers of units
(local steps with periodic averaging: Stich, 2019). Sums are made within a task first and then over ever fewer tasks, so
the driver gets a few arrays of the network's size and no unit. With one shard a pass is a plain epoch. Held-out units are
scored with the weights that a pass begins with, in the same job. A lost executor's shards are read again: a shard's
steps depend on nothing but the weights, the epoch and the shard.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nn import AdamW, Network
from .objective import Objective, transformed

SHARD_ROWS, MOST, SHARD_BYTES, FAN = 16_384, 64, 32 << 20, 16
PACKED = "shard int, is_test boolean, units long, data binary"


def shards_for(rows: int, row_bytes: int) -> int:
    """How many shards that many rows make; it depends on the data alone, so results do too."""
    return max(1, min(MOST, -(-rows // SHARD_ROWS)), -(-rows * row_bytes // SHARD_BYTES))


def sharded(table: DataFrame, arrays: Callable, names: list[str], shards: int, seed: int) -> DataFrame:
    """``(shard, is_test, units, data)`` of ``table (unit_id, is_test, ...)``; ``arrays`` turns Arrow rows into the network's inputs, ``names`` are the targets."""

    def pack(batches):
        kept: list[pa.RecordBatch] = []
        now: tuple | None = None

        def done():
            rows = pa.Table.from_batches(kept).combine_chunks()
            x, ids = arrays(rows)
            raw = {n: rows.column(n).to_numpy().astype(float) for n in names}
            kept.clear()
            return pa.RecordBatch.from_pydict({"shard": pa.array([now[0]], pa.int32()), "is_test": [now[1]], "units": pa.array([len(x)], pa.int64()), "data": pa.array([pickle.dumps((x, ids, raw), 5)], pa.binary())})

        for b in batches:
            keys = list(zip(b.column("_shard").to_pylist(), b.column("is_test").to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                stop = at
                while stop < len(keys) and keys[stop] == keys[at]:
                    stop += 1
                if kept and keys[at] != now:
                    yield done()
                now = keys[at]
                kept.append(b.slice(at, stop - at))
                at = stop
        if kept:
            yield done()

    own = [F.col(n).cast("double").alias(n) for n in names]
    rest = [c for c in table.columns if c not in names]
    dealt = table.select(*rest, *own).withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "unit_id"), F.lit(shards)).cast("int"))
    order = F.xxhash64(F.lit(seed + 1), "unit_id")
    return dealt.repartition(shards, "_shard").sortWithinPartitions("_shard", "is_test", order, "unit_id").mapInArrow(pack, PACKED)


def _added(payloads: DataFrame, add: Callable[[list], object]) -> object:
    """All payloads (a pickled value for each task) as one, over ever fewer tasks; None without any."""

    def merge(batches):
        found = [pickle.loads(x) for b in batches for x in b.column("data").to_pylist()]
        if found:
            yield pa.RecordBatch.from_pydict({"data": pa.array([pickle.dumps(add(found), 5)], pa.binary())})

    n = payloads.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        payloads = payloads.repartition(n).mapInArrow(merge, "data binary")
    found = [pickle.loads(bytes(r["data"])) for r in payloads.collect()]
    return add(found) if found else None


def _mapped(shards: DataFrame, of: Callable, add: Callable[[list], object]) -> object:
    """The sum of ``of(shard, is_test, x, ids, raw)`` over all shards."""

    def run(batches):
        total = None
        for b in batches:
            for shard, is_test, data in zip(b.column("shard").to_pylist(), b.column("is_test").to_pylist(), b.column("data"), strict=True):
                one = of(shard, is_test, *pickle.loads(data.as_py()))
                if one is not None:
                    total = one if total is None else add([total, one])
        if total is not None:
            yield pa.RecordBatch.from_pydict({"data": pa.array([pickle.dumps(total, 5)], pa.binary())})

    return _added(shards.select("shard", "is_test", "data").mapInArrow(run, "data binary"), add)


Moments = tuple[int, np.ndarray, np.ndarray]


def merged_moments(found: list[dict[str, Moments]]) -> dict[str, Moments]:
    """Count, mean and sum of squared deviations of the parts together (Chan, Golub and LeVeque, 1979)."""
    out = found[0]
    for other in found[1:]:
        both = {}
        for k, (n, mean, m2) in out.items():
            m, mean_, m2_ = other[k]
            d, total = mean_ - mean, n + m
            both[k] = (total, mean + d * (m / max(total, 1)), m2 + m2_ + d * d * (n * m / max(total, 1)))
        out = both
    return out


def moments(shards: DataFrame, transforms: dict[str, str]) -> dict[str, Moments]:
    """Moments of the inputs (under the empty name) and of the transformed regression targets over the training units."""

    def of(shard, is_test, x, ids, raw):
        if is_test:
            return None
        values = {"": x} | {n: transformed(raw[n], how)[:, None] for n, how in transforms.items()}
        return {k: (len(v), v.mean(0), ((v - v.mean(0)) ** 2).sum(0)) for k, v in values.items()}

    return _mapped(shards, of, merged_moments) or {}


@dataclass
class State:
    """Everything that a pass changes."""

    net: Network
    optimizer: AdamW

    def arrays(self) -> dict[str, np.ndarray]:
        groups = {"p": self.net.p, "s": self.net.stats, "m": self.optimizer.m, "v": self.optimizer.v}
        return {f"{g}_{k}": x for g, of in groups.items() for k, x in of.items()}

    def load(self, arrays: dict[str, np.ndarray], t: int) -> None:
        groups = {"p": self.net.p, "s": self.net.stats, "m": self.optimizer.m, "v": self.optimizer.v}
        for name, x in arrays.items():
            groups[name[0]][name[2:]] = x
        self.optimizer.t = t


@dataclass
class Outcome:
    """Sums over shards: of units, arrays and losses of training; and of the held-out losses with their weights."""

    units: int = 0
    arrays: dict | None = None
    loss: float = 0.0
    steps: int = 0
    held: dict[str, tuple[float, float]] | None = None


def _joined(found: list[Outcome]) -> Outcome:
    out = Outcome(sum(o.units for o in found), None, sum(o.loss for o in found), max(o.steps for o in found))
    trained = [o.arrays for o in found if o.arrays is not None]
    if trained:
        out.arrays = {k: sum(a[k] for a in trained) for k in trained[0]}
    scored = [o.held for o in found if o.held is not None]
    if scored:
        out.held = {k: tuple(sum(h[k][j] for h in scored) for j in (0, 1)) for k in scored[0]}
    return out


def epoch_on(state: State, objective: Objective, x: np.ndarray, ids: list, raw: dict, epoch: int, lr: float, batch: int, accumulate: int, rng: np.random.Generator) -> float:
    """One pass over units in a fresh order; a step is taken after every ``accumulate`` batches. The loss, summed over units."""
    net, total, waiting, held = state.net, 0.0, 0, {}
    order = rng.permutation(len(x))
    for a in range(0, len(order), batch):
        k = order[a : a + batch]
        keep: list = []
        own = [i[k] for i in ids]
        h = net.latent(x[k], own, rng, keep, batch_stats=True)
        parts, at_heads = objective.loss(net, h, {n: y[k] for n, y in raw.items()}, epoch)
        total += objective.total(parts) * len(k)
        g = net.backward(own, keep, h, at_heads)
        if accumulate == 1:
            state.optimizer.step(net.p, g, lr)
            continue
        held = {n: held[n] + v * len(k) for n, v in g.items()} if waiting else {n: v * len(k) for n, v in g.items()}
        waiting += len(k)
        if (a // batch + 1) % accumulate == 0 or a + batch >= len(order):
            state.optimizer.step(net.p, {n: v / waiting for n, v in held.items()}, lr)
            waiting = 0
    return total


def run_pass(shards: DataFrame, state: State, objective: Objective, inputs: tuple[np.ndarray, np.ndarray], epoch: int, lr: float, batch: int, accumulate: int, seed: int, train: bool, evaluate: bool) -> Outcome:
    """One pass over all shards: training from ``state``, the held-out loss of ``state`` (with the loss of the epoch before), or both."""
    shared = shards.sparkSession.sparkContext.broadcast(pickle.dumps((state, objective, inputs), 5))

    def of(shard, is_test, x, ids, raw):
        if not (evaluate if is_test else train):
            return None
        own, goal, (mean, scale) = pickle.loads(shared.value)
        x = (x - mean) / scale
        if is_test:
            parts, _ = goal.loss(own.net, own.net.latent(x, ids), raw, epoch - 1)
            return Outcome(held={k: (value * over, over) for k, (value, over) in parts.items()})
        before = own.optimizer.t
        loss = epoch_on(own, goal, x, ids, raw, epoch, lr, batch, accumulate, np.random.default_rng([seed, epoch, shard]))
        return Outcome(len(x), {k: v * len(x) for k, v in own.arrays().items()}, loss, own.optimizer.t - before)

    rows = shards if train and evaluate else shards.where("not is_test" if train else "is_test")
    out = _mapped(rows, of, _joined) or Outcome()
    shared.destroy()
    return out


def held_logits(shards: DataFrame, net: Network, inputs: tuple[np.ndarray, np.ndarray], name: str) -> DataFrame:
    """``(logits, target)`` of a classification target for the held-out units."""
    shared = shards.sparkSession.sparkContext.broadcast(pickle.dumps((net, inputs), 5))

    def score(batches):
        own, (mean, scale) = pickle.loads(shared.value)
        for b in batches:
            for data in b.column("data"):
                x, ids, raw = pickle.loads(data.as_py())
                z = own.head(name, own.latent((x - mean) / scale, ids))
                at = pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(z.ravel())), pa.array(raw[name].astype(np.int64))], names=["logits", "target"])

    return shards.where("is_test").select("data").mapInArrow(score, "logits array<double>, target long")


def scored(rows: DataFrame, net: Network, target: str, vector: str) -> DataFrame:
    """``rows`` with ``scores``: a target's head applied to a column of latent vectors, where the rows are."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(net, 5))

    @F.arrow_udf("array<double>")
    def head(vectors: pa.Array) -> pa.Array:
        x = vectors.cast(pa.list_(pa.float64()))
        out = pickle.loads(shared.value).head(target, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

    return rows.withColumn("scores", head(vector))
