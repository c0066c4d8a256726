"""Data-parallel passes against a plain loop, and against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.model import passes
from tessella.model.nn import AdamW, Network
from tessella.model.objective import Objective
from tessella.model.train import PHASED, Trainer
from tessella.operators import split
from tessella.sources import io
from tessella.sources.roles import Target

FORMULA = "carbon ~ elevation + ph + hash(item, dim=8) + embed(genus, top=2) + sparse(family, dim=3)"
TARGETS = [Target.regression("carbon", "log1p"), Target.classification("habitat", 3)]


@pytest.fixture(scope="module")
def data(spark):
    u, o = io.sample_data(spark, 300, 40)
    return u.withColumn("carbon", F.col("elevation") / 100 + F.col("ph")), o


def plain(t, rows, epochs, accumulate):
    """A plain loop over all units on one machine, for a trainer's fitted encoder."""
    x, ids = Trainer._arrays(rows, t.encoder)
    test = np.array(rows.column("is_test").to_pylist(), bool)
    raw = {n.name: np.array(rows.column(n.name).to_pylist(), float) for n in t.targets}
    mean, sd = x[~test].mean(0), x[~test].std(0, ddof=1)
    x = (x - mean) / np.where(sd < 1e-8, 1, sd)
    y = np.log1p(raw["carbon"][~test])
    goal = Objective(t.targets, {"carbon": (y.mean(), y.std(ddof=1)), "habitat": (0.0, 1.0)}, list(PHASED), t.boundaries)
    net = Network(x.shape[1], [(s, n, d) for _, _, s, n, d in t.encoder.embeddings], t.hidden, {"carbon": 1, "habitat": 3}, t.dropout, t.seed, [(n, d) for _, _, n, d in t.encoder.bags])
    opt, out = AdamW(net.p, t.decay, t.clip), []
    train, held = np.flatnonzero(~test), np.flatnonzero(test)
    for epoch in range(epochs):
        rng = np.random.default_rng([t.seed, epoch, 0])
        order, total, waiting = train[rng.permutation(len(train))], 0.0, []
        for a in range(0, len(order), t.batch):
            k, keep = order[a : a + t.batch], []
            h = net.latent(x[k], [i[k] for i in ids], rng, keep, batch_stats=True)
            parts, at = goal.loss(net, h, {n: v[k] for n, v in raw.items()}, epoch)
            total += goal.total(parts) * len(k)
            waiting.append((len(k), net.backward([i[k] for i in ids], keep, h, at)))
            if len(waiting) == accumulate or a + t.batch >= len(order):
                n = sum(m for m, _ in waiting)
                opt.step(net.p, {name: sum(m * g[name] for m, g in waiting) / n for name in waiting[0][1]}, t.lr)
                waiting = []
        h = net.latent(x[held], [i[held] for i in ids])
        out.append((total / len(train), goal.total(goal.loss(net, h, {n: v[held] for n, v in raw.items()}, epoch)[0])))
    return out


@pytest.mark.parametrize("accumulate", [1, 3])
def test_one_shard_is_a_plain_loop(spark, data, accumulate):
    u, o = data
    t = Trainer(FORMULA, TARGETS, hidden=(16, 8), epochs=4, batch=32, lr=5e-3, shards=1, accumulate=accumulate)
    t.fit(u, o)
    seed = F.xxhash64(F.lit(t.seed + 1), "unit_id")
    marked = split.train_test(u.select("unit_id"), t.test_share, t.seed)
    rows = t._table(u, o, t.encoder).join(marked, "unit_id").orderBy("is_test", seed, "unit_id").toArrow()
    got = [(r["train_loss"], r["test_loss"]) for r in t.result.history]
    assert np.allclose(got, plain(t, rows, 4, accumulate), rtol=1e-9, atol=1e-9)


def test_shards_hold_every_unit_once_and_learn(spark, data):
    u, o = data
    t = Trainer(FORMULA, TARGETS, hidden=(16,), epochs=25, batch=16, lr=1e-2, shards=5, dropout=0.0)
    t.fit(u, o)
    first, last = t.result.history[0], t.result.history[-1]
    assert last["train_loss"] < 0.6 * first["train_loss"] and last["test_loss"] < first["test_loss"]
    one = Trainer(FORMULA, TARGETS, hidden=(16,), epochs=25, batch=16, lr=1e-2, shards=1, dropout=0.0)
    one.fit(u, o)
    assert t.result.best_loss < 1.6 * one.result.best_loss
    marked = split.train_test(u.select("unit_id"), 0.2, 1)
    dealt = t._dealt(t._table(u, o, t.encoder).join(marked, "unit_id"), 300)
    rows = dealt.collect()
    assert sum(r["units"] for r in rows) == 300 and len({r["shard"] for r in rows}) == 5 and sum(r["units"] for r in rows if r["is_test"]) == 60
    again = Trainer(FORMULA, TARGETS, hidden=(16,), epochs=3, batch=16, lr=1e-2, shards=5, dropout=0.0)
    again.fit(u.repartition(7), o)
    assert np.allclose([r["test_loss"] for r in again.result.history], [r["test_loss"] for r in t.result.history[:3]], rtol=1e-6)


def test_moments_merge():
    rng = np.random.default_rng(1)
    parts = [rng.normal(5, 3, (n, 2)) for n in (1, 7, 40, 2)]
    n, mean, m2 = passes.merged_moments([{"": (len(x), x.mean(0), ((x - x.mean(0)) ** 2).sum(0))} for x in parts])[""]
    whole = np.concatenate(parts)
    assert n == 50 and np.allclose(mean, whole.mean(0)) and np.allclose(m2 / 49, whole.var(0, ddof=1))


def test_sums_over_many_tasks(spark):
    many = spark.range(100).repartition(40)

    def pickled(batches):
        import pickle

        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"data": pa.array([pickle.dumps(sum(b.column("id").to_pylist()))], pa.binary())})

    assert passes._added(many.mapInArrow(pickled, "data binary"), sum) == 4950
    assert passes._added(many.where("id < 0").mapInArrow(lambda bs: iter(()), "data binary"), sum) is None


def test_nothing_held_out_or_nothing_at_all(spark, data):
    u, o = data
    t = Trainer("carbon ~ ph", TARGETS[:1], hidden=(4,), epochs=2, test_share=0.0)
    h = t.fit(u, o).history
    assert [r["test_loss"] for r in h] == [r["train_loss"] for r in h] and len(h) == 2
    assert passes.shards_for(0, 100) == 1 and passes.shards_for(10**6, 8) == 62 and passes.shards_for(10**9, 400) == -(-(10**9 * 400) // passes.SHARD_BYTES)


def test_patience_ends_training(spark, data):
    u, o = data
    t = Trainer("carbon ~ ph", TARGETS[:1], hidden=(4,), epochs=30, patience=2, min_delta=10.0, batch=64)
    h = t.fit(u, o).history
    assert len(h) == 3 and t.result.best_epoch == 0 and t.epoch == 3
