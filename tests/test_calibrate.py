"""Temperature scaling against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.model.train import Trainer
from tessella.operators.calibrate import calibration_sums, temperature
from tessella.sources import io
from tessella.sources.roles import Target


def plain(z, y, b):
    e = np.exp(b * (z - z.max(1, keepdims=True)))
    p = e / e.sum(1, keepdims=True)
    mean = (p * z).sum(1)
    at = np.arange(len(y))
    return -np.log(p[at, y]).mean(), (mean - z[at, y]).mean(), ((p * z * z).sum(1) - mean**2).mean()


def test_sums_and_fit(spark):
    rng = np.random.default_rng(3)
    true = rng.normal(size=(3000, 4))
    y = np.array([rng.choice(4, p=np.exp(r) / np.exp(r).sum()) for r in true])
    z = true * 3.0  # three times too sure
    rows = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(z, y)] + [([1.0, 2.0], None), ([1.0, 2.0], 5), (None, 1)], "logits array<double>, target int").cache()
    for b in (0.1, 1.0, 7.0):
        n, *got = calibration_sums(rows, b).first()
        assert n == 3000 and np.allclose(got, plain(z, y, b), rtol=1e-9)
    t, before, after = temperature(rows)
    assert t == pytest.approx(3.0, rel=0.15) and after < before and after == pytest.approx(min(plain(z, y, 1 / x)[0] for x in np.linspace(1, 6, 2001)), abs=1e-6)
    assert temperature(rows.limit(0)) == (1.0, 0.0, 0.0)
    # always right: the sharper the better, up to the bound
    assert temperature(spark.createDataFrame([([2.0, 1.0], 0)], "logits array<double>, target int"))[0] <= 0.1


def test_trainer(spark, tmp_path):
    u, o = io.sample_data(spark, 200, 40)
    noisy = u.withColumn("kind", F.pmod(F.xxhash64("unit_id"), F.lit(3)))  # nothing to learn: every confidence is too high
    t = Trainer("kind ~ ph + elevation + hash(item, dim=32)", [Target.classification("kind", 3)], hidden=(32,), epochs=25, batch=16, lr=2e-2, dropout=0.0, patience=99, calibrate=True)
    t.fit(noisy, o)
    sure = t.predict(noisy, o).agg(F.avg("kind_confidence")).first()[0]
    t.save(str(tmp_path / "m"), spark)
    again = Trainer.load(str(tmp_path / "m"), spark)
    assert again.temperatures == t.temperatures and t.temperatures["kind"] > 1 and again.calibrate
    assert again.predict(noisy, o).agg(F.avg("kind_confidence")).first()[0] == pytest.approx(sure)
    t.temperatures = {}
    assert t.predict(noisy, o).agg(F.avg("kind_confidence")).first()[0] > sure
