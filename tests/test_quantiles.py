"""Quantiles by index: the search for large keys gives what ranking all samples gives."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import metrics


def plain(rows, low, high):
    of, out = {}, {}
    for k, v in rows:
        of.setdefault(k, []).append(v)
    order = lambda v: (v is not None, v is not None and math.isnan(v), 0.0 if v is None or math.isnan(v) else v)
    for k, own in of.items():
        own.sort(key=order)
        n = len(own)
        out[k] = tuple(own[min(i, n - 1)] for i in (math.floor(low * n), n // 2, math.floor(high * n)))
    return out


def rows():
    rng = random.Random(3)
    out = [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [("few", float(k)) for k in range(9)] + [("one", 2.0)]
    out += [("ties", float(rng.choice([1, 1, 1, 2, 7]))) for _ in range(900)] + [("same", 5.0)] * 400
    out += [("nulls", None)] * 300 + [("nulls", float(k)) for k in range(100)] + [("all null", None)] * 250 + [(None, float(k % 50)) for k in range(500)]
    out += [("odd", x) for x in [float("inf"), float("-inf"), float("nan")] * 80]
    return out


@pytest.mark.parametrize(("large", "low", "high"), [(10**9, 0.05, 0.95), (200, 0.05, 0.95), (200, 0.0, 1.0), (1, 0.25, 0.9)])
def test_intervals(spark, large, low, high):
    data = rows()
    got = metrics.intervals(spark.createDataFrame(data, "k string, v double").repartition(6), "k", "v", low, high, large).collect()
    assert {r["k"]: str((r["low"], r["mid"], r["high"])) for r in got} == {k: str(v) for k, v in plain(data, low, high).items()} and len(got) == 9


def test_wrong_bounds_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(metrics, "ACCURACY", 1)  # a sketch that may be off by everything
    data = rows()
    got = metrics.intervals(spark.createDataFrame(data, "k string, v double"), "k", "v", large=200).collect()
    assert {r["k"]: str((r["low"], r["mid"], r["high"])) for r in got} == {k: str(v) for k, v in plain(data, 0.05, 0.95).items()}
    monkeypatch.setattr(metrics.F, "percentile_approx", lambda v, near, accuracy: F.when(F.max("k") == "hot", F.array(*[F.lit(9.0)] * 6)).otherwise(F.array(*[F.min(v), F.max(v)] * 3)))
    got = metrics.intervals(spark.createDataFrame(data, "k string, v double"), "k", "v", large=200).collect()
    assert {r["k"]: str((r["low"], r["mid"], r["high"])) for r in got} == {k: str(v) for k, v in plain(data, 0.05, 0.95).items()}
