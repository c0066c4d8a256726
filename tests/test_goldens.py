"""Fixed values that features, metrics and losses must have."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions.hashing import hash_column, hash_of
from tessella.functions.scalars import expm1_clamped, restored, transformed
from tessella.model.schedules import cosine_lr, onecycle_lr, step_lr
from tessella.operators import encode, loss, metrics, scale, select, split, vocab, weights
from tessella.plans.encoder import Encoder, EncoderModel
from tessella.plans.formula import lowered, parse
from tessella.sources.roles import Roles, Target

HASHES = {"sp1": (205891535, 2345866843), "sp2": (532366197, 2019341816), "sp3": (3286767037, 3559884425), "sp4": (4174508837, 2672197681), "sp5": (2633965836, 4212678240), "": (0, 1), "é": (1115975337, 2538735683)}
UNITS = [("p1", "clay", "wet", 500.0), ("p2", "sand", "dry", 100.0), ("p3", "clay", "wet", 800.0)]
OBS = [("p1", "s1", "GenusA", 0.5), ("p1", "s2", "GenusB", 0.3), ("p2", "s3", "GenusC", 0.8), ("p2", "s1", "GenusA", 0.2), ("p3", "s2", "GenusB", 0.6), ("p3", "s4", "GenusD", 0.1), ("p3", "s3", "GenusC", 0.3)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(UNITS, "unit_id string, soil string, climate string, elevation double"), spark.createDataFrame(OBS, "unit_id string, item string, genus string, weight double")


def pairs(spark, p, t):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, t, strict=True)], "pred double, target double")


def value(df, column):
    return df.agg(column.alias("v")).first()["v"]


def test_hash(spark):
    rows = spark.createDataFrame([(k,) for k in HASHES], "w string").select("w", hash_column("w", 0).alias("a"), hash_column("w", 1).alias("b")).collect()
    assert {r["w"]: (r["a"], r["b"]) for r in rows} == HASHES == {k: (hash_of(k, 0), hash_of(k, 1)) for k in HASHES}


def test_hash_features(spark):
    obs = spark.createDataFrame([("p1", "sp1", 0.5), ("p1", "sp2", 0.3), ("p2", "sp1", 0.8), ("p2", "sp3", 0.2)], "unit_id string, item string, weight double")
    got = {(r["unit_id"], r["slot"]): r["value"] for r in encode.hash_features(obs, 16, "top", 2, norm="raw").collect()}
    assert got == {("p1", 15): -0.5, ("p1", 5): 0.3, ("p2", 15): -0.8, ("p2", 13): -0.2}
    shares = encode.hash_features(obs, 16, norm="norm").groupBy("unit_id").agg(F.sum(F.abs("value")).alias("v")).collect()
    assert all(math.isclose(r["v"], 1) for r in shares)


def test_vocabulary(spark):
    v = vocab.alphabetical(spark.createDataFrame([("cat",), ("dog",), ("bird",), ("cat",), ("",), (None,)], "x string"), "x")
    assert {r["value"]: r["idx"] for r in v.collect()} == {"bird": 1, "cat": 2, "dog": 3}
    got = vocab.encoded(spark.createDataFrame([("fish",), ("dog",)], "x string"), "x", v, "i").collect()
    assert {r["x"]: r["i"] for r in got} == {"fish": 0, "dog": 3}


def test_encoder(tables, spark, tmp_path):
    units, obs = tables
    e = Encoder().add_numeric("n", ["elevation"]).add_hash("h", ["item"], dim=16, top=2).add_onehot("o", ["soil"]).add_embed("g", ["genus"], top=1, bottom=1)
    model = e.fit(units, obs)
    assert model.continuous_dim == 1 + 16 + 3
    ids = {(r["unit_id"], r["slot"]): r["idx"] for r in model.ids(units, obs, "g").collect()}
    assert ids == {("p1", 0): 1, ("p1", 1): 2, ("p2", 0): 3, ("p2", 1): 1, ("p3", 0): 2, ("p3", 1): 4}
    rows = {(r["unit_id"], r["slot"]): r["value"] for r in model.transform(units, obs).collect()}
    assert [round(rows[u, 0], 6) for u in ("p1", "p2", "p3")] == [0.116248, -1.278724, 1.162476]
    assert {k: v for k, v in rows.items() if k[1] >= 17} == {("p1", 18): 1.0, ("p2", 19): 1.0, ("p3", 18): 1.0}
    model.save(str(tmp_path / "e"), spark)
    again = EncoderModel.load(str(tmp_path / "e"), spark)
    assert sorted(again.transform(units, obs).collect()) == sorted(model.transform(units, obs).collect())
    other = spark.createDataFrame([("p9", "chalk", "wet", None)], units.schema)
    new = {r["slot"]: r["value"] for r in again.transform(other, obs.limit(0)).collect()}
    assert new == {0: 0.0, 17: 1.0}
    with pytest.raises(ValueError):
        Encoder().add_raw("x", ["nowhere"]).fit(units, obs)


def test_formula(tables):
    units, obs = tables
    f = parse('cbind(elevation, soil) ~ elevation + hash(item, dim=8, top=2, by="weight") + embed(genus) + onehot(soil)')
    assert f.targets == ["elevation", "soil"] and [t.kind for t in f.terms] == ["numeric", "hash", "embed", "onehot"]
    assert lowered(f, units, obs).fit(units, obs).continuous_dim == 1 + 8 + 3
    for bad in ("y ~", "y ~ hash()", "elevation ~ soil", "elevation ~ nothing", "gone ~ elevation", 'elevation ~ hash(item, by="z")', "elevation ~ hash(item, odd=1)", "elevation ~ what(item)", "a b"):
        with pytest.raises(ValueError):
            lowered(bad, units, obs)


def test_selection_and_weights(tables):
    _, obs = tables
    items = weights.item_weights(obs)
    best = {(r["unit_id"], r["rank"]): r["item"] for r in select.top(items, 2).collect()}
    assert best["p3", 1] == "s2" and best["p3", 2] == "s3" and len(best) == 6
    both = {(r["unit_id"], r["slot"]): r["item"] for r in select.top_bottom(items, 1, 1).collect()}
    assert both == {("p1", 0): "s1", ("p1", 1): "s2", ("p2", 0): "s3", ("p2", 1): "s1", ("p3", 0): "s2", ("p3", 1): "s4"}


def test_scalers(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0), (20.0, 5.0)], "x double, y double")
    z = scale.scaled(df, scale.fitted(df, ["x", "y"], "population"), ["x", "y"]).collect()
    assert z[1]["x"] == 0 and all(r["y"] == 0 for r in z)


def test_metrics(spark):
    assert value(pairs(spark, [1, 2, 3, 4, 5], [1.5, 2, 2.5, 4.5, 5]), metrics.mae()) == pytest.approx(0.3, abs=1e-5)
    assert value(pairs(spark, [1, 2, 3], [2, 2, 4]), metrics.rmse()) == pytest.approx(0.8165, abs=1e-3)
    assert value(pairs(spark, [1, 2, 3, 4, 5], [1.1, 2, 2.9, 4.1, 5]), metrics.r2()) == pytest.approx(0.996947, abs=1e-5)
    assert value(pairs(spark, [1, 2, 3], [3, 2, 1]), metrics.r2()) == pytest.approx(-3)
    assert value(pairs(spark, [1, 2], [5, 5]), metrics.r2()) == 1
    assert value(pairs(spark, [100, 200, 300], [110, 200, 280]), metrics.smape()) == pytest.approx(0.027367, abs=1e-5)
    assert value(pairs(spark, [100, 200], [110, 180]), metrics.smape("half")) == pytest.approx(0.100251, abs=1e-5)
    df = pairs(spark, [100, 200, 300, 400], [100, 180, 250, 500])
    assert value(df, metrics.band(0.25)) == 1 and value(df, metrics.band(0.1)) == 0.25
    assert value(pairs(spark, [100, 200, 300, 400], [100, 180, 400, 600]), metrics.band(0.25, "finite")) == 0.75


def test_classification(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 0)], "target long, pred long")
    rows = {r["class"]: r for r in metrics.per_class(df, 2).collect()}
    assert [rows[c]["support"] for c in (0, 1)] == [2, 2] and [rows[c]["precision"] for c in (0, 1)] == [0.5, 0] and [rows[c]["recall"] for c in (0, 1)] == [1, 0]
    assert metrics.f1_scores(df, 2).first()["macro_f1"] == pytest.approx(1 / 3)
    sure = spark.createDataFrame([(0, 0, 0.9), (1, 1, 0.7), (1, 0, 0.6), (1, 0, 0.5)], "target long, pred long, confidence double")
    got = {r["threshold"]: r for r in metrics.coverage(sure, (0.0, 0.65, 1.0)).collect()}
    assert [got[t]["n_samples"] for t in (0.0, 0.65, 1.0)] == [4, 2, 0] and [got[t]["accuracy"] for t in (0.0, 0.65, 1.0)] == [0.5, 1, 0]
    curve = [r["coverage"] for r in metrics.coverage(sure).orderBy("threshold").collect()]
    assert curve == sorted(curve, reverse=True)
    empty = metrics.per_class(df.limit(0), 2).collect()
    assert all(r["f1"] == 0 and r["support"] == 0 for r in empty)


def test_losses(spark):
    assert [loss.phase_of(e) for e in (99, 100, 299, 300)] == [1, 2, 2, 3]
    df = pairs(spark, [1, 2, 3], [1.1, 2, 2.9])
    assert [round(value(df, loss.phased(e)), 6) for e in (0, 100, 300)] == [0.066667, 0.070971, 0.069895]
    df = pairs(spark, [1, 2, 3], [1, 3, 5])
    assert value(df, loss.phase_value(loss.Phase(mae=1))) == 1 and value(df, loss.phase_value(loss.Phase(mse=1))) == pytest.approx(5 / 3)
    with pytest.raises(ValueError):
        loss.Phase()
    ce = spark.createDataFrame([([2.0, 1.0, 0.1], 0), ([0.5, 2.0, 0.3], 1)], "logits array<double>, target long")
    assert value(ce, loss.cross_entropy()) > 0


def test_transforms_and_rates(spark):
    row = spark.createDataFrame([(1.0, 1000.0)], "x double, big double").select(restored(transformed("x", "log1p"), "log1p").alias("a"), expm1_clamped("big").alias("b"), restored(transformed("x", "sqrt"), "sqrt").alias("c")).first()
    assert row["a"] == pytest.approx(1) and math.isfinite(row["b"]) and row["c"] == pytest.approx(1)
    assert step_lr(250, 1.0, 100, 0.1) == pytest.approx(0.01) and cosine_lr(0, 1.0, 0.0, 10) == 1 and cosine_lr(10, 1.0, 0.0, 10) == pytest.approx(0)
    assert onecycle_lr(0, 1.0, 100) == pytest.approx(0.04) and onecycle_lr(30, 1.0, 100) == pytest.approx(1) and onecycle_lr(100, 1.0, 100) == pytest.approx(1e-4)


def test_splits(spark):
    df = spark.range(101).withColumnRenamed("id", "unit_id")
    a, b = (split.train_test(df, 0.2, 1).where("is_test").collect() for _ in range(2))
    assert len(a) == 20 and sorted(a) == sorted(b)
    far = split.numbered(df, "unit_id", name="k", one_task=10).collect()
    assert sorted((r["unit_id"], r["k"]) for r in far) == [(k, k + 1) for k in range(101)]


def test_roles():
    with pytest.raises(ValueError):
        Roles("u", "i", latitude="x")
    assert Target.parse("area:regression:log1p") == Target.regression("area", "log1p")
    assert Target.parse("kind:classification:3").num_classes == 3
