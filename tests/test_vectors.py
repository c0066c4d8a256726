"""Item vectors: skip-gram in blocks, and vectors of others pooled into features."""

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tessella.model.train import Trainer
from tessella.operators import encode, skipgram
from tessella.plans.encoder import EncoderModel
from tessella.plans.formula import lowered
from tessella.sources.roles import Target


def grouped(spark, units=400, seed=0):
    """Units draw their items from one of five groups, with a few from all; item 0 of each group is the most popular."""
    rng, rows = np.random.default_rng(seed), []
    for u in range(units):
        group = rng.integers(5)
        own = {(group, min(int(rng.exponential(4)), 11)) for _ in range(7)} | {(int(rng.integers(5)), int(rng.integers(12)))}
        rows += [(u, f"g{g}i{k}", float(rng.random() + 1)) for g, k in own]
    return spark.createDataFrame(rows, "unit_id long, item string, weight double")


def test_near_pairs(spark):
    obs = spark.createDataFrame([("u", "a", 5.0), ("u", "b", 4.0), ("u", "b", 0.5), ("u", "c", 3.0), ("u", "d", None), ("v", "a", 1.0), (None, "x", 1.0), ("v", None, 1.0)], "unit_id string, item string, weight double")
    want = {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")}
    assert sorted(map(tuple, skipgram.near_pairs(obs, 2).collect())) == sorted(want | {(b, a) for a, b in want})


def test_links_that_were_held_out(spark):
    obs = grouped(spark)
    pairs = skipgram.near_pairs(obs).distinct().toPandas()
    held = pairs.sample(frac=0.15, random_state=1)
    gone = {frozenset(p) for p in held.itertuples(index=False)}
    fit = lambda df: skipgram.item_vectors(df, dim=8, epochs=6, lr=0.1, blocks=3, seed=4)
    # observations of units that show a held-out link lose one of its items
    units = obs.groupBy("unit_id").agg(F.collect_set("item").alias("items")).toPandas()
    lost = {(u, sorted(p)[0]) for u, items in units.itertuples(index=False) for p in gone if p <= set(items)}
    train = obs.join(spark.createDataFrame(list(lost), "unit_id long, item string"), ["unit_id", "item"], "left_anti")
    df = fit(train)
    assert df.select("item").distinct().count() == df.count()
    v = {r["item"]: np.array(r["vector"]) for r in df.collect()}
    n = {r["item"]: r["count"] for r in train.groupBy("item").count().collect()}
    names, rng = sorted(v), np.random.default_rng(2)
    known = {frozenset(p) for p in pairs.itertuples(index=False)}
    cos = lambda a, b: v[a] @ v[b] / np.sqrt(v[a] @ v[a] * (v[b] @ v[b]))
    wins = popular = total = 0
    same = [tuple(p) for p in gone if p <= set(v) and len({x[:2] for x in p}) == 1]
    for a, b in same:
        other = names[rng.integers(len(names))]
        if other != a and frozenset((a, other)) not in known:
            total += 1
            wins += cos(a, b) > cos(a, other)
            popular += n[b] > n[other]
    assert total > 20 and wins > 0.8 * total and wins > popular
    again = {r["item"]: r["vector"] for r in fit(train.repartition(7)).collect()}
    assert all(np.allclose(again[k], x) for k, x in v.items())


def test_pooled(spark):
    obs = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (1, "zz", 4.0), (2, "b", None), (3, "zz", 1.0), (4, None, 1.0)], "unit_id long, item string, weight double")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [9.0, 9.0]), (None, [5.0, 5.0])], "item string, vector array<double>")
    got = {r["unit_id"]: (r["vector"], r["unknown_fraction"]) for r in encode.pooled_vectors(obs, vectors, 2, by="weight").collect()}
    assert got == {1: ([0.75, 0.5], 0.5), 2: ([0.0, 2.0], 0.0), 3: ([0.0, 0.0], 1.0), 4: ([0.0, 0.0], 1.0)}
    plan = encode.pooled_vectors(obs, vectors, 2, by="weight")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # sums, not rows of components
    with pytest.raises(SparkRuntimeException, match="components"):
        encode.pooled_vectors(obs, vectors, 3).collect()


@pytest.mark.parametrize("tune", [False, True])
def test_formula_term(spark, tmp_path, tune):
    rng = np.random.default_rng(6)
    value = {f"i{k}": rng.normal(size=3) for k in range(30)}
    rows = [(u, f"i{rng.integers(34)}", float(rng.random() + 0.1)) for u in range(250) for _ in range(6)]
    obs = spark.createDataFrame(rows, "unit_id long, item string, weight double")
    truth = {}
    for u in range(250):
        own = [(value[i], w) for k, i, w in rows if k == u and i in value]
        truth[u] = float(sum(w * x[0] for x, w in own) / sum(w for _, w in own)) if own else 0.0
    units = spark.createDataFrame([(u, y) for u, y in truth.items()], "unit_id long, score double")
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in value.items()], "item string, vector array<double>")
    formula = f"score ~ vectors(item, from=\"known\"{', tune=1' if tune else ''})"
    t = Trainer(formula, [Target.regression("score")], hidden=(16,), epochs=40, batch=32, lr=1e-2, dropout=0.0, shards=1, tables={"known": vectors})
    t.fit(units, obs)
    got = t.predict(units, obs).toPandas()
    assert np.corrcoef(got["score"], [truth[u] for u in got["unit_id"]])[0, 1] > 0.95
    t.save(str(tmp_path / "m"), spark)
    again = Trainer.load(str(tmp_path / "m"), spark).predict(units, obs).toPandas().sort_values("unit_id")
    assert np.allclose(again["score"], got.sort_values("unit_id")["score"])
    model = lowered(formula, units, obs, tables={"known": vectors}).fit(units, obs)
    if tune:
        assert model.bags[0][3] == 3 and t.net.p["q0"].shape == (31, 3) and not np.allclose(t.net.p["q0"][1], value["i0"])
        start = model.starts()["vectors_item:item"]
        assert np.allclose(start[1:], [value[k] for k in sorted(value)]) and (start[0] == 0).all()
    else:
        sums = {(r["unit_id"], r["slot"]): r["value"] for r in model.transform(units, obs).collect()}
        assert model.continuous_dim == 3 and sums[0, 0] == pytest.approx(truth[0])
        model.save(str(tmp_path / "e"), spark)
        again = {(r["unit_id"], r["slot"]): r["value"] for r in EncoderModel.load(str(tmp_path / "e"), spark).transform(units, obs).collect()}
        assert again == pytest.approx(sums)
    with pytest.raises(ValueError):
        lowered(formula, units, obs)


def test_pairs_are_kept_once_and_rounds_go(spark, monkeypatch):
    from collections import Counter

    from tessella.sources import shared

    rows, of = {}, {}

    def kept(df, name, **more):
        out = shared.written(df, name, **more)
        if name in ("pairs", "items"):
            rows[name] = [r.asDict() for r in out.collect()]
        return out

    monkeypatch.setattr(skipgram, "STRETCH", 7)
    monkeypatch.setattr(skipgram, "written", kept)
    rng, since = np.random.default_rng(3), shared.mark()
    obs = spark.createDataFrame([(u, f"i{rng.integers(60)}", float(rng.random())) for u in "abcd" for _ in range(40)], "unit_id string, item string, weight double")
    vectors = skipgram.item_vectors(obs, dim=4, min_count=1, epochs=2, blocks=3)
    assert len(shared._made) - since == 2  # items and the last round, not six rounds and all pairs
    of = {(r["block"], r["idx"]): r["item"] for r in rows["items"]}
    found = Counter((of[r["a_block"], a], of[r["b_block"], b]) for r in rows["pairs"] for a, b in zip(r["a"], r["b"], strict=True))
    want = Counter(map(tuple, skipgram.near_pairs(obs).collect()))
    assert found + Counter({(b, a): n for (a, b), n in found.items()}) == want
    assert {r["item"] for r in vectors.collect()} == {a for a, _ in want}


def test_word2vec_needs_no_vocabulary_in_the_driver(spark, monkeypatch):
    import pyspark.ml.feature

    from tessella.operators import similar

    def refused(*_, **__):
        raise AssertionError("a model with all vectors in one task and its vocabulary in the driver")

    monkeypatch.setattr(pyspark.ml.feature, "Word2Vec", refused)
    obs = spark.createDataFrame([("u", "twice", 1.0), ("u", "twice", 2.0), ("v", "a", 1.0), ("v", "b", None), ("w", "a", 1.0), ("x", "b", 3.0), ("x", "once", 1.0)], "unit_id string, item string, weight double")
    got = {r["word"]: r["vector"] for r in similar.item_vectors(obs, 4).getVectors().collect()}
    assert set(got) == {"twice", "a", "b"} and all(len(v) == 4 and np.isfinite(v.toArray()).all() for v in got.values())  # records count, in pairs or not
