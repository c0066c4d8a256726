"""Sources, training, command line, streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.cli import main
from tessella.functions.hashing import integer_hash
from tessella.model.nn import Bags, Network, erf
from tessella.model.train import PRESETS, Trainer, preset_keywords
from tessella.operators import similar, units, vocab
from tessella.operators.cooccur import cooccurrence
from tessella.operators.loss import Phase
from tessella.sources import io
from tessella.sources.roles import Roles, Target
from tessella.streaming.hashing import windowed_hash


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,description,name\n1,"contains, comma",x\n\n2,"contains ""quotes""",y\n')
    df = io.read_csv(spark, str(tmp_path / "a.csv"))
    rows = sorted(df.collect())
    assert df.columns == ["name", "description"] and [r["description"] for r in rows] == ["contains, comma", 'contains "quotes"'] and rows[0]["name"] == "x"
    assert io.count_rows(spark, str(tmp_path / "a.csv")) == 2 and io.column_index(df, "description") == 1 and io.column_index(df, "zzz") == -1


def test_two_tables(spark):
    u = spark.createDataFrame([("a", "1.5"), ("b", "x"), (None, "2")], "id string, v string")
    o = spark.createDataFrame([("a", "i", None), ("c", "i", "2")], "id string, it string, w string")
    roles = Roles("id", "it", weight="w", covariates=("v",))
    units_, obs = io.from_two_tables(u, o, roles)
    assert sorted(r["v"] for r in units_.collect()) == [0.0, 1.5] and [(r["unit_id"], r["weight"]) for r in obs.collect()] == [("a", 1.0)]
    with pytest.raises(ValueError):
        io.from_two_tables(u.unionByName(u), o, roles)
    with pytest.raises(ValueError):
        io.from_two_tables(u.drop("v"), o, roles)


def test_unknown(spark):
    obs = spark.createDataFrame([("a", "x", 3.0), ("a", "z", 1.0), ("b", "z", 1.0)], "unit_id string, item string, weight double")
    v = vocab.alphabetical(obs.where("item = 'x'"), "item")
    got = {r["unit_id"]: r for r in vocab.unknown_share(obs, v).collect()}
    assert got["a"]["unknown_fraction"] == 0.25 and got["a"]["unknown_count"] == 1 and got["b"]["confidence"] == 0
    assert [r["item"] for r in units.unknown_items(obs, v).select("item").distinct().collect()] == ["z"]


def test_gradients():
    net = Network(3, [(2, 4, 2)], (5,), {"y": 1}, dropout=0.0, seed=1)
    rng = np.random.default_rng(0)
    x, ids, y = rng.normal(size=(8, 3)), [rng.integers(1, 4, (8, 2))], rng.normal(size=8)

    def loss():
        h = net.latent(x, ids, None, None, batch_stats=True)
        return ((net.head("y", h)[:, 0] - y) ** 2).mean()

    keep = []
    h = net.latent(x, ids, None, keep, batch_stats=True)
    g = net.backward(ids, keep, h, {"y": 2 * (net.head("y", h)[:, 0] - y)[:, None] / 8})
    for name in ("w0", "g0", "s0", "hw_y", "e0"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        net.p[name][at] += 1e-5
        up = loss()
        net.p[name][at] -= 2e-5
        down = loss()
        net.p[name][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-5)
    assert erf(np.array([0.0, 1.0])) == pytest.approx([0, 0.8427008], abs=2e-7)


def test_train_predict(spark, tmp_path):
    u, o = io.sample_data(spark, 200, 40)
    u = u.withColumn("carbon", F.col("elevation") / 100 + F.col("ph"))
    t = Trainer("carbon ~ elevation + ph + hash(item, dim=8) + embed(genus, top=2)", [Target.regression("carbon", "log1p"), Target.classification("habitat", 3)], hidden=(16,), epochs=40, batch=32, lr=5e-3, progress=str(tmp_path / 'progress.json'))
    with pytest.raises(ValueError):
        Trainer('y ~ x', [], loss=[Phase(mae=1), Phase(mse=1)], boundaries=())
    result = t.fit(u, o)
    assert result.history[-1]["train_loss"] < result.history[0]["train_loss"] and t.n_params > 0
    got = t.predict(u, o, latent=True, samples=5).orderBy("unit_id").toPandas()
    assert len(got) == 200 and len(got["latent"][0]) == 16 and (got["carbon_low"] <= got["carbon_high"]).all() and got["habitat"].isin([0.0, 1.0, 2.0]).all()
    assert (got["carbon_confidence"] == 1).all()
    strange = o.withColumn("item", F.concat("item", F.lit("x")))
    assert {r["carbon_confidence"] for r in t.predict(u, strange).collect()} == {0.0}
    scores = {(r["target"], r["metric"]): r["value"] for r in t.evaluate(u, o).collect()}
    assert scores["carbon", "r2"] > 0.5 and 0 <= scores["habitat", "accuracy"] <= 1
    assert np.corrcoef(got["carbon"], u.orderBy("unit_id").toPandas()["carbon"])[0, 1] > 0.8
    assert json.loads((tmp_path / "progress.json").read_text())["epoch"] == t.epoch - 1
    t.save(str(tmp_path / "m"), spark)
    again = Trainer.load(str(tmp_path / "m"), spark)
    assert np.allclose(again.predict(u, o).orderBy("unit_id").toPandas()["carbon"], got["carbon"])
    assert all(x["habitat"] is None for x in again.predict(u, o, threshold=1.1).collect())
    again.epochs = 2
    assert again.fit(u, o, resume=True).history[-1]["epoch"] == t.epoch + 1
    vectors, idx = t.embeddings("embed_genus", "genus").collect(), {r["value"]: r["idx"] for r in t.encoder.vocabularies["embed_genus:genus"].collect()}
    assert len(vectors) == 2 * len(idx) > 6 and all(r["vector"] == t.net.p["e0"][r["slot"], idx[r["value"]]].tolist() for r in vectors)


def test_cli(spark, tmp_path, capsys):
    u, o = io.sample_data(spark, 60, 20)
    u.write.parquet(str(tmp_path / "u"))
    o.write.parquet(str(tmp_path / "o"))
    common = ["--units", str(tmp_path / "u"), "--obs", str(tmp_path / "o"), "--unit", "unit_id", "--item", "item", "--weight", "weight", "--covariate", "ph", "--model", str(tmp_path / "m")]
    assert main(["train", *common, "--formula", "elevation ~ ph + hash(item, dim=8)", "--target", "elevation:regression:log1p", "--epochs", "3"], spark) == 0
    assert main(["predict", *common, "--out", str(tmp_path / "p")], spark) == 0
    assert main(["info", "--model", str(tmp_path / "m")], spark) == 0
    assert "elevation (regression, log1p)" in capsys.readouterr().out
    assert spark.read.csv(str(tmp_path / "p"), header=True).count() == 60


def test_similar(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, vector array<double>")
    got = similar.nearest(v, v.where("id = 1"), 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 3]
    obs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "z")], "unit_id string, item string")
    assert [tuple(r) for r in cooccurrence(obs, 2).collect()] == [("x", "y", 2)]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:05:00", "u", "a", 1.0), ("2024-01-01 00:15:00", "u", "a", 2.0), ("2024-01-01 01:05:00", "u", "b", 1.0)], "ts string, unit_id string, item string, weight double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_hash(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 8)
    q = stream.writeStream.format("memory").queryName("hashed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = sorted(map(str, windowed_hash(rows, 8).collect()))
    assert sorted(map(str, spark.table("hashed").collect())) == want and len(want) == 2


def test_catalogue():
    import __spark_entry__

    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 80 and json.dumps(sql)


@pytest.mark.parametrize("loss", ["mae", "combined", "smape", [Phase(mse=1.0), Phase(huber=1.0, band=0.1)]])
def test_losses_learn(spark, loss):
    u, _ = io.sample_data(spark, 120, 20)
    t = Trainer("elevation ~ elevation", [Target.regression("elevation")], hidden=(8,), epochs=12, batch=32, lr=1e-2, dropout=0.0, loss=loss, boundaries=(6,) if isinstance(loss, list) else (), schedule="onecycle")
    h = t.fit(u).history
    assert min(r["train_loss"] for r in h[:6]) < h[0]["train_loss"] and all(np.isfinite(r["test_loss"]) for r in h)


def test_projection_of_all_items(spark, tmp_path):
    from tessella.queries import sparse_projection

    part = spark.range(3100).select((F.col("id") + 10_000).alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1.0).alias("p_retailprice"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    often = part.crossJoin(spark.range(30)).select(F.lit(1).alias("l_orderkey"), F.col("p_partkey").alias("l_partkey"), F.lit(1.0).alias("l_quantity"))
    last = part.where("p_partkey = 13098").select(F.lit(2).alias("l_orderkey"), F.col("p_partkey").alias("l_partkey"), F.lit(4.0).alias("l_quantity"))
    often.unionByName(last).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["slot"]: r["value"] for r in sparse_projection(spark, str(tmp_path)).where("unit_id = 2").collect()}
    assert got == {j: 4 * ((3099 * 7 + j * 3) % 11 - 5) / 10 for j in range(4)}


def test_projection_and_large_vocabulary_are_not_broadcast(spark, monkeypatch):
    import duckdb

    from tessella.operators import order
    from tessella.queries import ORACLE, sparse_projection

    monkeypatch.setitem(order.numbered.__kwdefaults__, "one_task", 100)
    sf = "/root/testdata/sf0.01"
    df = sparse_projection(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_part" in plan and "BroadcastHashJoin [idx" not in plan and "BroadcastHashJoin [item" not in plan
    with duckdb.connect() as c:
        for t in ("orders", "lineitem", "part"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        assert sorted(map(tuple, df.collect())) == sorted(c.sql(ORACLE["sparse_projection"]).fetchall())


def test_item_vectors_of_long_units(spark):
    obs = spark.range(2500).select(F.lit("a").alias("unit_id"), F.format_string("i%04d", "id").alias("item"), (5000 - F.col("id")).cast("double").alias("weight"))
    model = similar.item_vectors(obs, 2, min_count=1)
    assert {r["word"] for r in model.getVectors().select("word").collect()} == {f"i{k:04d}" for k in range(2500)}
    parts = sorted(r["items"] for r in similar.sentences_of(obs).collect())
    assert [len(p) for p in parts] == [1000, 1000, 500] and sum(parts, []) == [f"i{k:04d}" for k in range(2500)]


def test_word2vec_items(spark):
    from tessella.queries import QUERIES, ol_obs

    sf = "/root/testdata/sf0.001"
    often = {r["item"] for r in ol_obs(spark, sf).groupBy("item").count().where("count >= 2").collect()}
    assert {r["item"] for r in QUERIES["word2vec_items"](spark, sf).collect()} == often


def test_item_encoder_embeds_what_it_selects(spark):
    from tessella.operators import vocab
    from tessella.plans.items import ItemEncoder

    obs = spark.createDataFrame([("u", "a", 9.0), ("u", "b", 5.0), ("u", "c", 1.0), ("v", "c", 2.0), ("v", "", 1.0)], "unit_id string, item string, weight double")
    slots = lambda **more: sorted(tuple(r) for r in ItemEncoder(representation="embed", **more).fit(obs).transform(obs).where("unit_id = 'u'").collect())
    assert slots(k=1, selection="bottom") == [("u", 0, 3)] and slots(k=1, selection="top") == [("u", 0, 1)]
    assert slots(k=1, selection="top_bottom") == [("u", 0, 1), ("u", 1, 3)] and slots(selection="all") == [("u", 0, 1), ("u", 1, 2), ("u", 2, 3)]
    # empty items are in no vocabulary
    assert {r["value"] for v in (vocab.by_frequency(obs, "item"), vocab.in_units(obs, "item", 1), vocab.alphabetical(obs, "item")) for r in v.collect()} == {"a", "b", "c"}


def test_running_sums_over_many_parts(spark):
    from tessella.operators.order import running

    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("x"), (F.col("id") % 13).alias("p"))
    small, large = (running(rows, F.desc("x"), {"down": "p"}, one_task=n) for n in (10**6, 100))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.select(small.columns).collect()))


def test_requested_rows(spark):
    from tessella.operators.units import requested

    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", None)], "unit_id string, x int")
    got = [tuple(r) for r in requested(df, ["c", "b", "missing", "a", "c"]).orderBy("place", "x").collect()]
    assert got == [(0, "c", None), (1, "b", 2), (1, "b", 3), (2, "missing", None), (3, "a", 1), (4, "c", None)]
    assert requested(df, []).collect() == []


def test_outliers_and_clusters(spark):
    rows = [(k, [1.0, 0.01 * k]) for k in range(12)] + [(20 + k, [0.01 * k, -1.0]) for k in range(12)] + [(99, [-1.0, 1.0]), (100, [0.0, 0.0]), (101, None)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    score = {r["id"]: r["score"] for r in similar.outliers(v.where("id < 100"), v.where("id < 100"), 3).collect()}
    assert max(score, key=score.get) == 99 and len(score) == 25
    of = {r["id"]: r["cluster"] for r in similar.clusters(v.where("id <> 99"), 2).collect()}
    assert len(of) == 24 and len({of[k] for k in range(12)}) == len({of[20 + k] for k in range(12)}) == 1 and of[0] != of[20]


def test_unknown_features_checkpoint_and_summary(spark, tmp_path):
    u, o = io.sample_data(spark, 80, 20)
    rare = o.withColumn("item", F.when(F.col("unit_id") == u.first()["unit_id"], F.concat(F.lit("rare"), F.monotonically_increasing_id())).otherwise(F.col("item")))
    more = {"hidden": (8,), "epochs": 4, "lr": 1e-2, "unknown_features": True, "min_units": 2, "clip": 0.5, "min_delta": 1e-9, "warmup": 3}
    t = Trainer("elevation ~ ph + hash(item, dim=8)", [Target.regression("elevation")], checkpoint=str(tmp_path / "c"), checkpoint_every=2, **more)
    t.fit(u, rare)
    assert len(t.inputs[0]) == t.encoder.continuous_dim + 2 and t.optimizer.clip == 0.5
    rates = [r["lr"] for r in t.result.history]
    assert rates[0] == pytest.approx(1e-2 / 3) and rates[2] == pytest.approx(1e-2)
    again = Trainer.load(str(tmp_path / "c"), spark)
    assert again.epoch == 4 and again.unknown_features and again.min_units == 2
    again.fit(u, rare, resume=True)
    assert again.epoch == 8 and len(again.result.history) == 8
    assert "hash of item" in again.summary() and "best" in again.summary()
    alone = t.predict(u, rare.limit(0)).count()
    assert alone == 80
    # intervals don't depend on how rows come in batches
    a, b = ({r["unit_id"]: r["elevation_low"] for r in t.predict(u.repartition(n), rare, samples=9).collect()} for n in (1, 7))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 * max(1, abs(a[k])) for k in a)


def test_bags_are_a_sparse_matrix():
    rng = np.random.default_rng(3)
    dense = rng.normal(size=(9, 6)) * (rng.random((9, 6)) < 0.3)
    starts = np.concatenate([[0], np.cumsum((dense != 0).sum(1))])
    bags = Bags(starts, np.nonzero(dense)[1], dense[dense != 0])
    w, d, some = rng.normal(size=(6, 4)), rng.normal(size=(9, 4)), np.array([7, 0, 3, 3])
    assert np.allclose(bags.times(w), dense @ w) and np.allclose(bags.transposed_times(d, 6), dense.T @ d)
    assert np.allclose(bags[some].times(w), dense[some] @ w) and bags[some[:0]].times(w).shape == (0, 4)
    # the gradient of a projection within a network
    net, x, y = Network(2, [], (5,), {"y": 1}, dropout=0.0, seed=1, bags=[(6, 3)]), rng.normal(size=(9, 2)), rng.normal(size=9)
    loss = lambda: ((net.head("y", net.latent(x, [bags], None, None, batch_stats=True))[:, 0] - y) ** 2).mean()
    keep = []
    h = net.latent(x, [bags], None, keep, batch_stats=True)
    g = net.backward([bags], keep, h, {"y": 2 * (net.head("y", h)[:, 0] - y)[:, None] / 9})["q0"]
    at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
    net.p["q0"][at] += 1e-5
    up = loss()
    net.p["q0"][at] -= 2e-5
    assert (up - loss()) / 2e-5 == pytest.approx(g[at], rel=1e-3)


def test_sparse_term(spark, tmp_path):
    u, o = io.sample_data(spark, 200, 40)
    liked = o.groupBy("unit_id").agg((F.sum(F.when(F.col("genus") < "g004", F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("liked"))
    u = u.join(liked, "unit_id")
    t = Trainer("liked ~ sparse(item, dim=4)", [Target.regression("liked")], hidden=(16,), epochs=60, batch=32, lr=1e-2, dropout=0.0)
    t.fit(u, o)
    got = t.predict(u, o).orderBy("unit_id").toPandas()
    assert np.corrcoef(got["liked"], u.orderBy("unit_id").toPandas()["liked"])[0, 1] > 0.9
    assert {(len(r["vector"]), r["slot"]) for r in t.embeddings("sparse_item", "item").collect()} == {(4, 0)} and t.net.p["q0"].shape[0] == t.encoder.vocab_size("sparse_item", "item")
    t.save(str(tmp_path / "m"), spark)
    again = Trainer.load(str(tmp_path / "m"), spark)
    assert np.allclose(again.predict(u, o).orderBy("unit_id").toPandas()["liked"], got["liked"])
    # units without observations, or with unknown items alone, are predicted from an empty bag
    bare = {r["liked"] for r in t.predict(u, o.limit(0)).collect()} | {r["liked"] for r in t.predict(u, o.withColumn("item", F.lit("new"))).collect()}
    assert max(bare) - min(bare) < 1e-9


def test_presets():
    assert {n: preset_keywords(n)["hidden"] for n in PRESETS} == {"tiny": (128, 64), "small": (256, 128, 64), "medium": (512, 256, 128, 64), "large": (1024, 512, 256, 128, 64), "xl": (2048, 1024, 512, 256, 128, 64), "max": (2048, 1024, 512, 256, 128, 64, 32)}
    t = Trainer.preset("max", "y ~ x", [Target.regression("y")], **preset_keywords("tiny", checkpoint="c"))
    assert t.hidden == (128, 64) and t.checkpoint == "c" and t.checkpoint_every == 50 and t.batch == 16384
    assert Trainer("y ~ x", t.targets, **t.keywords()).keywords() == t.keywords()
    with pytest.raises(ValueError):
        preset_keywords("huge")


def test_integer_hash(spark):
    ids = [0, 1, -1, 7, 2**31, -(2**31), 2**63 - 1, -(2**63), 1234567890123456789, -987654321987654321]

    def plain(x):
        x %= 2**64
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * c % 2**64
        x = (x ^ x >> 33) % 2**32
        return x - 2**32 if x >= 2**31 else x

    rows = spark.createDataFrame([(x,) for x in [*ids, None]], "x long").select("x", integer_hash(F.col("x")).alias("h")).collect()
    assert {r["x"]: r["h"] for r in rows} == {x: plain(x) for x in ids} | {None: None}


def test_pandas_source(spark):
    import pandas as pd

    u = pd.DataFrame({"id": ["a", "b", "c"], "v": [1.5, None, 3.0]})
    o = pd.DataFrame({"id": ["a", "a", "z"], "it": ["i", None, "j"], "w": [2.0, 1.0, float("nan")]})
    units_, obs = io.from_pandas(spark, u, o, Roles("id", "it", weight="w", covariates=("v",)))
    plain_u, plain_o = io.from_two_tables(spark.createDataFrame([("a", 1.5), ("b", None), ("c", 3.0)], "id string, v double"), spark.createDataFrame([("a", "i", 2.0), ("a", None, 1.0), ("z", "j", None)], "id string, it string, w double"), Roles("id", "it", weight="w", covariates=("v",)))
    assert sorted(map(str, units_.collect())) == sorted(map(str, plain_u.collect())) and sorted(map(str, obs.collect())) == sorted(map(str, plain_o.collect()))


def test_csv_inference_pads_short_rows_and_ignores_extra_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,y\n1,2.5,a\n2,3.5\n3,4.5,c,more\n")
    df = io.read_csv(spark, str(tmp_path / "a.csv"), infer=True)
    assert dict(df.dtypes) == {"id": "int", "x": "double", "y": "string"}
    assert sorted(map(tuple, df.collect())) == [(1, 2.5, "a"), (2, 3.5, None), (3, 4.5, "c")]
