"""Kept tables: hits, misses and stale ones."""

import pytest
from pyspark.sql import functions as F

from tessella.model.train import Trainer
from tessella.sources import io
from tessella.sources.cache import Cache
from tessella.sources.roles import Target


def test_hits_and_misses(spark, tmp_path):
    at, cache = f"{tmp_path}/in", Cache(spark, f"{tmp_path}/kept")
    spark.range(10).write.parquet(at)
    read = lambda: spark.read.parquet(at).where("id > 2").select((F.col("id") * 2).alias("x"), F.transform(F.array("id"), lambda x: x + 1).alias("y"))
    built = []

    def table(df, spec, name="t"):
        return cache.table(name, [df], spec, lambda: built.append(1) or df.where("x > 8"))

    first = sorted(table(read(), {"a": 1}).collect())
    assert sorted(table(read(), {"a": 1}).collect()) == first and (cache.hits, cache.misses, len(built)) == (1, 1, 1)
    other = Cache(spark.newSession(), f"{tmp_path}/kept")
    assert sorted(other.table("t", [read()], {"a": 1}, lambda: pytest.fail("built again")).collect()) == first and other.hits == 1
    table(read(), {"a": 2}), table(read().where("x < 16"), {"a": 1}), table(read(), {"a": 1}, "u")
    assert cache.misses == 4 and len(cache.tables()) == 4
    # a file more: a miss, and the table that it makes stale goes
    spark.range(20, 22).write.mode("append").parquet(at)
    assert len(table(read(), {"a": 1}).collect()) == len(first) + 2 and cache.misses == 5 and len(cache.tables()) == 4
    assert table(read(), {"a": 1}).count() == len(first) + 2 and cache.hits == 2
    loose = spark.createDataFrame([(9,)], "x long")
    assert cache.key([loose], {}) is None and table(loose, {}).count() == 1 and cache.misses == 5
    cache.clear("u")
    assert len(cache.tables()) == 3
    cache.clear()
    assert cache.tables() == []


def test_second_fit_reads_the_cache(spark, tmp_path):
    u, o = io.sample_data(spark, 120, 20)
    u.write.parquet(f"{tmp_path}/u")
    o.write.parquet(f"{tmp_path}/o")
    folder = f"{tmp_path}/kept"

    def fit(formula="elevation ~ ph + hash(item, dim=8)", **more):
        t = Trainer(formula, [Target.regression("elevation")], hidden=(8,), epochs=2, cache=folder, **more)
        t.fit(spark.read.parquet(f"{tmp_path}/u"), spark.read.parquet(f"{tmp_path}/o"))
        return [r["test_loss"] for r in t.result.history], Cache(spark, folder).tables()

    loss, one = fit()
    again, same = fit()
    assert len(one) == 1 and same == one and again == pytest.approx(loss, rel=1e-9)
    assert len(fit("elevation ~ ph + hash(item, dim=4)")[1]) == 2 and len(fit(seed=7)[1]) == 3
    o.limit(50).write.mode("append").parquet(f"{tmp_path}/o")
    changed, kept = fit()
    assert len(kept) == 3 and not set(one) & set(kept) and changed != loss
