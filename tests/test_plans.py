"""Plans of encodings, hashing over buffers, pairs of items: results against plain loops, and what their plans read."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions.hashing import folded, hash_code, hash_column, hash_of, hash_sql
from tessella.operators import encode, select
from tessella.operators.cooccur import cooccurrence
from tessella.plans.encoder import Encoder


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(max_size=30), max_size=20), st.integers(0, 3))
def test_folded(texts, skip):
    got = folded(pa.array([*texts, "x" * 300], pa.string())[min(skip, len(texts)) :], (0, 1, 77))
    for row, seed in zip(got, (0, 1, 77), strict=True):
        assert row.tolist() == [hash_of(x or "", seed) for x in [*texts, "x" * 300][min(skip, len(texts)) :]]


def test_hash_columns(spark):
    words = ["", "a", "Ünïcödé 😀", None, "x" * 5000, "plain"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", hash_column("w", 3).alias("h"), F.expr(hash_sql("w", 3)).alias("s"), hash_code("w").alias("c")).collect()
    for r in rows:
        w = r["w"]
        assert (r["h"], r["c"]) == ((hash_of(w, 3), hash_of(w, 0) | (hash_of(w, 1) & 1) << 32) if w is not None else (None, None)) and r["h"] == r["s"]


def scans(df, name):
    """How often the executed plan reads a table by this path."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan" in line and name in line for line in plan.split("\n"))


def test_a_formula_scans_each_table_once(spark, tmp_path):
    rng = random.Random(4)
    u = [(k, rng.choice([None, 1.5 * k, -2.0]), rng.choice(["p", "q", None])) for k in range(40)]
    o = [(rng.randrange(42), rng.choice("abcdefgh"), rng.choice([None, 1.0, 2.5, 0.5]), rng.choice([None, 3.0, 4.0]), rng.choice(["f", "g", None])) for _ in range(400)]
    spark.createDataFrame(u, "unit_id long, depth double, soil string").write.parquet(f"{tmp_path}/units")
    spark.createDataFrame(o, "unit_id long, item string, weight double, height double, family string").write.parquet(f"{tmp_path}/obs")
    units, obs = spark.read.parquet(f"{tmp_path}/units"), spark.read.parquet(f"{tmp_path}/obs")
    e = Encoder().add_numeric("d", ["depth"]).add_hash("h", ["item"], dim=8).add_hash("t", ["item", "family"], dim=4, top=2).add_hash("b", ["item"], dim=4, bottom=2).add_hash("tb", ["item"], dim=4, top=1, bottom=2)
    e.add_onehot("s", ["soil"]).add_onehot("f", ["family"], source="obs").add_numeric("x", ["height"], source="obs").add_raw("r", ["height"], source="obs").add_raw("rd", ["depth"])
    e.add_hash("us", ["soil"], dim=4, source="units")
    model = e.fit(units, obs)
    df = model.transform(units, obs)
    assert scans(df, "/obs") == 1 and scans(df, "/units") <= 2  # the units once for their own terms, once to leave out strangers
    got = {}
    for r in df.collect():
        assert (r["unit_id"], r["slot"]) not in got
        got[r["unit_id"], r["slot"]] = r["value"]

    def hashed(items, dim):
        out = Counter()
        total = sum(w for _, w in items)
        for key, w in items:
            out[hash_of(key, 0) % dim] += (1 if hash_of(key, 1) % 2 == 0 else -1) * w / (total if total >= 1e-8 else 1)
        return out

    known = {k for k, _, _ in u}
    depth = np.array([x for _, x, _ in u if x is not None])
    mean = {}
    for k in {r[0] for r in o} & known:
        pairs = [((r[2] if r[2] is not None else 1.0), r[3]) for r in o if r[0] == k and r[3] is not None]
        mean[k] = sum(w * x for w, x in pairs) / sum(w for w, _ in pairs) if pairs else 0.0
    height = np.array(list(mean.values()))
    want = {}
    for k, x, soil in u:
        own = [r for r in o if r[0] == k]
        put = lambda at, values: want.update({(k, at + j): v for j, v in values.items()})  # noqa: E731, B023

        def items(key):
            c = Counter()
            for r in own:
                c[key(r)] += r[2] if r[2] is not None else 1.0
            return sorted(c.items(), key=lambda i: (-i[1], i[0]))

        by_item = items(lambda r: r[1])
        put(0, {0: (x - depth.mean()) / depth.std() if x is not None else 0.0})
        put(1, hashed(by_item, 8))
        put(9, hashed(items(lambda r: ":".join(p for p in (r[1], r[4]) if p is not None))[:2], 4))
        put(13, hashed(sorted(by_item, key=lambda i: (i[1], i[0]))[:2], 4))
        put(17, hashed(by_item[:1] + by_item[1:][-2:], 4))
        put(21, {{"p": 1, "q": 2, None: 0}[soil]: 1.0})
        put(24, {{"f": 1, "g": 2, None: 0}[r[4]]: 1.0 for r in own})
        put(27, {0: (mean[k] - height.mean()) / height.std() if k in mean else 0.0})
        put(28, {0: mean.get(k, 0.0)})
        put(29, {0: x if x is not None else 0.0})
        put(30, hashed([(soil or "", 1.0)], 4))
    got = {k: v for k, v in got.items() if k[0] in known and (abs(v) > 1e-12 or k[1] in (0, 27, 28, 29))}
    want = {k: v for k, v in want.items() if abs(v) > 1e-12 or k[1] in (0, 27, 28, 29)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_hashing_is_a_map(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1.0), (1, None, 2.0), (2, "b", None)], "unit_id long, item string, weight double").write.parquet(f"{tmp_path}/obs")
    df = encode.hash_features(spark.read.parquet(f"{tmp_path}/obs"), 8, norm="raw")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert scans(df, "/obs") == 1 and "Join" not in plan
    assert {(r["unit_id"], r["slot"]): r["value"] for r in df.collect()} == {(k, hash_of(w, 0) % 8): (1.0 if hash_of(w, 1) % 2 == 0 else -1.0) for k, w in ((1, "a"), (2, "b"))}


def test_top_bottom(spark):
    rng = random.Random(2)
    rows = [(k % 9 if k < 200 else 100 + k, f"i{rng.randrange(99)}", float(rng.randrange(6))) for k in range(260)]
    items = spark.createDataFrame(rows, "unit_id long, item string, weight double").dropDuplicates(["unit_id", "item"])
    df = select.top_bottom(items, 3, 2)
    assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    want, of = set(), {}
    for r in items.collect():
        of.setdefault(r["unit_id"], []).append((-r["weight"], r["item"]))
    for k, own in of.items():
        own.sort()
        want |= {(k, item, s) for s, (_, item) in enumerate(own[:3])} | {(k, item, 3 + s) for s, (_, item) in enumerate(reversed(own[3:][-2:]))}
    assert {(r["unit_id"], r["item"], r["slot"]) for r in df.collect()} == want


@pytest.mark.parametrize(("least", "block", "buckets"), [(1, 3, 7), (2, 3, 7), (3, 1000, 5), (2, 2, 1 << 20)])
def test_cooccurrence(spark, least, block, buckets):
    rng = random.Random(least)
    rows = [(rng.randrange(12), rng.randrange(30)) for _ in range(150)] + [(99, k) for k in range(28)] + [(98, k) for k in range(5, 25)] + [(97, None), (None, 3)] + [(99, 4)] * 3
    of = {}
    for k, x in rows:
        if k is not None and x is not None:
            of.setdefault(k, set()).add(x)
    want = Counter(p for s in of.values() for p in combinations(sorted(s), 2))
    got = cooccurrence(spark.createDataFrame(rows, "unit_id long, item long"), least, block, buckets).collect()
    assert {(r["a"], r["b"]): r["n"] for r in got} == {p: n for p, n in want.items() if n >= least} and len(got) > 0
