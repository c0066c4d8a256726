"""Mined negatives against plain loops."""

import math

import numpy as np
import pytest

from tessella.llm import hard_negatives as H


def plain(rows):
    good = [(k, v, x, [math.floor(256 * c) for c in e]) for k, (v, x, e) in enumerate(rows) if x is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)]
    out = []
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for k, v, label, q in good:
        if v is None or v % 100:
            continue
        scored = [(-clip(sum(a * b for a, b in zip(q, p))), w is None, w or 0, j, x) for j, w, x, p in good if j != k and len(p) == len(q)]
        for s, no_id, w, _, _ in sorted(r for r in scored if r[4] == label)[:5]:
            window = sorted(r for r in scored if r[4] != label and 80 * -s <= 100 * -r[0] <= 100 * -s)[:5]
            out += [(v, None if no_id else w, n + 1, None if r[1] else r[2], -s, -r[0]) for n, r in enumerate(window)]
    return sorted(out, key=str)


def rows(seed, n, dim=10):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dim))
    x = base[rng.integers(0, 6, n)] + rng.normal(0, 0.2, (n, dim))
    return [(int(v), int(rng.integers(0, 4)) if v % 3 else 0, [float(c) for c in e]) for v, e in zip(rng.permutation(n) * 20, np.round(x, 1 if seed else 6), strict=True)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_against_all_rows(spark, monkeypatch, seed):
    monkeypatch.setattr(H, "SAMPLE", 300)
    monkeypatch.setattr(H, "CENTROIDS", 16)
    monkeypatch.setattr(H, "TILE", 7)
    monkeypatch.setattr(H, "ANCHORS", 40 if seed == 2 else 4096)
    data = rows(seed, 400)
    docs = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, label int, embedding array<double>, row string").repartition(5)
    got = sorted(map(tuple, H.mined(docs).collect()), key=str)
    assert got == plain([(r["vec_id"], r["label"], r["embedding"]) for r in docs.select("vec_id", "label", "embedding").collect()]) and len(got) > 100


def test_awkward(spark):
    data = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.5]), (2, 2, [1.0, 1.4]), (None, 2, [1.0, 1.4]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [float("inf"), 1.0]), (100, 3, [-1.0, -1.0]), (200, 5, []), (7, 5, []), (8, 6, [])]
    data += [(300, 7, [1e200, 1.0, 1.0]), (9, 7, [1e150, 1.0, 1.0]), (10, 8, [1e150, 2.0, 1.0]), (400, 9, [0.5] * 40_000), (11, 9, [0.5] * 40_000), (12, 1, [0.5] * 40_000)]
    docs = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")
    got = sorted(map(tuple, H.mined(docs).collect()), key=str)
    assert got == plain(data) and {r[0] for r in got} == {0, 200, 300, 400}
    assert H.mined(docs.limit(0)).collect() == [] and H.mined(docs.where("vec_id = 1")).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(500, 11)) * 256)
    books = H.codebooks(list(x[:200]))[11]
    codes = np.stack([H._nearest(x[:, m * H.SUB : (m + 1) * H.SUB], c) for m, c in enumerate(books)], 1).astype(np.uint8)
    rest = np.stack([np.linalg.norm(x[:, m * H.SUB : (m + 1) * H.SUB] - c[codes[:, m]], axis=1) for m, c in enumerate(books)], 1)
    own = H.Anchors([{"row": k, "vec_id": k, "label": 0, "q": x[k].tobytes()} for k in range(20)], books)
    low, high = own.bounds(slice(0, 20), codes, rest)
    true = x[:20] @ x.T
    assert (low <= true).all() and (true <= high).all() and (high - low).mean() < np.abs(true).mean() * 4
