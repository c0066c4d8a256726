"""Near-duplicate operators against brute force."""

import random

import numpy as np
import pytest

from tessella.llm import jaccard as J
from tessella.llm import nndescent as N
from tessella.llm.graph import components


def joined(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, k) for k in range(501, 560)] + [(9, 9)]
    want = joined({x for e in links for x in e}, links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in set(want) - set(got))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(t, k=4):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def corpus():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, base = text(60), text(90)
    docs = [text(rng.randrange(30)) for _ in range(60)] + [text(20) + passage + text(rng.randrange(30)) for _ in range(60)]
    for _ in range(150):  # a family: some links, some near misses
        d = list(base)
        for _ in range(rng.randrange(5)):
            d[rng.randrange(len(d))] = rng.choice(words)
        docs.append(d)
    out = [(k, " ".join(d)) for k, d in enumerate(docs)]
    out += [(1000 + k, docs[k][:1] and " ".join(docs[k]).upper()) for k in range(0, 270, 9)]
    return [(k, t or "") for k, t in out]


@pytest.mark.parametrize(("pivots", "hot", "pairs"), [(1, 10, 3000), (12, 10, 10**7), (2, 1, 10**7)])
def test_jaccard(spark, monkeypatch, pivots, hot, pairs):
    # few pivots, hot buckets dealt over tasks, rounds of few pairs: the links are the same
    monkeypatch.setattr(J, "PIVOTS", pivots)
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "ROUND_PAIRS", pairs)
    monkeypatch.setattr(J, "GROWTH", 4)
    docs = corpus() + [(2000, None), (2001, "a b"), (2002, " A  b\n"), (2003, "")]
    sets = {k: shingles(t) for k, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = joined(sets, links)
    got = {r["doc_id"]: r for r in J.jaccard_components(spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, n int").repartition(5)).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(s) for k, s in sets.items()}


def test_orders_come_before_texts(spark, monkeypatch):
    # pairs that meet under the first order only are gone before any text is fetched; no link is lost
    seen = []

    def counted(docs, pairs, *more):
        seen.append({tuple(r) for r in pairs.collect()})
        return verify(docs, pairs, *more)

    def passed(pairs, sets):
        before.append(pairs.count())
        return intersect(pairs, sets)

    before, verify, intersect = [], J.verified, J.intersected
    monkeypatch.setattr(J, "verified", counted)
    monkeypatch.setattr(J, "intersected", passed)
    docs, rng = corpus(), random.Random(8)
    for k in range(200):  # pairs that share a quarter of their shingles: too little for a link
        own = [f"v{rng.randrange(900)}" for _ in range(40)]
        docs += [(3000 + 2 * k, " ".join(own)), (3001 + 2 * k, " ".join(own[:12] + [f"u{rng.randrange(900)}" for _ in range(28)]))]
    sets = {k: shingles(t) for k, t in docs}
    J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(before) > sum(map(len, seen)) > 0
    firsts = {frozenset(s): k for k, s in reversed(list(sets.items()))}
    links = {(a, b) for a in firsts.values() for b in firsts.values() if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    met = set().union(*seen)
    assert joined(firsts.values(), links & met) == joined(firsts.values(), links)


def test_jaccard_edges(spark, awkward, nothing):
    rows = J.jaccard_components(awkward).collect()
    assert len(rows) == awkward.count()
    of = {r["doc_id"]: r["component_id"] for r in rows}
    assert of[5] == of[4] == 4 and of[1] == 1 and of[2] == 2 and of[None] is None and of[7] == 7
    assert J.jaccard_components(nothing).collect() == []


def vectors():
    rng = np.random.default_rng(4)
    out, k = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            out.append((k, rng.normal(size=16).tolist(), label))
            k += 1
        base = rng.normal(size=16)
        for _ in range(70):  # a dense group, with lists that saturate
            out.append((k, (base + 0.1 * rng.normal(size=16)).tolist(), label))
            k += 1
        for _ in range(40):
            out.append((k, (base + 0.45 * rng.normal(size=16)).tolist(), label))
            k += 1
    same = rng.normal(size=16).tolist()
    out += [(k + j, same, 0) for j in range(90)]
    k += 90
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-300] * 16, [1e300] * 16]
    return out + [(k + j, v, 0) for j, v in enumerate(odd)]


def test_nn_descent(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 32)
    rows = vectors()
    unit = {}
    for k, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            unit[k] = (label, len(v), x / np.sqrt(x @ x))
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][:2] == unit[b][:2] and unit[a][2] @ unit[b][2] >= 0.93]
    n = dict.fromkeys([r[0] for r in rows], 0)
    for e in links:
        for x in e:
            n[x] += 1
    want = joined(n, links)
    df = spark.createDataFrame([(k, v, label, 1) for k, v, label in rows], "vec_id long, embedding array<double>, label int, dim int")
    got = {r["vec_id"]: r for r in N.near_links(df).collect()}
    assert len(got) == len(rows) and N.last_recall >= 0.9
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.98 * sum(n.values()) and all(r["n_links"] <= n[k] for k, r in got.items())
    assert sum(got[k]["component_id"] != want[k] for k in got) <= 0.02 * len(got)
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    none = N.near_links(spark.createDataFrame([], df.schema)).collect()
    assert none == []
    one = N.near_links(spark.createDataFrame([(None, [1.0, 1.0], 0, 1), (5, [1.0, 1.0], 0, 1), (5, [1.0, 1.0], 0, 1)], df.schema)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["kept"]) for r in one) == [("5", 1, True), ("5", 1, True), ("None", 0, False)]


def test_saturated_groups(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "TILE", 8)
    rng = np.random.default_rng(5)
    one, two, far = np.linalg.qr(rng.normal(size=(64, 3)))[0].T
    two = 0.955 * one + (1 - 0.955**2) ** 0.5 * two
    rows = [(30 * g + k, (base + 0.0125 * rng.normal(size=64)).tolist(), 1) for g, base in enumerate((one, two, far)) for k in range(30)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.93
    # two groups with more near copies within than a list holds, and links across; a third that is alone
    assert near[:60, :60].all() and near[60:, 60:].all() and not near[:60, 60:].any() and N.K_MAX < 29
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in N.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {k: (59, 0) if k < 60 else (29, 60) for k in range(90)}


def sparse(n, linked, dim=64):
    """Random vectors of one label, of which a few have one near copy."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.normal(size=(linked, dim))
    x[:linked] = x[-linked:] + 0.34 * noise / np.linalg.norm(noise, axis=1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x


@pytest.mark.parametrize("audit", [256, 64])
def test_sparse_links(spark, monkeypatch, audit):
    # few nodes have a link: no sample tells (256), or it sees enough and finds what one narrow table leaves (64)
    for name, value in {"TABLES": 1, "WINDOW": 1, "AUDIT": audit, "SEEN": 5, "BLOCK": 256, "PASSES": 2}.items():
        monkeypatch.setattr(N, name, value, raising=False)
    x = sparse(1200 if audit == 64 else 400, 90 if audit == 64 else 6)
    near = x @ x.T >= 0.93
    n = near.sum(1) - 1
    want = joined(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    got = {r["vec_id"]: r for r in N.near_links(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    assert n.sum() > 0 and {k: (r["n_links"], r["component_id"]) for k, r in got.items()} == {k: (n[k], want[k]) for k in want}
    assert N.last_recall == 1.0


def test_repeated_ids_with_other_vectors(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (6, [1.0, 0.01], 0), (7, [0.0, 2.0], 0), (7, [0.0, 2.0], 0), (8, [1.0, 0.0], 1)]
    got = N.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == sorted([(5, 1, 5, True), (5, 2, 5, True), (6, 1, 5, False), (7, 2, 5, False), (7, 2, 5, False), (8, 0, 8, True)])


def test_thousands_of_links_and_recall(spark, monkeypatch, caplog):
    # groups of 2 to 60 near copies in a random background: the descent itself must find the links, no exact comparison of all
    monkeypatch.setattr(N, "EXACT", 0)
    rng, rows = np.random.default_rng(9), []
    for g in range(150):
        base = rng.normal(size=48)
        for _ in range(int(rng.choice([1, 2, 3, 8, 20, 60], p=[0.3, 0.2, 0.2, 0.15, 0.1, 0.05]))):
            rows.append((len(rows), (base + 0.2 * rng.normal(size=48)).tolist(), g % 2))
    rows += [(len(rows) + k, rng.normal(size=48).tolist(), k % 2) for k in range(600)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    n = near.sum(1) - 1
    want = joined(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    with caplog.at_level("INFO", logger=N.__name__):
        got = {r["vec_id"]: r for r in N.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert n.sum() > 4000 and "exact comparison of all" not in caplog.text and "links" in caplog.text
    print(f"recall {found / n.sum():.4f} of {n.sum() // 2} links")
    assert found >= 0.98 * n.sum() and all(r["n_links"] <= n[k] for k, r in got.items())
    assert sum(got[k]["component_id"] != want[k] for k in got) <= 0.02 * len(got)


def test_recapture(spark, monkeypatch):
    # links too rare for a sample, more nodes than are compared exactly: new tables tell
    for name, value in {"EXACT": 0, "AUDIT": 64, "AUDIT_MAX": 64}.items():
        monkeypatch.setattr(N, name, value)
    x = sparse(1200, 12)
    near = x @ x.T >= 0.93
    n = near.sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in N.near_links(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    assert n.sum() > 0 and N.last_recall is not None and sum(got.values()) >= 0.9 * n.sum() and all(v <= n[k] for k, v in got.items())


@pytest.mark.parametrize("exact", [0, 262_144])
def test_size_does_not_matter(spark, monkeypatch, exact):
    # links too rare for the sample and too few tables to find them: all are found on both sides of EXACT
    for name, value in {"EXACT": exact, "TABLES": 1, "WINDOW": 2, "AUDIT_MAX": 256, "BLOCK": 256}.items():
        monkeypatch.setattr(N, name, value)
    x = np.concatenate([sparse(1500, 20), sparse(40, 3) * 0.2 + np.eye(64)[0], sparse(30, 3) * 0.2 + np.eye(64)[1]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.93
    n = near.sum(1) - 1
    want = joined(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    got = {r["vec_id"]: r for r in N.near_links(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    assert n[:1500].sum() == 40 and {k: (r["n_links"], r["component_id"]) for k, r in got.items()} == {k: (n[k], want[k]) for k in want}
