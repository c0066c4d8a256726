"""Methods against plain versions: event logs, BM25 choice, the pairwise ranking's steps, cut and slope."""

import random

import numpy as np
import pytest

from tessella.llm import chat, pack, quality


def interpreted(log):
    """Messages of one log of (seq, event, target, role, text), event by event."""
    low = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, x or "")
    found, last, named = {}, None, {}
    for at, (seq, event, target, role, said) in enumerate(sorted(log, key=lambda e: (low(e[0]), text(e[3]), text(e[4] or ""), text(e[1] or "message"), low(e[2])))):
        event = event or "message"
        if event == "message":
            found[at], last, named[seq] = [role or "", said or ""], at, at
            continue
        key = last if target is None else named.get(target)
        if key is None:
            continue
        if event == "regenerate":
            for k in [k for k in found if k >= key]:
                del found[k]
        elif key in found:
            found[key][1] = said or "" if event == "edit" else found[key][1] + (said or "")
    return [tuple(found[k]) for k in sorted(found)]


@pytest.mark.parametrize("seed", range(3))
def test_random_event_logs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        n = rng.randrange(0, 25)
        for k in range(n):
            event = rng.choice(["message", None, "delta", "delta", "edit", "regenerate"])
            seq = rng.choice([k, k, k, None, rng.randrange(1, n + 1)])
            target = None if event in ("message", None) else rng.choice([None, rng.randrange(0, n), rng.randrange(0, n), 99])
            rows.append((conv, seq, event, target, rng.choice(["user", "assistant", None]), rng.choice(["a", "b ", "</s>", None, "é"])))
    got = {}
    for r in chat.fold(spark.createDataFrame(rows, "conv_id long, seq long, event string, target long, role string, text string").repartition(5)).collect():
        got.setdefault(r["conv_id"], []).append((r["pos"], r["role"], r["text"]))
    for conv in range(60):
        own = sorted(got.get(conv, []))
        assert [p for p, *_ in own] == list(range(len(own)))
        assert [tuple(x) for _, *x in own] == interpreted([r[1:] for r in rows if r[0] == conv]), conv


def test_a_very_long_conversation(spark):
    rows = [(1, 3 * k, "message", None, ("user", "assistant")[k % 2], f"m{k}") for k in range(6000)]
    rows += [(1, 3 * k + 1, "delta", 3 * k, None, "+" * (k % 4)) for k in range(6000)] + [(1, 17_999, "edit", 0, None, "long " * 200_000)]
    got = chat.fold(spark.createDataFrame(rows, "conv_id long, seq long, event string, target long, role string, text string")).orderBy("pos").collect()
    assert len(got) == 6000 and got[0]["text"] == "long " * 200_000 and all(r["text"] == f"m{k}" + "+" * (k % 4) for k, r in enumerate(got) if k)


def test_bm25_choice():
    """Neighbours by the postings are those of a dense matrix of weights, over the seed's strongest terms."""
    rng = np.random.default_rng(0)
    vocabulary = 300
    docs = [np.minimum(rng.zipf(1.3, rng.integers(1, 120)), vocabulary - 1).astype(np.uint32) for _ in range(90)]
    tf = np.stack([np.bincount(d, minlength=vocabulary) for d in docs])
    df, sizes = (tf > 0).sum(0), np.array([len(d) for d in docs])
    idf, mean = np.log1p((90 - df + 0.5) / (df + 0.5)), sizes.mean()
    weight = idf * tf * (pack.K1 + 1) / (tf + pack.K1 * (1 - pack.B + pack.B * sizes[:, None] / mean))
    index = pack.Index(docs, idf, mean)
    index.used[rng.choice(90, 20, replace=False)] = True
    for seed in range(90):
        terms = np.argsort(-weight[seed], kind="stable")[: pack.TERMS]
        terms = terms[weight[seed][terms] > 0]
        own = np.sort(weight[seed][index.queries[seed]])
        assert np.allclose(own, np.sort(weight[seed][terms]))  # equal weights may stand for each other
        score = weight[:, index.queries[seed]].sum(1)
        near = index.neighbours(seed)
        unused = [k for k in range(90) if not index.used[k]]
        best = sorted(unused, key=lambda k: -score[k])[: len(near)]
        assert len(near) == min(pack.NEIGHBOURS, len(unused)) and not index.used[near].any()
        assert np.allclose(score[near], score[best], rtol=1e-5, atol=1e-6) and (np.diff(score[near]) <= 1e-4).all()


def test_ranking_by_plain_loops(monkeypatch):
    """Gradient steps over single pairs, every possible cut, every slope of the grid."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab ,.\n"), 60)) for _ in range(30)] + ["".join(rng.choice(list("xyz 19"), 60)) for _ in range(30)]
    y = np.array([1] * 30 + [0] * 30)
    y[[3, 40]] = 1 - y[[3, 40]]
    x = quality.features(texts)
    model = quality.Model().fit(x, y, steps=4, pairs=5)
    z = model.widen(x)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(7)
    w, m, v = [np.zeros(z.shape[1]) for _ in range(3)]
    for t in range(1, 5):
        a, b = draw.choice(good, 5), draw.choice(bad, 5)
        g = 1e-4 * w
        for i, j in zip(a, b, strict=True):  # the slope of -log(sigmoid(w (z_i - z_j)))
            d = z[i].astype(float) - z[j].astype(float)
            g = g - d / (1 + np.exp(w @ d)) / 5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (1 - 0.9 * t / 4) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(model.weights, w, rtol=1e-4, atol=1e-6)
    s = z @ model.weights
    errors = lambda cut: int(((s > cut) != (y == 1)).sum())
    order = np.sort(s)
    assert errors(model.cut) == min(errors((p + q) / 2) for p, q in zip(order, order[1:], strict=False))

    def loss(slope):
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * (s - model.cut), -30, 30))), 1e-4, 1 - 1e-4)
        return float(-np.where(y == 1, np.log(p), np.log(1 - p)).mean())

    assert loss(model.slope) == min(map(loss, np.geomspace(0.01, 10, 40)))
