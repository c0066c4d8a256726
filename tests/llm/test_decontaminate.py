import hashlib
import random
import re

from pyspark.sql import functions as F

from tessella.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def expected(text, items, width=10):
    w, hit, ids = words(text), set(), set()
    for item_id, t in items:
        b = words(t)
        n = min(width, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1) if n else []:
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                ids.add(str(item_id))
    return len(w), len(hit), ",".join(sorted(ids))


def run(spark, docs, items):
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: r for r in D.decontaminate(d, b).collect()}


def test_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["a", "B", "the", "É", "é", "ﬁ", "x1", "Ünï", "zz", "K", "I", "İ"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "  ", "_"]) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 2, 3, 9, 10, 11, 25]))) for k in range(25)] + [(99, None), (100, "--"), (10, "a B")]
    docs = [text(rng.randrange(40)) for _ in range(60)] + [text(4) + items[k][1] + text(3) for k in range(25)] + ["-" + items[6][1].upper(), None, "", "..."]
    for block in (200_000, 7):  # also with many blocks
        monkeypatch.setattr(D, "BLOCK", block)
        got = run(spark, docs, items)
        for k, t in enumerate(docs):
            n, hit, ids = expected(t, items)
            assert (got[k]["n_words"], got[k]["n_hit"], ",".join(got[k]["item_ids"]), got[k]["contaminated"]) == (n, hit, ids, hit > 0), t


def test_edges(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    rows = D.decontaminate(awkward, items).collect()
    assert len(rows) == awkward.count()
    assert sorted((r["doc_id"], r["n_hit"]) for r in rows if r["contaminated"]) == [(4, 2), (5, 2), (5, 2)]
    assert D.decontaminate(nothing, items).collect() == [] and not any(r["contaminated"] for r in D.decontaminate(awkward, items.limit(0)).collect())
    digest = D.decontaminate(awkward.where("doc_id = 4"), items).select(F.sha2(F.array_join("item_ids", ","), 256)).first()[0]
    assert digest == hashlib.sha256(b"1").hexdigest()
