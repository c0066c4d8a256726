"""The pipeline's stages on the smallest tables."""

import re

import numpy as np
import public_tokenizers
import tokenizers

import corpus_pipeline
from tessella.llm.quality import Model, features

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.toArrow())
        rows.append(docs.count())
    assert rows == sorted(rows, reverse=True) and rows[2] == rows[3] > 0
    ids = {r["doc_id"] for r in docs.collect()}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == ids
    tokens = {}
    for r in packed:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert all(tokens[r["doc_id"]] == r["doc_tokens"] for r in packed)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_near_duplicates_from_80_percent(spark):
    words = [f"w{k}" for k in range(220)]
    rows = [(1, " ".join(words[:200])), (2, " ".join(words[:180] + words[200:])), (3, " ".join(words[:170] + [f"x{k}" for k in range(30)]))]
    # five-word Jaccard of 1 and 2: 176/216 = 0.815; of 1 and 3: 166/226 = 0.735
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [1, 3]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, gone long, own string, hit int, spans string"


def awkward_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, extra columns with clashing names."""
    words = [f"w{k}" for k in range(400)]
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if r["text"] and len(r["text"].split()) > 12)
    texts = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (6, "one two three"), (None, "one two"), (None, None),
        (10, " ".join(words)), (11, " ".join(words)), (12, " ".join(words[:370] + words[:5])), (13, " ".join(words[200:])), (13, " ".join(words[:390])), (14, "other text of id fourteen, all its own"),
        (20, "long " * 40_000), (21, "long " * 40_001), (22, "x" * 60_000), (30, f"before {item} after"), (31, item.upper()), (None, item), (32, "before " + " ".join(item.split()[:4])),
        (40, "write to jo.doe@mail.example.org or +1 (555) 010-9999 now"), (41, "host 10.0.0.7, card 4111 1111 1111 1111."), (42, "Ünïcödé 😀 \\ </s> é"),
    ]
    rows = [(k, t, None if j % 3 else "en", f"s{j % 2}", None if t is None else len(t), j, "o", None, "x") for j, (k, t) in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None,) * 9], COLUMNS)


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


def windows(text, width=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[k : k + n]) for n in [min(width, len(w))] for k in range(len(w) - n + 1)} if w else set(), w


def test_each_stage_against_brute_force(spark):
    docs = awkward_documents(spark)
    rows = listed(docs)

    # near duplicates: links of any row of an id, smallest id of a group, smallest row of an id
    sets = {}
    for r in rows:
        w = "".join(c.lower() if c.isascii() else c for c in r[1] or "").split(" ") if r[1] and r[1].strip() else []
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", " ".join(w)) if x]
        sets.setdefault(r[0], []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = sorted(x for x in sets if x is not None)
    group = {x: x for x in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    nulls_first = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    want = [r for r in rows if r[0] is None] + [min((r for r in rows if r[0] == x), key=nulls_first) for x in ids if group[x] == x]
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns and listed(got) == sorted(want, key=str)
    assert group[11] == group[12] == 10 and group[5] == 4

    # benchmark passages: a window of an item anywhere in any row of the id
    items = [windows(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    all_windows = {x for own, _ in items for x in own}
    sizes = {len(x) for x in all_windows}
    holds = lambda w: any(tuple(w[k : k + n]) in all_windows for n in sizes for k in range(len(w) - n + 1))
    bad = {r[0] for r in rows if holds(windows(r[1])[1])}
    got = corpus_pipeline.decontamination(spark, docs, SF)
    assert {30, 31, None} <= bad and 32 not in bad and got.columns == docs.columns and listed(got) == [r for r in rows if r[0] not in bad]

    # personal data: all rows stay, only what the patterns find is replaced
    clean = {40: "write to [EMAIL] or [PHONE] now", 41: "host [IP], card [CARD]."}
    want = [r if r[0] not in clean else (r[0], clean[r[0]], *r[2:4], len(clean[r[0]]), *r[5:]) for r in rows]
    got = corpus_pipeline.personal_data(spark, docs, SF)
    assert got.columns == docs.columns and listed(got) == sorted(want, key=str)

    # packing: every token of every row in exactly one piece
    got = corpus_pipeline.packing(spark, docs, SF).collect()
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = sorted((str(r[0]), len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in got if r["start"] == 0) == sizes
    assert sum(r["length"] for r in got) == sum(n for _, n in sizes)

    # quality: without a usable label all stay; with a model, rows stay or go by their text alone
    got = corpus_pipeline.quality(spark, docs.where("doc_id is null or doc_id >= 40"), SF)
    assert got.columns == docs.columns
    y = np.array([k % 2 for k in range(len(rows))])
    model = Model().fit(features([r[1] for r in rows]), y, steps=50)
    kept = [r for r, p in zip(rows, model.score([r[1] for r in rows]), strict=True) if p >= 0.5]
    assert 0 < len(kept) < len(rows) and listed(corpus_pipeline.accepted(docs, model)) == kept
