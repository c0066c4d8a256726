"""Tokens, materialisation and packing: exact round trips."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm.materialise import Permutation, materialise, read_slots
from tessella.llm.pack import pack
from tessella.llm.staging import width
from tessella.llm.tokens import Words, words_of

whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
whole.encode_special_tokens = True
text = st.text(st.sampled_from("aBcÉé́İΣς  .,'s1²\x1c\x85\xa0ßﬁ!?日\n😀<|>ªµǅKJ̌\x00") | st.characters(exclude_categories=["Cs"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(text, max_size=8))
def test_ids(texts):
    ids, at = words_of().encode([*texts, None])
    for k, x in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == whole.encode(x, add_special_tokens=False).ids
    assert at[-1] == at[-2] == len(ids)


def test_small_store():
    w = Words(public_tokenizers.path("word_bpe_49k.json"), capacity=20)
    for a in range(5):
        texts = [f"alpha{a}{k} beta{k}. Gamma, é{k}" for k in range(30)]
        ids, at = w.encode(texts)
        assert all(ids[at[k] : at[k + 1]].tolist() == whole.encode(x, add_special_tokens=False).ids for k, x in enumerate(texts))


def test_permutation():
    for n in (1, 2, 3, 1000, 4097):
        p = Permutation(n, 9)
        s = p.slot(np.arange(n))
        assert sorted(s.tolist()) == list(range(n)) and (p.number(s) == np.arange(n)).all()
    assert (Permutation(1000, 1).slot(np.arange(1000)) != Permutation(1000, 2).slot(np.arange(1000))).any()


def test_materialise(spark, awkward, nothing, tmp_path):
    folder = f"file://{tmp_path}/shards"
    docs = awkward.repartition(3)
    rows = sorted(materialise(docs, folder, length=64, shard_slots=16).collect())
    assert [r["slot"] for r in rows] == list(range(len(rows))) and sorted(r["sequence"] for r in rows) == list(range(len(rows)))
    data = read_slots(folder, 0, len(rows), 64, 16)
    assert data.dtype == np.dtype(width(49408)) and (read_slots(folder, 5, 20, 64, 16) == data[5:25]).all()
    assert all(zlib.crc32(data[r["slot"]].tobytes()) == r["shard_crc32"] and r["n_tokens"] == sum(r["doc_tokens"]) for r in rows)
    got = {}
    for r in sorted(rows, key=lambda r: r["sequence"]):
        a = 0
        for doc, n in zip(r["doc_ids"], r["doc_tokens"], strict=True):
            got.setdefault(doc, []).extend(data[r["slot"]][a : a + n].tolist())
            a += n
    want = {}
    for r in awkward.collect():
        want.setdefault(r["doc_id"], []).extend([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    assert got == want
    assert materialise(nothing, f"file://{tmp_path}/none").collect() == []


def test_pack(spark, awkward, nothing):
    extra = spark.createDataFrame([(k, f"shared topic {k % 7} " * (k % 90), "n") for k in range(100, 400)], awkward.schema)
    docs = awkward.unionByName(extra)
    rows = pack(docs, length=256, with_ids=True).collect()
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    sequences, pieces = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids.tolist(), r["doc_tokens"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0 and at < 256
    for doc, texts in want.items():
        assert sum(len(p) for _, p, _ in pieces[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            assert sum((p for _, p, _ in sorted(pieces[doc])), []) == texts[0] and {n for _, _, n in pieces[doc]} == {len(texts[0])}
    assert pack(nothing).collect() == []
