"""Alignment against plain loops over whole texts."""

import functools
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessella.llm import align

second = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
first.encode_special_tokens = True
_other = iter(range(256, 512))
BYTE = {chr(b if b in range(33, 127) or b in range(161, 173) or b in range(174, 256) else next(_other)): b for b in range(256)}


def tokens(text):
    a = first.encode(" " + text, add_special_tokens=False).ids
    raw_a = [bytes(BYTE[c] for c in first.id_to_token(i)) for i in a]
    b = second.encode(text)
    raw_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return [], [], [], []
    ends = lambda raw: [sum(map(len, raw[: k + 1])) for k in range(len(raw))]
    return a, ends(raw_a), b, ends(raw_b)


def plain(texts):
    found = []
    for text in texts:
        a, ends_a, b, ends_b = tokens(text) if text else ([], [], [], [])
        groups, start = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(a, ends_a) if start < e <= end], [i for i, e in zip(b, ends_b) if start < e <= end]))
            start = end
        found.append((len(a), len(b), groups, [(x, y) for g in groups for x in g[0] for y in g[1]]))
    count = Counter(p for f in found for p in set(f[3]))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for n_a, n_b, groups, links in found:
        written = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        sha = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha, written))
    return out


@pytest.mark.parametrize("head", [align.HEAD, 3])
def test_aligned(spark, awkward, nothing, monkeypatch, head):
    monkeypatch.setattr(align, "HEAD", head)
    rows = [r["text"] for r in awkward.collect() if len(r["text"] or "") < 1000]
    rows += [f"Éréier the enqueeau de, {k} <|endoftext|> it is thouinor😀 {'-' * k} nd\nedston" for k in range(40)] + ["-" * 700, "日本語" * 40, "a▁b", "  two   spaces ", "\x1c \xa0x", "it's we'll 12.5%"]
    docs = spark.createDataFrame([(k % 17, x, "n") for k, x in enumerate(rows)], "doc_id long, text string, n_a string").repartition(3)
    order = [r["text"] for r in docs.collect()]
    got = sorted(map(tuple, align.aligned(docs, with_groups=True).drop("doc_id").collect()))
    assert got == sorted(plain(order))
    assert align.aligned(nothing).collect() == []


def test_a_store_that_is_too_small(awkward):
    """Places of a block stay valid when the store is emptied on the way."""
    from tessella.llm.pieces import TwoWays

    large, small = TwoWays(), TwoWays(capacity=40)
    texts = [f"word{k} and {k * 7} more, thouinor{k}." * 3 for k in range(60)]
    for store in (large, small):
        ids, sizes, order, counts = store.units(texts)
        starts = np.cumsum(sizes) - sizes
        found, at = [], 0
        for n in counts:
            whole = np.concatenate([ids[starts[u] : starts[u] + sizes[u]] for u in order[at : at + n]])
            found.append([i for i in whole.tolist() if i < store.first])
            at += n
        assert found == [first.encode(" " + x, add_special_tokens=False).ids for x in texts]


def test_blocks_do_not_matter(spark, awkward):
    docs = awkward.select("doc_id", "text")
    one = align.grouped(align.tokenised(docs.coalesce(1))).selectExpr("size(docs) as n").collect()
    many = align.grouped(align.tokenised(docs.coalesce(1), block=50)).selectExpr("size(docs) as n").collect()
    assert sum(r["n"] for r in one) == sum(r["n"] for r in many) == docs.count() and len(many) > len(one)
    rows = align.aligned(docs).collect()
    long = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() and long[7]["n_links"] > 0 and long[1]["groups_sha256"] == "" and long[1]["n_a"] == 0


def test_counts_join_once_for_each_pair_of_a_block(spark, monkeypatch):
    # many documents and units of a block share pairs; blocks of a few documents, several of them in a task
    rows = [f"the enqueeau of, {k % 7} it's {'-' * (k % 5)} the of the{k % 3}x" for k in range(60)] + ["a▁b", None, " ", "日本語 the of"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2).localCheckpoint()
    small = functools.partial(align.tokenised, block=500)
    blocks = align.grouped(small(docs)).localCheckpoint()
    held = [r["pairs"] for r in blocks.collect()]
    assert len(held) > 6 and all(len(p) == len(set(p)) for p in held)
    counts = align.counted(blocks).localCheckpoint()
    assert align.valued(blocks, counts).count() == sum(map(len, held)) < 0.5 * sum(f[3] for f in plain([x or "" for x in rows]))
    monkeypatch.setattr(align, "tokenised", small)
    order = [r["text"] for r in docs.collect()]
    assert sorted(map(tuple, align.aligned(docs, with_groups=True).drop("doc_id").collect())) == sorted(plain(order))


def test_packed():
    for x in ([], [0], [5, 0, 1 << 40, 255, 256], list(range(1000))):
        assert align.unpacked(align.packed(np.array(x, np.int64))).tolist() == x
