"""Piece encoding and decoding against the library; units of both tokenizers against whole texts."""

import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessella.llm.codec import decoded, encoded, op11_pieces
from tessella.llm.pieces import Units, between_pieces, between_runs, piece_model, piece_units, readable

library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
text = st.text(st.sampled_from("aBcthe  \n\t.,'s1²\x1c\x85\xa0ßﬁ!?日😀<|>▁-=éouin 　\x00") | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(text, max_size=6))
def test_ids(texts):
    ids, at = piece_units().encode([*texts, None])
    for k, x in enumerate(texts):
        want = library.encode(x)
        assert ids[at[k] : at[k + 1]].tolist() == want and piece_model().decode(want) == library.decode(want)
    assert at[-1] == at[-2] == len(ids)


def test_backtracking_alone():
    """Whole texts without units, among them long runs in which the longest piece is often wrong."""
    for x in ("-" * 5000, "= " * 300 + "=" * 777, "ab" * 3000, "x" * 20_000, " " * 3001 + "a", "thethethe" * 500, "日本😀" * 400, "\n" * 99, "<s></s><0x0A>▁ ▁"):
        assert piece_model().encode("▁" + x.replace(" ", "▁")) == library.encode(x), x[:20]


def test_small_stores():
    small = Units(32_000, between_pieces([]), lambda xs: [library.encode(x) for x in xs], capacity=20)
    assert small.encode(["ab cd ef", "ab"])[0].dtype.kind == "u"
    pieces, cut = piece_model(), piece_units().cut
    own = Units(32_000, cut, lambda xs: [pieces.encode(x.replace(" ", "▁")) for x in xs], capacity=20)
    for a in range(4):
        texts = [f"alpha{a}{k} beta{k}. Gamma, é{k}" for k in range(30)]
        ids, at = own.encode(texts)
        assert all(ids[at[k] : at[k + 1]].tolist() == library.encode(x) for k, x in enumerate(texts))


byte_level = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
byte_level.encode_special_tokens = True
byte_units = Units(50_257, between_runs, lambda xs: [e.ids for e in byte_level.encode_batch_fast(xs, add_special_tokens=False)])


@settings(max_examples=400, deadline=None)
@given(st.lists(text, max_size=6))
def test_byte_level_units(texts):
    ids, at = byte_units.encode(texts)
    for k, x in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == (byte_level.encode(" " + x, add_special_tokens=False).ids if x else [])


def test_invalid_bytes():
    ids = [library.piece_to_id(x) for x in ("▁a", "<0xC3>", "<0xFF>", "b", "</s>")]
    assert piece_model().decode(ids) == library.decode(ids) == "a��b" and readable(b" \xe6\x97") == "��"


def test_tables(spark, awkward, nothing, tmp_path):
    rows = decoded(encoded(awkward.repartition(3))).collect()
    want = sorted((str(r["doc_id"]), library.encode(r["text"] or "") + [2]) for r in awkward.collect())
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == want and all(r["text"] == library.decode(r["ids"]) for r in rows)
    assert encoded(nothing).collect() == [] and decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["text"] is None
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op11_pieces(spark, str(tmp_path)).collect(), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == sorted([(r["doc_id"], len(r["ids"]), sha(" ".join(map(str, r["ids"]))), sha(r["text"])) for r in rows], key=str)
