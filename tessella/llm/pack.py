"""Packing by lexical retrieval: a sharded BM25 index hands each window the neighbours of its seed.

Documents are tokenised once into staged blocks. Token ids are the index terms; document
frequencies and lengths are counted over the whole corpus. A shard is
``SHARD_BLOCKS`` neighbouring blocks (about 4 million tokens), indexed and packed by
one task, so memory has a bound and the index grows by shards, without any shuffle.
Each window starts with a seed (the rest of a cut document, else the next unused
one); the seed's ``TERMS`` strongest terms query the shard's postings, and the best unused
neighbours fill the window: those that fit whole first, then the best one is cut
to fill it to the last token. A shard's last, partial window is cut at powers of two, so
no sequence needs padding.

Edge cases: null or empty texts are the end id alone; every document, repeated
rows included, is packed once; long documents span many windows; ties go to the
earlier document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import VOCABULARY, corpus_df, staged, unpacked
from .tokens import TOKENIZER, tidy

LENGTH, SHARD_BLOCKS, TERMS, NEIGHBOURS, K1, B = 2048, 4, 12, 16, 1.2, 0.75
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Index:
    """BM25 postings of a shard's documents; terms are token ids."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        place, rank = np.zeros(len(idf), np.int64), np.zeros(len(idf), np.int64)
        terms, weights, of = [], [], []
        self.queries = []
        for k, ids in enumerate(docs):
            n = np.arange(len(ids))
            place[ids] = n
            own = ids[place[ids] == n]
            rank[own] = np.arange(len(own))
            tf = np.bincount(rank[ids], minlength=len(own))
            w = idf[own] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))
            best = own[np.argpartition(-w, TERMS)[:TERMS]] if len(own) > TERMS else own
            self.queries.append(best)
            terms.append(own.astype(np.uint16 if len(idf) <= 1 << 16 else np.uint32))
            weights.append(w.astype(np.float32))
            of.append(np.full(len(own), k, np.int32))
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = np.concatenate(of)[order], np.concatenate(weights)[order]
        self.ends = np.cumsum(np.bincount(term, minlength=len(idf)))
        self.used = np.zeros(len(docs), bool)

    def neighbours(self, seed: int) -> list[int]:
        """Unused documents, best first: at most ``NEIGHBOURS``, and all others on later calls."""
        score = np.zeros(len(self.used), np.float32)
        for t in self.queries[seed].tolist():
            a, b = self.ends[t - 1] if t else 0, self.ends[t]
            score[self.docs[a:b]] += self.weights[a:b]
        score[self.used] = -1
        top = np.argpartition(-score, NEIGHBOURS)[:NEIGHBOURS] if len(score) > NEIGHBOURS else np.arange(len(score))
        return [k for k in sorted(top.tolist(), key=lambda k: (-score[k], k)) if score[k] >= 0]


def windows(sizes: list[int], index: Index, length: int):
    """Windows as lists of (document, start, length); only the last is short."""
    used, left, unused, seed, start = index.used, len(sizes), 0, None, 0
    while left or seed is not None:
        if seed is None:
            while used[unused]:
                unused += 1
            seed, start = unused, 0
            used[seed] = True
            left -= 1
        n = min(length, sizes[seed] - start)
        window, room = [(seed, start, n)], length - n
        first = seed
        seed, start = (seed, start + n) if start + n < sizes[seed] else (None, 0)
        while room and left:
            near = index.neighbours(first)
            rest = []
            for k in near:
                if sizes[k] <= room:
                    window.append((k, 0, sizes[k]))
                    used[k] = True
                    left -= 1
                    room -= sizes[k]
                else:
                    rest.append(k)
            if room and rest:
                k = rest[0]
                window.append((k, 0, room))
                used[k] = True
                left -= 1
                seed, start, room = k, room, 0
        yield window


def at_powers(window: list[tuple[int, int, int]], length: int):
    """A window as sequences that need no padding: itself if full, else one for each power of two in its size."""
    size = sum(n for _, _, n in window)
    if size == length:
        yield window
        return
    pieces = list(reversed(window))
    for power in reversed(range(size.bit_length())):
        if size >> power & 1:
            now, room = [], 1 << power
            while room:
                k, start, n = pieces.pop()
                now.append((k, start, min(n, room)))
                if n > room:
                    pieces.append((k, start + room, n - room))
                room -= min(n, room)
            yield now


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, vocabulary: int = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """A row per piece of ``docs (doc_id, text)``; ``with_ids`` adds the piece's ids (little-endian unsigned 32-bit)."""
    blocks = staged(docs, tokenizer=tokenizer, vocabulary=vocabulary)
    df = corpus_df(blocks, vocabulary)
    n, tokens = blocks.select(F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n, tokens = n or 0, tokens or 0
    idf, mean = np.log1p((n - df + 0.5) / (df + 0.5)), max(1.0, tokens / max(1, n))

    def run(batches):
        part, sequence = TaskContext.get().partitionId(), 0
        kept: list[tuple] = []

        def done():
            nonlocal sequence
            ids = [x for _, xs in kept for x in xs]
            doc_ids = [x for xs, _ in kept for x in xs]
            sizes = [len(x) for x in ids]
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for window in windows(sizes, Index(ids, idf, mean), length):
                for seq in at_powers(window, length):
                    offset = 0
                    for k, start, m in seq:
                        raw = ids[k][start : start + m].astype("<u4").tobytes()
                        for column, x in zip(out, (doc_ids[k], start, m, zlib.crc32(raw), sizes[k], (part << 36) + sequence, offset, raw), strict=False):
                            column.append(x)
                        offset += m
                    sequence += 1
            kept.clear()
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=COLUMNS + ["ids"] * with_ids)

        for b in batches:
            for row in b.select(["doc_ids", "sizes", "ids"]).to_pylist():
                flat = unpacked(row["ids"], vocabulary)
                kept.append((row["doc_ids"], np.split(flat, np.cumsum(row["sizes"])[:-1])))
                if len(kept) == SHARD_BLOCKS:
                    yield done()
            tidy()
        if kept:
            yield done()
        tidy()

    schema = ", ".join(f"{c} long" for c in COLUMNS) + ", ids binary" * with_ids
    return blocks.select("doc_ids", "sizes", "ids").mapInArrow(run, schema)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_pack": op10_pack}
