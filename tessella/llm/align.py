"""Alignment of two tokenizers over the bytes of the same text.

A map tokenises each text twice. Both tokenizers end a token between two *units* of a text (about a word with the
white space before it), so what repeats in a block of documents is aligned once: the ends that tokens of both share cut the
tokens of the block's distinct units into groups, and each A-B pair of ids of a group
is a link, counted as often as it occurs but listed once, so a long stretch without a common end makes no more rows
than it has distinct pairs. These are a few array operations over all units of a block at once. A block is written as its documents,
its distinct pairs, how many of its documents hold each, and, packed, the units of its documents and the links of its units, by number.

How many documents hold a pair is a sum over blocks, with map-side parts. Counts
go back to the blocks' distinct pairs, not to links, in two ways: pairs with more than 1/``HEAD`` of all counts (there can't be ``HEAD`` of them) are
broadcast, so no frequent pair meets in one task; the others are joined by pair. The best count of an A id is a table of the vocabulary's size.
A document's sums are over its units, in a map over the blocks joined with their pairs' counts.

Edge cases: texts that are null or empty, or whose joined bytes of either tokenizer are not those of a space and the text
(a text that itself holds the piece model's space mark), have no tokens: zeros and an empty string. Rows that
repeat, or share an id, are documents of their own. Null ids stay. Special tokens' strings are plain text. An empty table gives no rows. Other columns, whatever
their names, are ignored. Texts are taken whole; one that is longer than a block is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import BYTES, PIECES, two_ways
from .store import mark, sweep, written
from .tokens import tidy

HEAD, BLOCK = 65_536, 1 << 21
#: Bits of an id in a pair.
BITS = 24
#: Documents whose pairs are counted at a time.
SLICE = 64
TOKENS = "block long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_links:long,n_units:int,groups:string>>, pairs array<long>, held array<long>, units binary, sizes binary, links binary, times binary"
SUMS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte by byte of equal weight, compressed."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T.copy().view("<i8").ravel() if n else np.zeros(0, np.int64)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, one stretch after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def written_tokens(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all groups in a row, and where each token's text begins, with the end."""
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    at_a, at_b = np.arange(len(a)) + _starts(n_b)[group_a], np.arange(len(b)) + np.cumsum(n_a)[group_b]
    token, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    token[at_a], token[at_b] = a, b
    mark[at_a[np.cumsum(n_a) - 1]], mark[at_b[np.cumsum(n_b) - 1]] = ord("|"), ord(";")
    width = np.ones(len(token), np.int64)
    for k in range(1, 8):
        width += token >= 10**k
    starts = _starts(width + 1)
    out = np.empty(starts[-1], np.uint8)
    out[starts[1:] - 1] = mark
    for k in range(int(width.max(initial=0))):
        some = np.flatnonzero(width > k)
        out[starts[some + 1] - 2 - k] = 48 + token[some] // 10**k % 10
    return out.tobytes(), starts


def links_of(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(group, pair, times)``: the distinct pairs of each group, in the groups' order, with how often each occurs there."""

    def distinct(ids: np.ndarray, group: np.ndarray):
        keys, times = np.unique(group << BITS | ids, return_counts=True)
        return keys >> BITS, keys & ((1 << BITS) - 1), times

    (of_a, own_a, m_a), (of_b, own_b, m_b) = distinct(a, group_a), distinct(b, group_b)
    n_b = np.bincount(of_b, minlength=groups)
    i = np.repeat(np.arange(len(own_a)), n_b[of_a])
    j = _within(_starts(n_b)[of_a], n_b[of_a])
    return of_a[i], own_a[i] << BITS | own_b[j], m_a[i] * m_b[j]


def tokenised(docs: DataFrame, a: str = BYTES, b: str = PIECES, block: int = BLOCK) -> DataFrame:
    """Blocks of ``docs (doc_id, text)``, about ``block`` characters each: documents with their groups as text, distinct pairs with the number of documents that hold them, units of documents, links of units."""

    def run(batches):
        store, part, number = two_ways(a, b), TaskContext.get().partitionId() << 33, 0
        size = np.array([len(x) for x in store.raw], np.int64)
        kept: list[tuple] = []

        def done():
            nonlocal number
            ids, sizes, order, counts = store.units([text for _, text in kept])
            n, second = len(sizes), ids >= store.first
            of = np.repeat(np.arange(n), sizes)
            n_b = np.bincount(of[second], minlength=n).astype(np.int64)
            n_a = sizes - n_b
            bad = _starts((sizes == 0)[order])
            stops = np.cumsum(counts)
            good = bad[stops] == bad[stops - counts]
            order, counts = order[np.repeat(good, counts)], np.where(good, counts, 0)
            # a unit's tokens have the same bytes in both, so ends in the row of all units are comparable
            first, other = ids[~second], ids[second] - store.first
            ends_a, ends_b = np.cumsum(size[first]), np.cumsum(size[ids[second]])
            common = np.intersect1d(ends_a, ends_b, assume_unique=True)
            group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
            text, begin = written_tokens(first, other, group_a, group_b, len(common))
            begin = begin[_starts(sizes)].tolist()
            texts = [text[x:y] for x, y in zip(begin[:-1], begin[1:], strict=True)]
            group, pair, times = links_of(first, other, group_a, group_b, len(common))
            unit = of[~second][np.searchsorted(ends_a, common)]  # of each group
            links = np.bincount(unit[group], minlength=n)
            pairs, at = np.unique(pair, return_inverse=True)
            start, own = _starts(links), _starts(counts)
            n_links = np.diff(_starts(times)[start])
            held = np.zeros(len(pairs), np.int64)
            for s in range(0, len(kept), SLICE):
                t = min(s + SLICE, len(kept))
                # each unit once a document, then each pair once a document
                doc, x = np.divmod(np.unique(np.repeat(np.arange(t - s), counts[s:t]) * n + order[own[s] : own[t]]), max(n, 1))
                once = np.unique(np.repeat(doc, links[x]) * len(pairs) + at[_within(start[x], links[x])])
                held += np.bincount(once % max(len(pairs), 1), minlength=len(pairs))
            totals = [np.diff(_starts(x[order])[own]) for x in (n_a, n_b, n_links)]
            joined = [b"".join(map(texts.__getitem__, order[s:t].tolist()))[:-1] for s, t in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
            docs = pa.StructArray.from_arrays(
                [pa.array([k for k, _ in kept], pa.int64()), *map(pa.array, totals), pa.array(counts.astype(np.int32)), pa.array(joined, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_a", "n_b", "n_links", "n_units", "groups"],
            )
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (docs, pa.array(pairs), pa.array(held))]
            out = pa.RecordBatch.from_arrays([pa.array([part + number]), *lists, *(pa.array([packed(x)], pa.binary()) for x in (order, links, at, times))], names=["block", "docs", "pairs", "held", "units", "sizes", "links", "times"])
            number += 1
            kept.clear()
            return out

        held = 0
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                c = batch.slice(s, 500)
                for doc_id, text in zip(c.column("doc_id").to_pylist(), c.column("text").to_pylist(), strict=True):
                    text = None if text and "\u2581" in text else text  # the second tokenizer takes the mark for a space
                    n = len(text or "")
                    if kept and held + n > block:
                        yield done()
                        tidy()
                        held = 0
                    kept.append((doc_id, text))
                    held += n + 64
            tidy()
        if kept:
            yield done()
        tidy()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, TOKENS)


def grouped(blocks: DataFrame, with_groups: bool = False) -> DataFrame:
    """``tokenised`` blocks, with the number of each document's groups and their hash in place of (or beside) their text."""

    def doc(d):
        text, none = d["groups"], d["groups"] == ""
        n = F.when(none, F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(";"))) + 1).cast("long")
        sha = F.when(none, F.lit("")).otherwise(F.sha2(text, 256))
        more = [text.alias("groups")] if with_groups else []
        return F.struct(*[d[c].alias(c) for c in ("doc_id", "n_a", "n_b")], n.alias("n_groups"), *[d[c].alias(c) for c in ("n_links", "n_units")], sha.alias("groups_sha256"), *more)

    return blocks.withColumn("docs", F.transform("docs", doc))


def counted(blocks: DataFrame) -> DataFrame:
    """``(pair, n, best)`` of ``blocks (pairs, held)``: how many documents hold a pair, and whether no other pair of its A id has more."""
    counts = written(blocks.select(F.inline(F.arrays_zip("pairs", "held"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n")), "pairs")
    highest = counts.groupBy(F.shiftright("pair", BITS).alias("a")).agg(F.max("n").alias("most"))
    both = counts.join(F.broadcast(highest), F.shiftright("pair", BITS) == F.col("a"))  # at most a row for each id of A's vocabulary
    return both.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def valued(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """``(block, place, n, best)`` of each pair of ``blocks (block, pairs)``, by its place there."""
    whole = counts.agg(F.sum("n")).first()[0] or 0
    head, tail = counts.where(F.col("n") > whole / HEAD), counts.where(F.col("n") <= whole / HEAD)
    each = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    frequent = each.join(F.broadcast(head), "pair")
    rare = each.join(F.broadcast(head.select("pair")), "pair", "left_anti").join(tail, "pair")
    return frequent.unionByName(rare).select("block", "place", "n", "best")


def summed(blocks: DataFrame, with_groups: bool = False) -> DataFrame:
    """A row for each document of ``blocks (block, docs, units, sizes, links, times, v)``, v with place, n and best of the block's pairs."""
    names = ["n_best", "count_sum"]
    more = ["groups"] if with_groups else []

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                docs, v = batch.column("docs").slice(k, 1).flatten(), batch.column("v").slice(k, 1).flatten()
                units, sizes, at, times = (unpacked(batch.column(c)[k].as_py()) for c in ("units", "sizes", "links", "times"))
                place = v.field("place").to_numpy(zero_copy_only=False)
                n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                n[place], best[place] = v.field("n").to_numpy(zero_copy_only=False), v.field("best").to_numpy(zero_copy_only=False)
                fields = {c: docs.field(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_units", "groups_sha256", *more)}
                own, start = _starts(fields["n_units"].to_numpy(zero_copy_only=False)), _starts(sizes)
                for c, x in zip(names, (best, n), strict=True):
                    each = np.diff(_starts(x[at] * times)[start])  # of each unit
                    fields[c] = pa.array(np.diff(_starts(each[units])[own]))
                out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", *names, "groups_sha256", *more]
                yield pa.RecordBatch.from_arrays([fields[c] for c in out], names=out)
        tidy()

    return blocks.mapInArrow(run, SUMS + (", groups string" if with_groups else ""))


def aligned(docs: DataFrame, a: str = BYTES, b: str = PIECES, with_groups: bool = False) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; ``with_groups`` adds the groups as text."""
    since = mark()
    blocks = written(grouped(tokenised(docs, a, b), with_groups), "blocks")
    counts = written(counted(blocks), "counts")
    values = written(valued(blocks, counts).groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("v")), "values")
    sweep(docs.sparkSession, since, [blocks, values])
    none = F.array().cast("array<struct<place:int,n:bigint,best:boolean>>")
    each = blocks.select("block", "docs", "units", "sizes", "links", "times").join(values, "block", "left").withColumn("v", F.coalesce("v", none))
    return summed(each, with_groups)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_align": op13_align}
