"""N-gram Jaccard join by prefix filtering under several global token orders.

Tokens are a document's distinct word shingles. In any global order, two sets of
similarity t share one of their first n - ceil(t n) + 1 tokens. ``ORDERS`` orders are
used: each puts common tokens last, by classes that a table of fixed size holds (its
errors can change an order but never a result), and breaks ties by its own hash.
Candidates meet under the first order and pass the length and positional filters: if
a token is the first that two sets share, no token before it counts towards their
overlap. They must then share a prefix token under each of the other orders as well;
only the texts of pairs that pass all orders are fetched and compared.

1. A sample of every document's tokens is counted; tokens frequent in it are common.
   A second pass writes each document's set size, fingerprint and prefixes: 64-bit
   tokens for the first order, 32-bit ones (which can only let more pass) for the others.
   Documents with equal sets are one class from here on.
2. Prefix tokens are sorted by token and their place in the document's order. In a
   bucket, every document meets the ``PIVOTS`` that have it earliest: all pairs of a small
   bucket, linear work in a large one. Buckets of very common tokens (class ``HOT`` and
   above) are dealt by token and document over several tasks, each with pivots of its own.
3. Verified links join into components. Large buckets then hold mostly one
   component; only documents outside a bucket's main component are new pivots, and only
   pairs of different components are compared, in rounds of at most about ``ROUND_PAIRS``
   pairs, until no bucket holds a pair that is neither compared nor already joined.
   So no link between components is lost, and no group of near copies is paired in full.
4. Components come from the distributed graph step.

Sets are compared by 64-bit hashes of their shingles. Texts travel compressed, and only
those of candidates. Nothing that grows with the corpus is collected or broadcast
without a check of its size.

Edge cases: null, empty or wordless texts have no tokens and link with nothing; a text
of fewer words than a shingle is one token; repeated rows are equal sets; rows that
share a doc_id are one node; null ids are returned with null components; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shingles import lowered, mix, shingle_sets
from .store import mark, small, sweep, written
from .tokens import tidy

ORDERS, PIVOTS, TABLE_BITS, SAMPLE_PERCENT, COMMON, GROWTH = 3, 12, 22, 12, 2, 16
BROADCAST_IDS = 500_000
HOT, ROUND_PAIRS = 10, 50_000_000
_OTHERS = [f"p{k}" for k in range(1, ORDERS)]


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def common_tokens(docs: DataFrame, k: int, bits: int = TABLE_BITS) -> np.ndarray:
    """How common tokens are, as a class by the low bits of their hash (0: not common); ``2**bits`` bytes at any size.

    Counted are ``SAMPLE_PERCENT`` percent of each document's tokens, those with the smallest hashes of a kind that differs between sets.
    """
    size = 1 << bits

    def sample(batches):
        for b in batches:
            texts = b.column("text")
            for a in range(0, b.num_rows, 500):
                out = []
                for x in shingle_sets([lowered(t) for t in texts.slice(a, 500).to_pylist()], k):
                    keep = len(x) * SAMPLE_PERCENT // 100 + 1
                    own = mix(x ^ np.bitwise_xor.reduce(mix(x, 7)), 77) if keep < len(x) else x
                    out.append(x[np.argpartition(own, keep)[:keep]] if keep < len(x) else x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["token"])
            tidy()

    def table(batches):
        top = np.zeros(size, np.uint8)
        for b in batches:
            at, of = b.column("bucket").to_numpy(), b.column("class").to_numpy()
            np.maximum.at(top, at, of.astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([_pack(top)], pa.binary())], names=["top"])

    counts = docs.select("text").mapInArrow(sample, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    classes = counts.select(F.col("token").bitwiseAND(size - 1).alias("bucket"), F.floor(F.log2("n")).alias("class"))
    tops = classes.groupBy("bucket").agg(F.max("class").alias("class")).repartition(16).mapInArrow(table, "top binary")
    out = np.zeros(size, np.uint8)
    for row in tops.toLocalIterator():
        out = np.maximum(out, np.frombuffer(zstandard.decompress(bytes(row["top"])), np.uint8))
    return out


def _prefix(tokens: np.ndarray, classes: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The tokens of a set that are first in an order, in that order; at least one of them is in any set similar enough."""
    n = len(tokens)
    keep = n - -(-percent * n // 100) + 1
    rank = mix(tokens, order + 1) >> np.uint64(8)
    rank |= classes[(tokens & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
    at = np.argpartition(rank, keep - 1)[:keep] if keep < n else np.arange(n)
    return tokens[at[np.argsort(rank[at])]]


def _near(a: int, b: int, percent: int) -> bool:
    return 100 * min(a, b) >= percent * max(a, b)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def described(docs: DataFrame, k: int, percent: int, classes) -> DataFrame:
    """A written table ``(doc_id, n, f1, f2, prefix, p1, p2)``; the prefix is under the first order, the arrays are under the others."""

    def run(batches):
        table = np.frombuffer(zstandard.decompress(classes.value), np.uint8)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                c = b.slice(a, 500)
                sets = shingle_sets([lowered(x) for x in c.column("text").to_pylist()], k)
                n = pa.array([len(x) for x in sets], pa.int64())
                with np.errstate(over="ignore"):
                    f = [np.array([mix(x, seed).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64) for seed in (101, 102)]
                prefix = pa.array([_prefix(x, table, 0, percent).tobytes() if len(x) else None for x in sets], pa.binary())
                others = [_lists([(_prefix(x, table, o, percent) >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(x) else np.zeros(0, np.int32) for x in sets]) for o in range(1, ORDERS)]
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), n, pa.array(f[0]), pa.array(f[1]), prefix, *others], names=["doc_id", "n", "f1", "f2", "prefix", *_OTHERS])
            tidy()

    schema = "doc_id long, n long, f1 long, f2 long, prefix binary, " + ", ".join(f"{p} array<int>" for p in _OTHERS)
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "sets")


def _buckets(reps: DataFrame, percent: int, pivots: int, classes) -> DataFrame:
    """Written ``(a, b, token, n, i)``: candidate pairs (token null), and (b null) documents of large buckets that did not meet all others."""

    def explode(batches):
        table = np.frombuffer(zstandard.decompress(classes.value), np.uint8)
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                c = b.slice(a, 1000)
                rows = [np.frombuffer(x, np.int64) for x in c.column("prefix").to_pylist()]
                sizes = np.fromiter(map(len, rows), np.int64, len(rows))
                token = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                of = [np.repeat(c.column(x).to_numpy(zero_copy_only=False), sizes) for x in ("doc_id", "n")]
                common = table[token & (len(table) - 1)].astype(np.int64)
                hot = common >= HOT
                share = mix(of[0].astype(np.int64).view(np.uint64), 55) & ((np.uint64(1) << np.maximum(common - HOT + 1, 0).astype(np.uint64)) - np.uint64(1))
                deal = np.where(hot, mix(token.view(np.uint64) + share, 56).view(np.int64), token)
                yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(token), *map(pa.array, of), pa.array(place.astype(np.int32)), pa.array(hot)], names=["deal", "token", "doc", "n", "i", "hot"])

    def meet(batches):
        # rows come sorted by bucket; of the bucket being read only its pivots are kept
        carry = [np.zeros(0, np.int64)] * 6
        for b in batches:
            own = [b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("deal", "doc", "n", "i", "token", "hot")]
            if not len(own[0]):
                continue
            if len(carry[0]) and carry[0][0] != own[0][0]:
                carry = [x[:0] for x in carry]
            old = len(carry[0])
            t, d, n, i, token, hot = (np.concatenate([x, y]) for x, y in zip(carry, own, strict=True))
            begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            size = np.diff(np.concatenate([begin, [len(t)]]))
            start = np.repeat(begin, size)
            place, fresh = np.arange(len(t)) - start, np.arange(len(t)) >= old
            found = []
            for p in range(min(pivots, int(size.max()) - 1)):
                y = np.flatnonzero((place > p) & fresh)
                x = start[y] + p
                possible = np.minimum(n[x] - i[x], n[y] - i[y]) * (100 + percent) >= percent * (n[x] + n[y])
                x, y = x[possible], y[possible]
                found.append(np.stack([np.minimum(d[x], d[y]), np.maximum(d[x], d[y])], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            big = np.flatnonzero(((place >= pivots) | (hot == 1)) & fresh)
            carry = [x[begin[-1] : begin[-1] + pivots] for x in (t, d, n, i, token, hot)]
            m, k = len(pairs), len(big)
            none, late = np.zeros(m, np.int64), np.arange(m + k) >= m
            columns = [pa.array(np.concatenate([pairs[:, 0], d[big]])), pa.array(np.concatenate([pairs[:, 1], big]), mask=late)]
            columns += [pa.array(np.concatenate([none, x[big]]), mask=~late) for x in (token, n, i)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "token", "n", "i"])

    tokens = reps.select("doc_id", "n", "prefix").mapInArrow(explode, "deal long, token long, doc long, n long, i int, hot boolean")
    dealt = tokens.repartition("deal").sortWithinPartitions("deal", "i", F.xxhash64("doc"), "doc")
    return written(dealt.mapInArrow(meet, "a long, b long, token long, n long, i long"), "buckets")


def _of_candidates(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows ``(doc_id, ..)`` of documents that are in a pair."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return rows.join(small(ids, BROADCAST_IDS), F.col("doc_id") == F.col("id"), "left_semi")


def intersected(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Written: those of the pairs ``(a, b)`` that share a prefix token under every other order too."""
    own = _of_candidates(sets.select("doc_id", *_OTHERS), pairs)
    both = pairs.join(own.select(F.col("doc_id").alias("b"), *[F.col(p).alias(f"{p}_b") for p in _OTHERS]), "b")
    both = both.join(own.select(F.col("doc_id").alias("a"), *_OTHERS), "a")
    for p in _OTHERS:
        both = both.where(F.arrays_overlap(p, f"{p}_b"))
    return written(both.select("a", "b").distinct(), "candidates")


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough, by exact comparison; texts are those of ``docs``."""

    def zipped(batches):
        for b in batches:
            text = [zstandard.compress(lowered(x), 1) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.binary())], names=["id", "z"])

    named = _of_candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), pairs)
    texts = written(named.mapInArrow(zipped, "id long, z binary"), "texts")

    def compare(batches):
        last, own = None, None
        for batch in batches:
            a = batch.column("a").to_pylist()
            za, zb = batch.column("za"), batch.column("zb")
            keep = np.zeros(len(a), bool)
            for at in range(0, len(a), 200):
                theirs = shingle_sets([zstandard.decompress(x) for x in zb.slice(at, 200).to_pylist()], k)
                for j, y in enumerate(theirs, at):
                    z = za[j].as_py()
                    if z != last:
                        last, own = z, shingle_sets([zstandard.decompress(z)], k)[0]
                    if not len(own) or not len(y) or not _near(len(own), len(y), percent):
                        continue
                    both = len(np.intersect1d(own, y, assume_unique=True))
                    keep[j] = 100 * both >= percent * (len(own) + len(y) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])
            tidy()

    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a")
    return both.select("a", "b", "za", "zb").mapInArrow(compare, "a long, b long")


def _quota(main: DataFrame, wanted: int) -> int:
    """How many new pivots a bucket may have, so that a round's pairs stay about ``ROUND_PAIRS``; 0 if none is left to take."""
    quotas = [1]
    while quotas[-1] < wanted:
        quotas.append(min(4 * quotas[-1], wanted))
    row = main.agg(*[F.sum(F.least(F.lit(q), "outside") * F.col("total")) for q in quotas]).first()
    if not row[0]:
        return 0
    return max([q for q, m in zip(quotas, row, strict=True) if m <= ROUND_PAIRS], default=1)


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs (doc_id, text)``; links have Jaccard >= percent / 100."""
    spark, since = docs.sparkSession, mark()
    docs = docs.select("doc_id", "text")
    classes = spark.sparkContext.broadcast(_pack(common_tokens(docs, k)))  # at most 2**TABLE_BITS bytes
    sets = described(docs, k, percent, classes)
    full = sets.where("n > 0 and doc_id is not null")
    heads = full.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"))
    reps = full.join(heads.select(F.col("rep").alias("doc_id"), "f1", "f2", "n"), ["doc_id", "f1", "f2", "n"], "left_semi")
    met = _buckets(reps, percent, PIVOTS, classes)
    candidates = intersected(written(met.where("token is null").select("a", "b").distinct(), "pairs"), sets)
    links = written(verified(docs, candidates, k, percent), "links")
    # copies are tied to their class, so that rows that share an id tie their classes together
    ties = full.join(heads, ["f1", "f2", "n"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    shared = written(ties.distinct(), "ties")
    found = written(components(links.unionByName(shared)), "found")
    big, wanted = met.where("token is not null").select("token", F.col("a").alias("doc"), "n", "i"), PIVOTS * GROWTH
    while True:
        rows = big.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        sizes = rows.groupBy("token", "component").agg(F.count("*").alias("m"))
        main = sizes.groupBy("token").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.sum("m").alias("total"), (F.sum("m") - F.max("m")).alias("outside"))
        main = written(main.where("outside > 0"), "main")
        if not (quota := _quota(main, wanted)):
            break
        rows = written(rows.join(small(main.select("token", "main")), "token").select("token", "doc", "n", "i", "component", "main"), "large")
        outside = rows.where("component <> main").withColumn("r", F.expr("row_number() over (partition by token order by i, xxhash64(doc), doc)"))
        picked = written(outside.where(F.col("r") <= quota).select(F.col("token").alias("pt"), F.col("doc").alias("p"), F.col("n").alias("pn"), F.col("i").alias("pi"), F.col("component").alias("pc")), "pivots")
        possible = F.least(F.col("n") - F.col("i"), F.col("pn") - F.col("pi")) * (100 + percent) >= percent * (F.col("n") + F.col("pn"))
        apart = rows.join(small(picked), (F.col("token") == F.col("pt")) & (F.col("component") != F.col("pc")) & possible)
        pairs = written(apart.select(F.least("doc", "p").alias("a"), F.greatest("doc", "p").alias("b")).distinct(), "pairs")
        if pairs.head(1):
            links = written(links.unionByName(verified(docs, intersected(pairs, sets), k, percent)), "links")
            found = written(components(links.unionByName(shared)), "found")
        done = picked.select(F.col("pt").alias("token"), F.col("p").alias("doc"))
        big, wanted = rows.join(small(done), ["token", "doc"], "left_anti").select("token", "doc", "n", "i"), min(quota * GROWTH, 1 << 20)
    sweep(spark, since, [sets, found])
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_jaccard": op9_jaccard}
ORACLE_SQL = {
    "op9_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY ALL),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""
}
