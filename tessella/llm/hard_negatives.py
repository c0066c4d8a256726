"""Hard negatives by product quantisation with rigorous bounds.

Vectors are cut into stretches of ``SUB`` components; each stretch is replaced by the nearest of up to
``CENTROIDS`` centroids, which are fitted on at most ``SAMPLE`` rows. The index holds, for every row, the centroids' numbers, the length of
what each stretch leaves (its residual), and the integer components. An anchor's inner product with a row is the sum of looked-up products with
the centroids, give or take the sum over the stretches of the lengths of the anchor's stretch and of the residual (Cauchy-Schwarz).
So a row whose upper bound is under the fifth best lower bound so far, or whose bounds lie outside a window, is
no result, and only the others' inner products are computed, in exact integers. No result can be missed: recall is 1, whatever the sample.

Anchors are broadcast in blocks of about ``ANCHORS``; each block takes two scans of the index, one for the positives and one
for the windows below them. A task keeps five rows for an anchor (or for one of its windows), and so does the step that brings the tasks' together.
The result equals that of comparing each anchor with all rows.

Edge cases: rows whose label or vector is null, or with a null or non-finite component, take no part. Rows that repeat, or
share an id, are rows of their own: each may be another's positive, and repeated anchors give repeated results. Null ids come last in ties and are
no anchors. Vectors are compared only with those of their length; empty ones have inner products of 0. Anchors with fewer rows have fewer
results; a negative positive score has an empty window. Inner products beyond a bigint count as the largest or smallest bigint.
An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import mark, sweep, written
from .tokens import tidy

SUB, CENTROIDS, SAMPLE, SAMPLE_BYTES, STEPS, ANCHORS, TILE, BEST = 4, 256, 8192, 1 << 26, 6, 4096, 256, 5
INDEX = "row long, vec_id long, label long, dim int, q binary, codes binary, rest binary"
_TOP = np.iinfo(np.int64).max


def integers(vector: list | None) -> np.ndarray | None:
    """floor(256 x) of each component as doubles, which hold them exactly; null if the vector takes no part."""
    if vector is None or any(x is None for x in vector):
        return None
    x = np.array(vector, np.float64)
    return np.floor(np.clip(x, -1e300, 1e300) * 256) + 0.0 if np.isfinite(x).all() else None


def codebooks(sample: list[np.ndarray]) -> dict[int, list[np.ndarray]]:
    """For each length that the sample holds, the centroids of each stretch, by Lloyd's steps."""
    out: dict[int, list[np.ndarray]] = {}
    for dim in {len(x) for x in sample}:
        rows = np.stack([x for x in sample if len(x) == dim])
        rows = rows[np.abs(rows).max(1, initial=0) < 1e100]
        books = []
        for a in range(0, dim, SUB):
            x = rows[:, a : a + SUB]
            centres = np.unique(x, axis=0) if len(x) else np.zeros((1, min(SUB, dim - a)))
            if len(centres) > CENTROIDS:
                centres = np.random.default_rng(a).permutation(centres)[:CENTROIDS]
                for _ in range(STEPS):
                    near = _nearest(x, centres)
                    n = np.bincount(near, minlength=len(centres))
                    sums = np.stack([np.bincount(near, x[:, k], len(centres)) for k in range(x.shape[1])], 1)
                    centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
            books.append(centres)
        out[dim] = books
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)


def indexed(vectors: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
    """``(row, vec_id, label, dim, q, codes, rest)`` of the rows of ``vectors (vec_id, label, embedding)`` that take part."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            ids, labels, found = b.column("vec_id").to_pylist(), b.column("label").to_pylist(), [integers(v) for v in b.column("embedding").to_pylist()]
            own = [k for k, q in enumerate(found) if q is not None and labels[k] is not None]
            codes, rest = [b""] * len(found), [b""] * len(found)
            for dim in {len(found[k]) for k in own}:
                at = [k for k in own if len(found[k]) == dim]
                x = np.stack([found[k] for k in at])
                c, r = np.zeros((len(at), -(-dim // SUB)), np.uint8), np.zeros((len(at), -(-dim // SUB)))
                for m in range(c.shape[1]):
                    part = x[:, m * SUB : (m + 1) * SUB]
                    if dim in shared.value:
                        centres = shared.value[dim][m]
                        c[:, m] = _nearest(part, centres)
                        part = part - centres[c[:, m]]
                    r[:, m] = np.linalg.norm(part, axis=1)  # without a codebook, all of the stretch
                for k, y, z in zip(at, c, r, strict=True):
                    codes[k], rest[k] = y.tobytes(), z.tobytes()
            columns = [pa.array([number + k for k in own], pa.int64()), pa.array([ids[k] for k in own], pa.int64()), pa.array([labels[k] for k in own], pa.int64()), pa.array([len(found[k]) for k in own], pa.int32())]
            columns += [pa.array([x[k] if isinstance(x[k], bytes) else x[k].tobytes() for k in own], pa.binary()) for x in (found, codes, rest)]
            number += len(found)
            yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "label", "dim", "q", "codes", "rest"])
        tidy()

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, INDEX)


def exact(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in exact integers."""
    bound = float(np.abs(anchor).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, len(anchor))
    if bound < 2**53:
        return (rows @ anchor).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(anchor.tolist(), row.tolist(), strict=True)) for row in rows]
    return np.array([max(-_TOP - 1, min(_TOP, x)) for x in whole], np.int64)


class Anchors:
    """Anchors of one length, with their bounds on a batch of rows."""

    def __init__(self, rows: list, books: list[np.ndarray] | None):
        self.row, self.vec_id, self.label = (np.array([r[c] for r in rows], np.int64) for c in ("row", "vec_id", "label"))
        self.q = np.stack([np.frombuffer(bytes(r["q"]), np.float64) for r in rows])
        self.books = books

    def bounds(self, tile: slice, codes: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products of the tile's anchors with rows."""
        q = self.q[tile]
        score, wide = np.zeros((len(q), len(codes))), np.zeros((len(q), len(codes)))
        for m in range(codes.shape[1]):
            part = q[:, m * SUB : (m + 1) * SUB]
            if self.books is not None:
                score += np.take(part @ self.books[m].T, codes[:, m], axis=1)  # the anchors' lookup table of this stretch
            wide += np.linalg.norm(part, axis=1)[:, None] * rest[:, m]
        wide = wide * (1 + 1e-9) + np.abs(score) * 1e-9 + 1e-6  # rounding of the sums in doubles
        return score - wide, score + wide


class Rows:
    """A batch's rows of one length."""

    def __init__(self, b: pa.RecordBatch, at: np.ndarray, dim: int):
        take = lambda c: b.column(c).take(pa.array(at))
        wide = -(-dim // SUB)
        self.row, self.label = take("row").to_numpy(), take("label").to_numpy()
        ids = take("vec_id")
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.vec_id = ids.fill_null(_TOP).to_numpy()
        self.q = np.frombuffer(b"".join(take("q").to_pylist()), np.float64).reshape(len(at), dim)
        self.codes = np.frombuffer(b"".join(take("codes").to_pylist()), np.uint8).reshape(len(at), wide)
        self.rest = np.frombuffer(b"".join(take("rest").to_pylist()), np.float64).reshape(len(at), wide)


def _by_length(b: pa.RecordBatch, of: dict):
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        if dim in of:
            yield dim, Rows(b, np.flatnonzero(dims == dim), dim)


def _kept(old: list, rows: Rows, at: np.ndarray, scores: np.ndarray) -> list:
    """The five best of old results (-score, no id, id, row) and new ones."""
    if len(at) > BEST:
        least = np.partition(scores, -BEST)[-BEST]
        at, scores = at[scores >= least], scores[scores >= least]
    new = zip((-scores).tolist() if scores.min(initial=0) > -_TOP - 1 else [-int(s) for s in scores], rows.no_id[at].tolist(), rows.vec_id[at].tolist(), rows.row[at].tolist(), strict=True)
    return sorted([*old, *new])[:BEST]


def _fifth(values: np.ndarray) -> float:
    return np.partition(values, -BEST)[-BEST] if len(values) >= BEST else -np.inf


def positives(index: DataFrame, anchors: dict[int, Anchors]) -> DataFrame:
    """``(anchor, positive_row, positive_id, score)``: each task's best rows of an anchor's label."""
    shared = index.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        best: dict[int, list] = {}
        for b in batches:
            for dim, rows in _by_length(b, shared.value):
                own = shared.value[dim]
                for label in np.unique(own.label):
                    of, at = np.flatnonzero(own.label == label), np.flatnonzero(rows.label == label)
                    for s in range(0, len(of) if len(at) else 0, TILE):
                        tile = of[s : s + TILE]
                        low, high = own.bounds(tile, rows.codes[at], rows.rest[at])
                        for k, a in enumerate(tile.tolist()):
                            key, other = int(own.row[a]), rows.row[at] != own.row[a]
                            old = best.get(key, [])
                            least = max(_fifth(low[k][other]), -old[-1][0] if len(old) == BEST else -np.inf)
                            near = at[other & (high[k] >= least)]
                            best[key] = _kept(old, rows, near, exact(own.q[a], rows.q[near]))
        found = [(a, row, None if no_id else vec_id, -score) for a, rows_ in best.items() for score, no_id, vec_id, row in rows_]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64()) for c in range(4)], names=["anchor", "positive_row", "positive_id", "score"])
        tidy()

    return index.mapInArrow(run, "anchor long, positive_row long, positive_id long, score long")


def negatives(index: DataFrame, anchors: dict[int, Anchors], scores: dict[int, list[int]], low_share: int, high_share: int) -> DataFrame:
    """``(anchor, place, negative_row, negative_id, score)``: each task's best rows of other labels in the window below each of an anchor's positive scores."""
    shared = index.sparkSession.sparkContext.broadcast((anchors, scores))

    def run(batches):
        best: dict[tuple, list] = {}
        groups, windows = shared.value
        for b in batches:
            for dim, rows in _by_length(b, groups):
                own = groups[dim]
                for s in range(0, len(own.row), TILE):
                    tile = np.arange(s, min(s + TILE, len(own.row)))
                    low, high = own.bounds(tile, rows.codes, rows.rest)
                    for k, a in enumerate(tile.tolist()):
                        key, other = int(own.row[a]), rows.label != own.label[a]
                        wanted, limits = np.zeros(len(other), bool), {}
                        for place, p in enumerate(windows.get(key, [])):
                            # 100 n within low_share p and high_share p, in whole numbers
                            least, most = -(-low_share * p // 100), high_share * p // 100
                            if least > most:
                                continue
                            limits[place] = (least, most)
                            inside = other & (low[k] <= most) & (high[k] >= least)
                            old = best.get((key, place), [])
                            sure = low[k][inside & (low[k] >= least) & (high[k] <= most)]
                            wanted |= inside & (high[k] >= max(_fifth(sure), -old[-1][0] if len(old) == BEST else -np.inf))
                        near = np.flatnonzero(wanted)
                        if not len(near):
                            continue
                        found = exact(own.q[a], rows.q[near])
                        for place, (least, most) in limits.items():
                            fit = (found >= least) & (found <= most)
                            best[key, place] = _kept(best.get((key, place), []), rows, near[fit], found[fit])
        out = [(a, place, row, None if no_id else vec_id, -score) for (a, place), rows_ in best.items() for score, no_id, vec_id, row in rows_]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], names=["anchor", "place", "negative_row", "negative_id", "score"])
        tidy()

    return index.mapInArrow(run, "anchor long, place long, negative_row long, negative_id long, score long")


def _ranked(found: DataFrame, keys: list[str], vec_id: str, row: str) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last(vec_id), row)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= BEST)


def mined(vectors: DataFrame, is_anchor: str = "vec_id % 100 = 0", low_share: int = 80, high_share: int = 100) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``vectors (vec_id, label, embedding)``."""
    spark, since = vectors.sparkSession, mark()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    few = max(CENTROIDS, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, longest))))
    chosen = rows.where("embedding is not null and label is not null").orderBy(F.xxhash64("embedding"), "vec_id").limit(few).select("embedding").collect()
    books = codebooks([q for q in (integers(r["embedding"]) for r in chosen) if q is not None])
    index = written(indexed(rows, books), "index")
    anchors = index.where(is_anchor).select("row", "vec_id", "label", "dim", "q")
    blocks = max(1, -(-anchors.count() // ANCHORS))
    tables = []
    for block in range(blocks):  # of a bounded size each
        group = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).collect() if blocks > 1 else anchors.collect()
        if not group:
            continue
        of = {dim: Anchors([r for r in group if r["dim"] == dim], books.get(dim)) for dim in {r["dim"] for r in group}}
        good = written(_ranked(positives(index, of), ["anchor"], "positive_id", "positive_row"), "positives")
        scores: dict[int, list[int]] = {}
        for r in good.orderBy("anchor", "rank").collect():  # five for each anchor of the block
            scores.setdefault(r["anchor"], []).append(r["score"])
        bad = _ranked(negatives(index, of, scores, low_share, high_share), ["anchor", "place"], "negative_id", "negative_row")
        pairs = good.select("anchor", (F.col("rank") - 1).cast("long").alias("place"), "positive_id", F.col("score").alias("positive_score"))
        bad = bad.select("anchor", "place", "rank", "negative_id", F.col("score").alias("negative_score")).join(pairs, ["anchor", "place"])
        tables.append(written(bad.join(index.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor"), "negatives"))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not tables:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sweep(spark, since, tables)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select(*names)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.select("vec_id", label.alias("label"), "embedding"))


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE_SQL = {
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT vec_id, label, list_transform(e, lambda x: floor(256 * x)) AS q, row_number() OVER (ORDER BY vec_id) AS r FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.r AS anchor, b.vec_id, b.r, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM q a JOIN q b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY s.anchor, k ORDER BY score DESC, vec_id, r))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM s JOIN p ON s.anchor = p.anchor WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""
}
