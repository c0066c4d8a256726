"""Quality classifier: Bradley-Terry ranking on preference pairs.

A text becomes a fixed vector: shares of character classes, repetition and
length measures (each also as soft bins, so that the linear model can bend) and
hashed shapes of its words. Labelled texts give preference pairs (a good text is
preferred to a bad one); weights are learned by logistic loss on the difference
of the two vectors. A cut at a quantile of the training scores, the one with the
fewest errors, separates accepted from rejected texts, and a slope fitted on
the same scores turns the distance from the cut into a value from 0 to 1.

The model is fitted on at most ``MAX_TRAIN`` labelled rows (a bound, chosen by hash
of the id, that holds for labels and again for the rows they meet): about 40 MB on the driver. Scoring is a map over all rows with the
weights (some KB) in the closure; nothing is shuffled.

Edge cases: null or empty texts are scored like any other, on their (empty)
features; null labels are not used; several labels of a document are several
training rows; with only one kind of label, or none, every score is the smoothed
share of label 1; null ids are not held out and match no label; an empty table gives no rows; other
columns, whatever their names, are ignored (``accepted`` keeps them).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .store import written

MAX_TRAIN = 12_000
SHAPES, BINS = 384, 6
_CLASS = bytearray(b"x" * 256)  # letters of any case and all non-ASCII bytes by class; others stand for themselves
for _c in range(128):
    _CLASS[_c] = ord("A") if chr(_c).isupper() else ord("a") if chr(_c).isalpha() else ord("0") if chr(_c).isdigit() else _c
for _c in range(128, 256):
    _CLASS[_c] = ord("a")
_CLASS = bytes(_CLASS)
_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
DENSE = 16 + len(_PUNCTUATION)


def _features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Dense measures (before binning) and hashed shapes of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    dense, shapes = np.zeros(DENSE, np.float32), np.zeros(SHAPES, np.float32)
    if not raw.strip():
        dense[0] = 1
        return dense, shapes
    of = np.frombuffer(raw, np.uint8)
    counts = np.bincount(of, minlength=256)
    classes = np.frombuffer(raw.translate(_CLASS), np.uint8)
    run = np.ones(len(classes), bool)
    run[1:] = (classes[1:] != classes[:-1]) | ((classes[1:] != 97) & (classes[1:] != 65) & (classes[1:] != 48))
    words, forms = raw.split(), Counter(classes[run].tobytes().split())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, size = len(words), len(raw)
    distinct = len(set(words))
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum() + counts[128:].sum())
    pairs = len(set(zip(words, words[1:], strict=False)))
    dense[1:16] = (
        np.log1p(size) / 10, np.log1p(n) / 10, np.log1p(len(lines)) / 10, size / n / 20, upper / size, lower / size, counts[48:58].sum() / size,
        (counts[32] + counts[10] + counts[9]) / size, counts[128:].sum() / size, distinct / n, np.log1p(distinct) / 10, pairs / n,
        len(set(lines)) / len(lines), n / len(lines) / 50, upper / (upper + lower + 1),
    )
    dense[16:] = np.sqrt(counts[_PUNCTUATION] / n)
    for form, k in forms.items():
        shapes[zlib.crc32(form) % SHAPES] += k
    return dense, np.sqrt(shapes / n)


def features(texts: list[str | None]) -> np.ndarray:
    return np.array([np.concatenate(_features(x)) for x in texts], np.float32).reshape(len(texts), DENSE + SHAPES)


class Model:
    """Weights over binned measures and shapes; picklable, some tens of KB."""

    def __init__(self, prior: float = 0.5):
        self.edges = self.weights = None
        self.cut, self.slope, self.prior = 0.0, 1.0, prior

    def widen(self, x: np.ndarray) -> np.ndarray:
        """Dense measures, how far each is past each of its bin edges, and shapes."""
        dense = x[:, :DENSE]
        past = np.clip((dense[:, :, None] - self.edges[None, :, :-1]) / self.gaps[None], 0, 1)
        return np.concatenate([past.reshape(len(x), -1), x[:, DENSE:] * 4], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 1500, pairs: int = 512, l2: float = 1e-4, seed: int = 7) -> Model:
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.prior = (len(good) + 1) / (len(y) + 2)
        if not len(good) or not len(bad):
            return self
        self.edges = np.quantile(x[:, :DENSE], np.linspace(0, 1, BINS + 1) ** 1.0, axis=0).T.astype(np.float32)
        self.edges[:, -1] = x[:, :DENSE].max(0)
        self.gaps = np.maximum(self.edges[:, 1:] - self.edges[:, :-1], 1e-3)
        z, rng = self.widen(x), np.random.default_rng(seed)
        w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
        for t in range(1, steps + 1):
            d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
            g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + l2 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.05 * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights = w
        self._cut(z @ w, y)
        return self

    def _cut(self, s: np.ndarray, y: np.ndarray) -> None:
        """The quantile of the scores with the fewest errors on either side, then the slope that fits best."""
        order = np.argsort(s, kind="stable")
        s, y = s[order], y[order]
        errors = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
        best = np.flatnonzero(errors == errors[1:-1].min())
        k = int(np.clip(best[len(best) // 2], 1, len(s) - 1))
        self.cut, near = (s[k - 1] + s[k]) / 2, np.inf
        for slope in np.geomspace(0.01, 10, 40):
            p = np.clip(1 / (1 + np.exp(-np.clip(slope * (s - self.cut), -30, 30))), 1e-4, 1 - 1e-4)
            loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
            if loss < near:
                near, self.slope = loss, slope

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        s = np.concatenate([self.widen(features(texts[a : a + 256])) @ self.weights for a in range(0, len(texts), 256)] or [np.zeros(0)])
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.cut), -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from at most ``max_train`` labelled rows ``(doc_id, quality)`` and the texts of ``docs (doc_id, text)``."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for b in batches:
            for a in range(0, len(b), 256):
                c = b.iloc[a : a + 256]
                yield pd.DataFrame({"doc_id": c["doc_id"], "y": c["quality"], "x": [r.tobytes() for r in features(c["text"].tolist())]})

    # ids may repeat in docs: the bound holds for the rows that meet, before any of them reaches the driver
    met = rows.mapInPandas(run, "doc_id long, y int, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(max_train)
    got = sorted(written(met, "labelled").collect(), key=lambda r: (r["doc_id"], r["y"], bytes(r["x"])))
    if not got:
        return Model()
    return Model().fit(np.stack([np.frombuffer(r["x"], np.float32) for r in got]), np.array([r["y"] for r in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``score`` (double); ids pass through Arrow untouched."""
    names = [n for n in docs.columns if n != "text"]

    def run(batches):
        for b in batches:
            got = pa.array(model.score(b.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], got], names=[*names, "score"])

    return docs.mapInArrow(run, StructType([*[docs.schema[n] for n in names], StructField("score", DoubleType())]))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns kept."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(b.column("text").to_pylist()) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
