"""Ids of texts by a merge-type piece model, and texts of ids; the method is in ``pieces``.

Both directions are maps over rows. Edge cases: a null or empty text is the end id alone, and the end id
alone decodes to an empty text; null ids stay; repeated rows give repeated rows; an empty table none; texts of any length
are encoded whole; characters that no piece holds, control characters included, are bytes; strings that spell special pieces are plain text; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import PIECES, piece_model, piece_units
from .tokens import tidy

SLICE = 200


def encoded(docs: DataFrame, model: str = PIECES, end: bool = True) -> DataFrame:
    """``(doc_id, ids)`` of ``docs (doc_id, text)``; with ``end`` each text's last id is the model's end id."""

    def run(batches):
        units, last = piece_units(model), piece_model(model).end
        for b in batches:
            for s in range(0, b.num_rows, SLICE):
                c = b.slice(s, SLICE)
                ids, at = units.encode(c.column("text").to_pylist())
                if end:
                    ids, at = np.insert(ids.astype(np.int32), at[1:], last), at + np.arange(len(at))
                rows = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), rows], names=["doc_id", "ids"])
            tidy()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str = PIECES) -> DataFrame:
    """``(doc_id, ids, text)`` of ``rows (doc_id, ids)``; null ids give a null text, special ids nothing. An unknown id is an error."""

    def run(batches):
        pieces = piece_model(model)
        for b in batches:
            for s in range(0, b.num_rows, SLICE):
                c = b.slice(s, SLICE)
                ids = c.column("ids")
                flat, at = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())])
                if len(flat) and not 0 <= flat.min() <= flat.max() < pieces.vocabulary:
                    raise ValueError("an id is beyond the model's pieces")
                texts = [pieces.decode(flat[x:y].tolist()) for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), ids, pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))], names=["doc_id", "ids", "text"])
            tidy()

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document with the end id, decoded again, as digests."""
    back = decoded(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {"op11_pieces": op11_pieces}
