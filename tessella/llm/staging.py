"""Token ids of a corpus, staged once in the shared folder as compressed blocks of whole documents.

A row is a block of consecutive documents of one scan partition, about
``BLOCK_TOKENS`` tokens: ``part``, ``block`` (its number in the part), ``before``
(sequences of ``length`` ids that the part's earlier blocks make, each block's last
one padded), ``doc_ids``, ``sizes`` and ``ids`` (zstd,
little-endian unsigned 16-bit, or 32-bit for larger vocabularies). A part's last
row also has ``df``: in how many of the part's documents each id occurs (zstd,
unsigned 32-bit). A document larger than a block has a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .store import new_path
from .tokens import TOKENIZER, tidy, words_of

BLOCK_TOKENS = 1 << 20
VOCABULARY = 49_408
SCHEMA = "part int, block int, before long, doc_ids array<bigint>, sizes array<bigint>, ids binary, df binary"
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary()), ("df", pa.binary())])


def width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def staged(docs: DataFrame, end_id: int = 1, tokenizer: str = TOKENIZER, vocabulary: int = VOCABULARY, length: int = 2048) -> DataFrame:
    """The staged blocks of ``docs (doc_id, text)``; ``end_id`` ends each document. Null texts are empty."""

    def run(batches):
        words, part = words_of(tokenizer), TaskContext.get().partitionId()
        df, place = np.zeros(vocabulary, np.uint32), np.zeros(vocabulary, np.int64)
        doc_ids: list = []
        sizes: list[int] = []
        pieces: list[np.ndarray] = []
        total = before = block = 0

        def row(last: bool):
            ids = np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
            z = zstandard.ZstdCompressor(level=3)
            cells = [part, block, before, doc_ids, sizes, z.compress(ids.astype(width(vocabulary)).tobytes()), z.compress(df.tobytes()) if last else None]
            return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, cells, strict=True))], schema=_ARROW)

        for b in batches:
            for a in range(0, b.num_rows, 500):
                c = b.slice(a, 500)
                ids, at = words.encode(c.column("text").to_pylist())
                bounds = at.tolist()
                for doc_id, x, y in zip(c.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False):
                    own = np.append(ids[x:y], np.uint32(end_id))
                    place[own] = np.arange(len(own))
                    df[own[place[own] == np.arange(len(own))]] += 1
                    if total and total + len(own) > BLOCK_TOKENS:
                        yield row(False)
                        before, block, total, doc_ids, sizes, pieces = before - (-total // length), block + 1, 0, [], [], []
                    doc_ids.append(doc_id)
                    sizes.append(len(own))
                    pieces.append(own)
                    total += len(own)
            tidy()
        if total:
            yield row(True)
        pieces = []
        tidy()

    spark, path = docs.sparkSession, new_path(docs.sparkSession, "tokens")
    docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def unpacked(ids: bytes, vocabulary: int = VOCABULARY) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), width(vocabulary)).astype(np.uint32)


def corpus_df(blocks: DataFrame, vocabulary: int = VOCABULARY) -> np.ndarray:
    """Documents that hold each id, summed over all parts on the executors; one array of the vocabulary's size comes back."""

    def add(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column("df").to_pylist():
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(total.tobytes())], pa.binary())], names=["df"])

    sums = blocks.where("df is not null").select("df").coalesce(64).mapInArrow(add, "df binary").collect()
    return sum((np.frombuffer(zstandard.decompress(bytes(r["df"])), np.int64) for r in sums), np.zeros(vocabulary, np.int64))
