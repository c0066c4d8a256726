"""Training-order materialisation: fixed-stride binary shards in a keyed random order.

Documents are tokenised once into staged blocks; each block's ids are cut into
sequences of ``length`` ids (the last of a block is padded). Sequences are numbered
0 to N-1 through (part, place in the part); a Feistel network keyed by ``key``,
walked until it lands below N, maps each number to its slot in training order,
without any sort or table: slots can be computed anywhere and inverted. Slot s lies in
shard s // ``shard_slots`` at byte (s mod shard_slots) * stride, so a reader resumes
at any step with one seek. Shards are dealt one to a partition by their number, sorted
by slot in the task (spilling if need be), streamed to a temporary file and
renamed, so a lost or repeated task leaves whole shards only.

Bounds: the driver holds one count for each scan partition. A shard task streams
its rows; memory holds one sequence.

Edge cases: null or empty texts are the end id alone; an empty table gives no
shards and no rows; repeated rows are repeated documents; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import VOCABULARY, staged, unpacked, width
from .store import new_path
from .tokens import TOKENIZER, tidy

LENGTH, SHARD_SLOTS, ROUNDS, PAD = 2048, 4096, 6, 0


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Permutation:
    """A keyed bijection on 0..n-1: a balanced Feistel network on the next even number of bits, cycle-walked."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [zlib.crc32(f"{key}/{r}".encode()) for r in range(rounds)]

    def _once(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & self.mask)
        return (right << np.uint64(self.half)) | left  # swapped, so that the reversed keys undo it

    def _walk(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._once(np.asarray(x, np.uint64), keys)
            while (far := out >= self.n).any():
                out[far] = self._once(out[far], keys)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


def _file(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def materialise(docs: DataFrame, folder: str, key: int = 20_240_601, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, tokenizer: str = TOKENIZER, vocabulary: int = VOCABULARY) -> DataFrame:
    """Writes the shards when the result is computed: a row per slot with its place, ids' checksum and documents.

    ``folder`` is a URI that all executors can write to. ``n_tokens`` counts ids
    before padding; ``doc_ids`` and ``doc_tokens`` say whose they are, in order.
    """
    blocks = staged(docs, tokenizer=tokenizer, vocabulary=vocabulary, length=length)
    tokens = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    sequences = F.ceil(tokens / length)
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum(sequences).alias("n")).collect())
    n = sum(x for _, x in totals)
    starts, at = {}, 0
    for part, x in totals:
        starts[part], at = at, at + x
    order, kind = Permutation(n, key), width(vocabulary)
    shards = math.ceil(n / shard_slots)

    def cut(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for row in b.to_pylist():
                ids = unpacked(row["ids"], vocabulary).astype(kind)
                m = -(-len(ids) // length)
                first = starts[row["part"]] + row["before"]
                numbers = np.arange(first, first + m)
                slots = order.slot(numbers)
                ends = np.cumsum(row["sizes"])
                begin = ends - np.array(row["sizes"])
                for a in range(0, m, 256):
                    rows = range(a, min(m, a + 256))
                    payload, who, share = [], [], []
                    for k in rows:
                        x, y = k * length, min(len(ids), (k + 1) * length)
                        lo, hi = np.searchsorted(ends, x, "right"), np.searchsorted(begin, y, "left")
                        who.append(row["doc_ids"][lo:hi])
                        share.append((np.minimum(ends[lo:hi], y) - np.maximum(begin[lo:hi], x)).tolist())
                        payload.append(z.compress(ids[x:y].tobytes()))
                    s = slots[a : a + 256]
                    columns = [pa.array(s // shard_slots, pa.int32()), pa.array(s), pa.array(numbers[a : a + 256]), pa.array(who, pa.list_(pa.int64())), pa.array(share, pa.list_(pa.int64())), pa.array(payload, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "slot", "sequence", "doc_ids", "doc_tokens", "ids"])
            tidy()

    def write(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        now, out, temporary, expect = None, None, "", 0

        def close():
            if out is not None:
                out.close()
                store.move(temporary, _file(base, now))

        for b in batches:
            rows = b.to_pylist()
            checks = []
            for row in rows:
                if row["shard"] != now:
                    close()
                    now, expect = row["shard"], row["shard"] * shard_slots
                    temporary = f"{base}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                if row["slot"] != expect:
                    raise ValueError(f"slot {row['slot']} where {expect} was due")
                expect += 1
                ids = np.full(length, PAD, kind)
                raw = np.frombuffer(zstandard.decompress(row["ids"]), kind)
                ids[: len(raw)] = raw
                data = ids.tobytes()
                out.write(data)
                checks.append((len(raw), zlib.crc32(data)))
            keep = b.select(["slot", "sequence", "shard"]).columns
            offset = pa.array([(r["slot"] - r["shard"] * shard_slots) * length * np.dtype(kind).itemsize for r in rows], pa.int64())
            more = [offset, pa.array([x for x, _ in checks], pa.int64()), pa.array([x for _, x in checks], pa.int64()), b.column("doc_ids"), b.column("doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, *more], names=["slot", "sequence", "shard", "byte_offset", "n_tokens", "shard_crc32", "doc_ids", "doc_tokens"])
        close()
        tidy()

    cells = blocks.select("part", "before", "doc_ids", "sizes", "ids")
    rows = cells.mapInArrow(cut, "shard int, slot long, sequence long, doc_ids array<bigint>, doc_tokens array<bigint>, ids binary")
    dealt = rows.repartitionById(max(1, shards), F.col("shard")).sortWithinPartitions("slot")
    return dealt.mapInArrow(write, "slot long, sequence long, shard int, byte_offset long, n_tokens long, shard_crc32 long, doc_ids array<bigint>, doc_tokens array<bigint>")


def op3_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "shards"))


def read_slots(folder: str, first: int, count: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, vocabulary: int = VOCABULARY) -> np.ndarray:
    """``count`` sequences in training order from slot ``first`` on, by seeking."""
    store, base = fs.FileSystem.from_uri(folder)
    kind = np.dtype(width(vocabulary))
    out = []
    while count > 0:
        shard, at = divmod(first, shard_slots)
        with store.open_input_file(_file(base, shard)) as f:
            f.seek(at * length * kind.itemsize)
            got = np.frombuffer(f.read(min(count, shard_slots - at) * length * kind.itemsize), kind).reshape(-1, length)
        if not len(got):
            break
        out.append(got)
        first, count = first + len(got), count - len(got)
    return np.concatenate(out) if out else np.zeros((0, length), kind)


QUERIES = {"op3_materialise": op3_materialise}
