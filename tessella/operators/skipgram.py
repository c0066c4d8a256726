"""Item vectors by skip-gram with negative sampling, with no task that sees all items or all pairs.

Items are dealt into blocks by hash. An item has a vector as a centre and one as a context (Mikolov and others, 2013); pairs of items that stand
near each other in a unit are kept once, by the blocks of both, and serve in either direction. In round r centre block i meets context block
i + r: the blocks of a round have nothing in common, so all are trained at once, each in a task of its own that holds two blocks
and their pairs, and draws its negatives from the context block by the items' frequency to the power 3/4. After as many rounds as there are blocks every pair has been trained once
(Gemulla and others, 2011). Rounds are written to the shared folder, so a lost executor's blocks are trained again from there, with
the same random numbers: a seed gives the same vectors whatever the cluster. A round's table goes when the next is written, and so do its shuffle files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import mark, sweep, written

NEAR, NEGATIVES, BATCH, BLOCK_ITEMS, CHUNK, AT_ONCE = 5, 5, 512, 50_000, 100_000, 8
#: Every round moves all vectors, so there are no more than ``ROUNDS`` blocks while one block's vectors fit into ``BLOCK_BYTES``.
ROUNDS, BLOCK_BYTES = 16, 32 << 20
#: Places of a unit that one task must go through; pairs that a task holds before it writes them.
STRETCH, HELD = 1_000, 2_000_000
_STATE = "kind int, block int, vectors binary, weights binary"
_PAIRS = "a_block int, b_block int, shift int, chunk int, a array<int>, b array<int>"


def near_pairs(obs: DataFrame, near: int = NEAR) -> DataFrame:
    """``(a, b)``: items at most ``near`` places apart, in either direction, in a unit's order (heaviest first, then by item)."""
    unit = Window.partitionBy("unit_id").orderBy("place")
    ahead = F.array_compact(F.array(*[F.lead("item", k).over(unit) for k in range(1, near + 1)]))
    found = placed(obs, near).select(F.col("item").alias("x"), ahead.alias("ahead")).select("x", F.explode("ahead").alias("y"))
    return found.select(F.inline(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))))


def placed(obs: DataFrame, near: int = NEAR, records: bool = False) -> DataFrame:
    """``(unit_id, item, place, n)``: places from 0 in a unit's order (heaviest first, then by item), and how many pairs a place is in.

    Items of a unit are summed first; with ``records`` every row of ``obs`` has a place of its own, and ``n`` is 1.
    """
    known = obs.where("item is not null and unit_id is not null").select("unit_id", "item", "weight").repartition("unit_id")
    if not records:
        known = known.groupBy("unit_id", "item").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    unit = Window.partitionBy("unit_id")
    place = F.row_number().over(unit.orderBy(F.desc("weight"), "item")) - 1
    if records:
        return known.select("unit_id", "item", place.alias("place"), F.lit(1).cast("long").alias("n"))
    both = F.least(place, F.lit(near)) + F.least(F.count("*").over(unit) - 1 - place, F.lit(near))
    return known.select("unit_id", "item", place.alias("place"), both.cast("long").alias("n"))


def _packed(near: int, blocks: int):
    """A map of places, sorted by unit and stretch, to their pairs: one row for each pair of blocks and chunk that a task has, sorted."""

    def run(batches):
        held, size, last, carried = [], 0, None, np.zeros((5, 0), np.int64)
        for batch in batches:
            units = batch.column("unit_id")
            units, old = pa.concat_arrays([last, units]) if last is not None else units, carried.shape[1]
            rows = np.stack([batch.column(c).to_numpy() for c in ("stretch", "place", "chunk", "block", "idx")]).astype(np.int64)
            stretch, place, chunk, block, idx = rows = np.concatenate([carried, rows], axis=1)
            new = pc.not_equal(units[1:], units[:-1]).to_numpy(zero_copy_only=False) | (stretch[1:] != stretch[:-1])
            unit = np.concatenate([[0], np.cumsum(new)])
            for k in range(1, near + 1):  # k rows on: as many places on, or more where an item between is rare
                x = np.flatnonzero((unit[k:] == unit[:-k]) & (place[k:] - place[:-k] <= near) & (place[:-k] < (stretch[:-k] + 1) * STRETCH))
                x = x[x + k >= old]
                held.append(np.stack([(chunk[x] * blocks + block[x]) * blocks + block[x + k], idx[x] << 32 | idx[x + k]]))
                size += len(x)
            last, carried = units[-near:], rows[:, -near:]
            if size > HELD:
                yield from cells(held)
                held, size = [], 0
        yield from cells(held)

    def cells(held):
        cell, pair = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
        if not len(cell):
            return
        order = np.lexsort((pair, cell))
        cell, pair = cell[order], pair[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        (chunk, i), j = np.divmod(cell[first] // blocks, blocks), cell[first] % blocks
        ints, at = lambda x: pa.array(x.astype(np.int32)), pa.array(np.append(first, len(cell)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, ints(x)) for x in (pair >> 32, pair & 0xFFFFFFFF)]
        out = pa.RecordBatch.from_arrays([ints(i), ints(j), ints((j - i) % blocks), ints(chunk), *lists], names=["a_block", "b_block", "shift", "chunk", "a", "b"])
        for s in range(0, len(first), 10_000):
            yield out.slice(s, 10_000)

    return run


def _numbers(counts: DataFrame, blocks: int) -> DataFrame:
    """``(item, block, idx, n)``: an item's block and its place there, in the order of the items' text."""
    block = F.pmod(F.xxhash64(F.col("item").cast("string")), F.lit(blocks)).cast("int")
    place = F.row_number().over(Window.partitionBy("block").orderBy(F.col("item").cast("string"))) - 1
    return counts.withColumn("block", block).withColumn("idx", place.cast("int"))


def _damping(at: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """A factor for each gradient; where more than ``AT_ONCE`` pairs of a batch move an item, they count as so many, or steps would overshoot."""
    np.add.at(seen, at, 1.0)
    out = np.minimum(1.0, AT_ONCE / seen.take(at))
    seen[at] = 0.0
    return out


def _add(to: np.ndarray, at: np.ndarray, d: np.ndarray) -> None:
    """Adds rows ``d`` to the rows ``at``; one-dimensional, which numpy does ten times as fast."""
    np.add.at(to.reshape(-1), (at[:, None] * to.shape[1] + np.arange(to.shape[1])).reshape(-1), d.reshape(-1))


def _train(centre: np.ndarray, context: np.ndarray, a: np.ndarray, b: np.ndarray, cumulative: np.ndarray, lr: float, rng: np.random.Generator, negatives: int) -> None:
    """One pass over pairs of places in two blocks, in batches that are small beside the blocks."""
    order = rng.permutation(len(a))
    batch = int(np.clip(len(centre) // 4, 16, BATCH))
    # drawn for all pairs at once: sorted numbers are looked up in a fraction of the time, and then dealt at random
    drawn = np.searchsorted(cumulative, np.sort(rng.random(len(a) * negatives)) * cumulative[-1], side="right")
    rng.shuffle(drawn)
    us, vs = a[order], np.concatenate([b[order][:, None], drawn.reshape(-1, negatives)], axis=1)
    rate = np.where(vs == vs[:, :1], 0.0, lr)  # the pair itself is no negative
    rate[:, 0] = lr
    seen = np.zeros(len(centre)), np.zeros(len(context))
    for s in range(0, len(us), batch):
        u, v, w = us[s : s + batch], vs[s : s + batch], rate[s : s + batch]
        x, y = centre.take(u, axis=0), context.take(v, axis=0)
        g = w / (-1 - np.exp(-np.clip(np.einsum("id,ijd->ij", x, y), -30, 30)))
        g[:, 0] += lr
        dx = np.einsum("ij,ijd->id", g, y) * _damping(u, seen[0])[:, None]
        dy = np.einsum("ij,id->ijd", g * _damping(v.reshape(-1), seen[1]).reshape(g.shape), x)
        _add(centre, u, dx)
        _add(context, v.reshape(-1), dy)


def item_vectors(obs: DataFrame, dim: int = 16, min_count: int = 2, epochs: int = 3, lr: float = 0.05, negatives: int = NEGATIVES, near: int = NEAR, seed: int = 1, blocks: int | None = None, records: bool = False) -> DataFrame:
    """``(item, vector)`` of the items in at least ``min_count`` pairs of ``obs (unit_id, item, weight)``; the rate falls linearly to a tenth.

    With ``records``, an item's rows of ``obs`` are not summed in a unit, and ``min_count`` is of rows, whether they are in pairs or not.
    """
    spark, since = obs.sparkSession, mark()
    places = written(placed(obs, near, records), "placed", once=True)
    counts = written(places.groupBy("item").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "counts", once=True)
    known, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if blocks is None:
        blocks = max(2, min(ROUNDS, -(-known // BLOCK_ITEMS)), -(-known * dim * 8 // BLOCK_BYTES))
    chunks = max(1, total * (2 * near if records else 1) // (blocks * blocks * CHUNK))
    items = written(_numbers(counts, blocks), "items", once=True)
    # a stretch's last places meet the first of the next one, which stand in both
    stretch, rest = F.floor(F.col("place") / STRETCH).cast("long"), F.col("place") % STRETCH
    stretches = F.when((rest < near) & (stretch > 0), F.array(stretch - 1, stretch)).otherwise(F.array(stretch))
    rows = places.join(items.select("item", "block", "idx"), "item").select("unit_id", F.explode(stretches).alias("stretch"), "place", "block", "idx")
    rows = rows.repartition("unit_id", "stretch").sortWithinPartitions("unit_id", "stretch", "place")
    # all pairs of a stretch are in one chunk; chunks are sorted, so that a round's random order means the same whatever the order of rows was
    chunk = F.pmod(F.xxhash64("unit_id", "stretch"), F.lit(chunks)).alias("chunk")
    lists = written(rows.select("*", chunk).mapInArrow(_packed(near, blocks), _PAIRS), "pairs", by="shift", once=True)
    sizes = items.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("idx", "n"))).alias("p")).select("block", F.col("p.n").alias("n"))

    def row(kind: int, block: int, x: np.ndarray, weights: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "block": pa.array([block], pa.int32()), "vectors": pa.array([x.tobytes()], pa.binary()), "weights": pa.array([weights], pa.binary())})

    def begin(batches):
        for batch in batches:
            for block, n in zip(batch.column("block").to_pylist(), batch.column("n"), strict=True):
                weights = np.cumsum(n.values.to_numpy().astype(float) ** 0.75).tobytes()
                yield row(0, block, np.random.default_rng([seed, block]).uniform(-0.5, 0.5, (len(n), dim)) / dim, b"")
                yield row(1, block, np.zeros((len(n), dim)), weights)

    def pass_over(turn: int, rate: float):
        def train(batches):
            """Rows of a task come sorted: its two blocks, then the pieces of their pairs, by chunk."""
            at, held, pieces = None, {}, []

            def learn():
                if len(held) == 2 and pieces:
                    pairs = np.concatenate(pieces)
                    pairs.sort()
                    rng = np.random.default_rng([seed, turn, *at])
                    _train(held[0][1], held[1][1], pairs >> 32, pairs & 0xFFFFFFFF, np.frombuffer(held[1][2]), rate, rng, negatives)
                pieces.clear()

            for b in batches:
                a, of = (b.column(c) for c in ("a", "b"))
                for k, (t, kind, block) in enumerate(zip(*(b.column(c).to_pylist() for c in ("task", "kind", "block")), strict=True)):
                    if kind < 2 or at != (t, block):
                        learn()
                    if kind == 0 or at is None or at[0] != t:
                        yield from (row(kind_, *x) for kind_, x in sorted(held.items()))
                        held.clear()
                    at = (t, block)
                    if kind < 2:
                        x = np.frombuffer(b.column("vectors")[k].as_py(), np.float64).reshape(-1, dim).copy()
                        held[kind] = (block, x, b.column("weights")[k].as_py())
                    else:
                        pieces.append((a[k].values.to_numpy().astype(np.int64) << 32) | of[k].values.to_numpy())
            learn()
            yield from (row(kind_, *x) for kind_, x in sorted(held.items()))

        return train

    sweep(spark, since, [items, lists])
    last = mark()
    state = written(sizes.mapInArrow(begin, _STATE), "vectors", once=True)
    rounds, none = epochs * blocks, F.lit(None)
    for r in range(rounds):
        shift = r % blocks
        task = F.when(F.col("kind") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - shift, F.lit(blocks))).cast("int")
        blocks_of = state.select(task.alias("task"), "kind", "block", none.cast("array<int>").alias("a"), none.cast("array<int>").alias("b"), "vectors", "weights")
        rows = blocks_of
        for side, centre, a, b in ((shift, "a_block", "a", "b"), (-shift % blocks, "b_block", "b", "a")):
            mine = lists.where(F.col("shift") == side)
            rows = rows.unionByName(mine.select(F.col(centre).alias("task"), F.lit(2).alias("kind"), F.col("chunk").alias("block"), F.col(a).alias("a"), F.col(b).alias("b"), none.cast("binary").alias("vectors"), none.cast("binary").alias("weights")))
        rows = rows.repartitionById(blocks, F.col("task")).sortWithinPartitions("task", "kind", "block")
        state = written(rows.mapInArrow(pass_over(r, lr * max(0.1, 1 - r / rounds)), _STATE), "vectors", once=True)
        sweep(spark, last, [state])

    def rows_of(batches):
        for batch in batches:
            for block, x in zip(batch.column("block").to_pylist(), batch.column("vectors").to_pylist(), strict=True):
                v = np.frombuffer(x, np.float64).reshape(-1, dim)
                at = pa.array(np.arange(len(v) + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), block), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.ListArray.from_arrays(at, pa.array(v.ravel()))], names=["block", "idx", "vector"])

    vectors = state.where("kind = 0").mapInArrow(rows_of, "block int, idx int, vector array<double>")
    sweep(spark, since, [items, state])
    return items.join(vectors, ["block", "idx"]).select("item", "vector")
