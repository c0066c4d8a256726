"""Near-duplicate embeddings by NN-descent.

Vectors are compared only within their label (and dimension), by cosine in double
precision. Equal vectors are one weighted node from the start.

1. A first graph: in each of several tables nodes are sorted by a code of random
   hyperplanes and compared with the ``WINDOW`` nodes that follow in their bucket. The
   tables grow with the number of nodes.
2. Descent: neighbours of a node (up to ``K_MAX`` of them, others in each round) are
   compared with each other, all at once in the task that holds the node's list; each
   node keeps its best ``K`` of the neighbours above ``FLOOR`` (two neighbours of one
   node, both at the threshold, can't be farther apart), and up to ``K_MAX`` links. This
   repeats until hardly any edge is new.
3. Links are the edges at or above the threshold; components come from the
   distributed graph step.
4. An exact check follows, at any size: all pairs of a label that bounds leave are compared,
   block against block. Links are counted, not listed, and those between components that the
   descent left apart join them, so what its lists or tables missed is not lost. Labels of more than ``EXACT`` nodes are
   cut into cells around centres; a node meets a cell only if its angle to the centre is at most
   the cell's radius and the threshold's angle. The inner product of a quarter of the components and the norms of the
   rest bound each pair from above; what that leaves is compared in full. Neither changes a result.
5. Audit: nodes chosen by hash, ``AUDIT`` at first, are compared with all nodes without any bound;
   the sample grows until ``SEEN`` nodes with links are among them. The share of their links that the check
   counted is in ``last_recall`` (1.0 where the sample has too few links to tell: all pairs were compared). How many
   links the descent had found by itself is logged.

Work per node is bounded in the descent. The check is quadratic in a label's nodes where the cells' bounds leave
all (as with vectors that point anywhere), with a small constant. Vectors of a third of all rows that are equal are one node.

Edge cases: vectors that are null, empty, zero or hold nulls or non-finite numbers, and rows
whose label or id is null, link with nothing: they are components of their own. Every row
is a vector of its own: repeated rows are links of each other, and rows that share an id but
not the vector have links of their own; a component's id is the smallest of its rows' ids.
An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components
from .store import mark, sweep, written

THRESHOLD, FLOOR, K, K_MAX, WINDOW, TABLES, ROUNDS, AUDIT, BLOCK, TILE = 0.93, 0.72, 12, 24, 10, 6, 8, 256, 8192, 1024
SEEN, AUDIT_MAX, EXACT = 128, 16_384, 262_144
log = logging.getLogger(__name__)
last_recall: float | None = None


def _matrix(vecs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float64).reshape(-1, dim)


def _edges(a=(), b=(), s=()) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "sim"])


def prepared(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, dim, f1, f2, vec)``; vec holds the unit vector as doubles, null if it can't link."""

    def run(batches):
        for b in batches:
            out = []
            for x in b.column("embedding").to_pylist():
                v = None if not x or any(c is None for c in x) else np.array(x, np.float64)
                if v is not None and np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
                    v = v / top  # so that squares neither vanish nor overflow
                    out.append((v / np.sqrt(v @ v)).tobytes())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in ("vec_id", "label", "dim", "f1", "f2")] + [pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "f1", "f2", "vec"])

    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.size(e).alias("dim"), F.xxhash64(F.lit(1), e).alias("f1"), F.xxhash64(F.lit(2), e).alias("f2"), e.alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label string, dim int, f1 long, f2 long, vec binary")


def first_graph(nodes: DataFrame, n: int, tables: range) -> DataFrame:
    """Edges ``(a, b, sim)`` from sorting by random-hyperplane codes."""
    bits = max(1, min(40, math.ceil(math.log2(max(2, n / 512)))))

    def planes(dim: int, table: int) -> np.ndarray:
        return np.random.default_rng([dim, table]).standard_normal((dim, bits + 1))

    def code(batches):
        for b in batches:
            dims, vecs = np.array(b.column("dim").to_pylist()), b.column("vec").to_pylist()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                rows = b.take(pa.array(at))
                x = _matrix([vecs[k] for k in at], dim)
                for table in tables:
                    y = x @ planes(dim, table)
                    codes = (y[:, :bits] > 0) @ (1 << np.arange(bits))
                    more = [pa.array(np.full(len(at), table, np.int32)), pa.array(codes.astype(np.int64)), pa.array(y[:, bits])]
                    yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("node", "label", "dim", "vec")] + more, names=["node", "label", "dim", "vec", "table", "code", "along"])

    def slide(batches):
        last: list[tuple] = []
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("label", "dim", "table", "code")), strict=True))
            rows = last + list(zip(keys, b.column("node").to_pylist(), b.column("vec").to_pylist(), strict=True))
            old, at = len(last), 0
            last = rows[-WINDOW:]
            while at < len(rows):
                stop = at
                while stop < len(rows) and rows[stop][0] == rows[at][0]:
                    stop += 1
                if stop - at > 1:
                    ids = np.array([r[1] for r in rows[at:stop]])
                    x = _matrix([r[2] for r in rows[at:stop]], rows[at][0][1])
                    for s in range(1, min(WINDOW, len(ids) - 1) + 1):
                        sim = np.einsum("ij,ij->i", x[:-s], x[s:])
                        good = np.flatnonzero((sim >= FLOOR) & (np.arange(at + s, stop) >= old))
                        if len(good):
                            yield _edges(ids[good], ids[good + s], sim[good])
                at = stop
        yield _edges()

    rows = nodes.mapInArrow(code, "node long, label string, dim int, vec binary, table int, code long, along double")
    keys = ["label", "dim", "table", "code"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "along", "node").mapInArrow(slide, "a long, b long, sim double")


def best(edges: DataFrame, k: int, threshold: float, cap: int) -> DataFrame:
    """Lists ``(u, v, sim)``: each node's ``k`` nearest of the edges ``(a, b, sim)``, in either direction, or up to ``cap`` links."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "sim").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "sim"))
    once = both.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("r") <= max(k, cap))
    return ranked.where((F.col("r") <= k) | (F.col("sim") >= threshold)).drop("r")


def neighbours_of_neighbours(lists: DataFrame, nodes: DataFrame, k: int, turn: int) -> DataFrame:
    """Edges between the neighbours of each node: up to k of its list and up to k that list it, others in each turn."""

    def some(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v", F.lit(turn)), "v"))).where(F.col("r") <= k).drop("r")

    around = some(lists.select("u", "v")).unionByName(some(lists.select(F.col("v").alias("u"), F.col("u").alias("v")))).distinct().join(nodes.select(F.col("node").alias("v"), "dim", "vec"), "v")

    def local(batches):
        rest: list[tuple] = []

        def compare(rows):
            ids = np.array([r[1] for r in rows])
            x = _matrix([r[3] for r in rows], rows[0][2])
            sim = np.triu(x @ x.T, 1)
            i, j = np.nonzero(sim >= FLOOR)
            return ids[i], ids[j], sim[i, j]

        for b in batches:
            rows = rest + list(zip(*(b.column(c).to_pylist() for c in ("u", "v", "dim", "vec")), strict=True))
            out, at = [], 0
            while at < len(rows):
                stop = at
                while stop < len(rows) and rows[stop][0] == rows[at][0]:
                    stop += 1
                if stop == len(rows):
                    break
                if stop - at > 1:
                    out.append(compare(rows[at:stop]))
                at = stop
            rest = rows[at:]  # one node's list, bounded
            if out:
                yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))
        if len(rest) > 1:
            yield _edges(*compare(rest))
        yield _edges()

    ordered = around.select("u", "v", "dim", "vec").repartition("u").sortWithinPartitions("u", "v")
    return ordered.mapInArrow(local, "a long, b long, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def descend(edges: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Refined lists."""
    lists = written(best(edges, k, threshold, K_MAX), "lists")
    n = lists.count()
    for turn in range(ROUNDS):
        if not n:
            break
        found = neighbours_of_neighbours(lists, nodes, K_MAX, turn)
        known = lists.select(F.col("u").alias("a"), F.col("v").alias("b"), "sim")
        before, lists = lists, written(best(known.unionByName(found), k, threshold, K_MAX), "lists")
        n = lists.count()
        if lists.join(before, ["u", "v"], "left_anti").count() <= 0.001 * n:
            break
    return lists


def _keyed(b: pa.RecordBatch):
    """``(label, dim)`` and row numbers of each such group in a batch."""
    of: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), strict=True)):
        of.setdefault(key, []).append(k)
    return of.items()


def in_blocks(nodes: DataFrame, threshold: float) -> DataFrame:
    """``nodes`` with ``own``, their block, once for each pair of blocks ``(i, j)`` of their label that they may have links in.

    A block is a part of a cell, the nodes nearest to one of the label's centres. The driver holds a centre for ``BLOCK`` nodes.
    """
    keys = ["label", "dim"]
    centres, cells = F.ceil(F.col("n") / BLOCK), {}
    large = nodes.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).withColumn("centres", F.when(F.col("n") > EXACT, centres).otherwise(1))
    by = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit("centre"), "node"), "node")
    for r in nodes.join(F.broadcast(large), keys).withColumn("r", F.row_number().over(by)).where(F.col("r") <= F.col("centres")).orderBy("r").collect():
        cells.setdefault((r["label"], r["dim"]), []).append(bytes(r["vec"]))
    cells = {key: _matrix(vecs, key[1]) for key, vecs in cells.items()}

    def nearest(batches):
        for b in batches:
            vecs = b.column("vec").to_pylist()
            for key, at in _keyed(b):
                y = _matrix([vecs[k] for k in at], key[1]) @ cells[key].T if key in cells else np.ones((len(at), 1))
                rows, cell = b.take(pa.array(at)), y.argmax(1)
                yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("dim"), pa.array(cell.astype(np.int32)), pa.array(y.max(1))], names=["label", "dim", "cell", "near"])

    radius, blocks = {key: np.zeros(len(c)) for key, c in cells.items()}, {key: np.zeros(len(c), np.int64) for key, c in cells.items()}
    if cells:
        for r in nodes.mapInArrow(nearest, "label string, dim int, cell int, near double").groupBy(*keys, "cell").agg(F.min("near").alias("near"), F.count("*").alias("n")).where(F.col("n") > 0).collect():
            if (key := (r["label"], r["dim"])) in cells:
                radius[key][r["cell"]], blocks[key][r["cell"]] = math.acos(max(-1.0, min(1.0, r["near"]))), math.ceil(r["n"] / BLOCK)
    names = ["label", "dim", "node", "weight", "component", "vec"]
    reach = math.acos(min(1.0, max(-1.0, threshold))) + 1e-6

    def placed(batches):
        def out(rows, own, other):
            i, j = np.minimum(own, other), np.maximum(own, other)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (i, j, own)] + [rows.column(c) for c in names], names=["i", "j", "own", *names])

        for b in batches:
            vecs = b.column("vec").to_pylist()
            for key, at in _keyed(b):
                rows = b.take(pa.array(at))
                if key not in cells:
                    none = np.zeros(len(at), np.int64)
                    yield out(rows, none, none)
                    continue
                y = np.clip(_matrix([vecs[k] for k in at], key[1]) @ cells[key].T, -1, 1)
                cell, first = y.argmax(1), np.cumsum(blocks[key]) - blocks[key]
                own = first[cell] + rows.column("part").to_numpy() % blocks[key][cell]
                for c in range(len(first)):
                    may = np.flatnonzero((cell == c) | (np.arccos(y[:, c]) <= radius[key][c] + reach))
                    if len(may):
                        some = rows.take(pa.array(may))
                        for block in range(first[c], first[c] + blocks[key][c]):
                            yield out(some, own[may], np.full(len(may), block))

    parts = nodes.select(*names, F.shiftrightunsigned(F.xxhash64("node"), 1).alias("part"))
    return parts.mapInArrow(placed, "i int, j int, own int, label string, dim int, node long, weight long, component long, vec binary")


def _bounded(x: np.ndarray) -> np.ndarray:
    """Rows whose inner products are at least those of the unit vectors ``x``: a quarter of the components, and the norm of the rest."""
    k = max(1, x.shape[1] // 4)
    return np.column_stack([x[:, :k], np.sqrt(np.einsum("ij,ij->i", x[:, k:], x[:, k:]))]).astype(np.float32)


def _near(x: np.ndarray, y: np.ndarray, bx: np.ndarray, by: np.ndarray, threshold: float) -> np.ndarray | None:
    """Which rows of x and y link, None if no bound (``bx``, ``by``) reaches the threshold; the margin is above what single precision can lose."""
    may = bx @ by.T >= np.float32(threshold - 1e-6 * (bx.shape[1] + 8))
    n = np.count_nonzero(may)
    if not n:
        return None
    if 16 * n > may.size:
        return x @ y.T >= threshold
    r, c = np.nonzero(may)
    may[r, c] = np.einsum("ij,ij->i", x[r], y[c]) >= threshold
    return may


def compared(nodes: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, linked)`` by comparison within each label and dimension of ``nodes (node, label, dim, weight, component, vec)``, block by block.

    With b null, ``linked`` is the weight of all nodes of a pair of blocks that a links with, itself included;
    the other rows are links between components, a spanning forest for each pair of blocks.
    """

    def compare(table: pa.Table) -> pa.Table:
        own, ids, weight = (table.column(c).to_numpy() for c in ("own", "node", "weight"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x = _matrix(table.column("vec").to_pylist(), table.column("dim")[0].as_py())
        bound = _bounded(x)
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        linked, tree, forest = np.zeros(len(ids), np.int64), np.unique(table.column("component").to_numpy(), return_inverse=True)[1], []
        for s in range(0, len(a), TILE):
            for t in range(s if i == j else 0, len(b), TILE):
                p, q = a[s : s + TILE], b[t : t + TILE]
                near = _near(x[p], x[q], bound[p], bound[q], threshold)
                if near is None or not near.any():
                    continue
                linked[p] += near @ weight[q]
                if i != j or s != t:
                    linked[q] += near.T @ weight[p]
                while (apart := near & (tree[p][:, None] != tree[q])).any():
                    r = np.flatnonzero(apart.any(1))
                    for u, v in zip(p[r].tolist(), q[apart[r].argmax(1)].tolist(), strict=True):
                        if tree[u] != tree[v]:
                            forest.append((u, v))
                            tree[tree == tree[v]] = tree[u]
        seen, f = np.flatnonzero(linked), np.array(forest, np.int64).reshape(-1, 2)
        late = np.arange(len(seen) + len(f)) >= len(seen)
        columns = [pa.array(ids[np.concatenate([seen, f[:, 0]])]), pa.array(ids[np.concatenate([seen, f[:, 1]])], mask=~late), pa.array(linked[np.concatenate([seen, f[:, 0]])], mask=late)]
        return pa.table(dict(zip(("a", "b", "linked"), columns, strict=True)))

    return in_blocks(nodes, threshold).groupBy("label", "dim", "i", "j").applyInArrow(compare, "a long, b long, linked long")


def _audit(nodes: DataFrame, linked: DataFrame, threshold: float, n: int) -> float | None:
    """The share of a node's links that were found, a mean over ``SEEN`` nodes with links or more; None if a sample can't tell."""
    size = AUDIT
    while size <= AUDIT_MAX and 2 * size < n:
        seen, share = _sampled(nodes, linked, threshold, size)
        if seen >= SEEN:
            return share
        size *= 8
    return None


def _sampled(nodes: DataFrame, linked: DataFrame, threshold: float, size: int) -> tuple[int, float]:
    """How many of ``size`` nodes have links, by brute force against all nodes, and the mean share of them that was found."""
    chosen = nodes.orderBy(F.xxhash64(F.lit("audit"), "node"), "node").limit(size).collect()
    groups: dict[tuple, tuple] = {}
    for key in {(r["label"], r["dim"]) for r in chosen}:
        own = [r for r in chosen if (r["label"], r["dim"]) == key]
        groups[key] = (np.array([r["node"] for r in own]), _matrix([bytes(r["vec"]) for r in own], key[1]))

    def compare(batches):
        total: dict[int, int] = {}
        for b in batches:
            keys = list(zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), strict=True))
            vecs, weight, of = b.column("vec").to_pylist(), b.column("weight").to_pylist(), {}
            for k, key in enumerate(keys):
                if key in groups:
                    of.setdefault(key, []).append(k)
            for key, at in of.items():
                ids, x = groups[key]
                near = (x @ _matrix([vecs[k] for k in at], key[1]).T >= threshold) @ np.array([weight[k] for k in at])
                for q, m in zip(ids.tolist(), near.tolist(), strict=True):
                    total[q] = total.get(q, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["node", "all"])

    truth = nodes.mapInArrow(compare, "node long, all long").groupBy("node").agg(F.sum("all").alias("all"))
    got = truth.join(nodes.select("node", "weight"), "node").join(linked, "node", "left")
    share = (F.coalesce("linked", "weight") - F.col("weight")) / (F.col("all") - F.col("weight"))
    row = got.where(F.col("all") > F.col("weight")).agg(F.count("*"), F.avg(share), F.sum(F.col("all") - F.col("weight"))).first()
    log.info("audit: %d of %d nodes have links, %s in all; mean share found %s", row[0], size, row[2], row[1])
    return row[0], row[1] or 0.0


def near_links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors (vec_id, embedding, label)``."""
    global last_recall
    since = mark()
    rows = written(prepared(vectors), "vectors")
    classes = ["label", "dim", "f1", "f2"]
    can = rows.where("vec is not null and label is not null and vec_id is not null")
    nodes = can.groupBy(*classes).agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.min("vec").alias("vec"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers are fixed once written
    bare = nodes.select("node", "label", "dim", "weight", "vec")
    n = nodes.count()
    tables = TABLES * max(1, math.ceil(math.log2(max(1, n / 65_536))))
    lists = descend(first_graph(bare, n, range(tables)), nodes, K, threshold)
    links = lists.where(F.col("sim") >= threshold)
    of = written(components(links, "u", "v"), "components")
    pairs = written(compared(bare.join(of, "node", "left").withColumn("component", F.coalesce("component", "node")), threshold), "pairs")
    linked = written(pairs.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked")), "linked")
    bridges = pairs.where("b is not null").select("a", "b")
    if bridges.head(1):
        of = written(components(of.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(bridges)), "components")
    listed, missed = links.where("u < v").count(), bridges.count()
    log.info("the descent listed %d links; the check joined what it left apart by %d more", listed, missed)
    share = _audit(bare, linked, threshold, n)
    last_recall = 1.0 if share is None else share
    sweep(vectors.sparkSession, since, [rows, nodes, linked, of])
    # components are named by node numbers so far: their smallest id names them from here on
    named = of.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("smallest"))
    of = of.join(named, "component").select("node", "smallest")
    known = nodes.join(linked, "node", "left").join(of, "node", "left").select(*classes, F.coalesce("linked", "weight").alias("linked"), F.coalesce("smallest", "first").alias("component"))
    out = rows.select("vec_id", *classes, F.expr("vec is not null and label is not null and vec_id is not null").alias("can"))
    # a null label never matches, as it must be
    out = out.join(known, classes, "left").withColumn("can", F.col("can") & F.col("component").isNotNull())
    component = F.when(F.col("can"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("can"), F.col("linked") - 1).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op4_nn_descent": op4_nn_descent}
ORACLE_SQL = {
    "op4_nn_descent": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id"""
}
