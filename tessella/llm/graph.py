"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Each step links every node to the smallest neighbour it knows; the edge list
never outgrows its first size by more than a constant, and converges to stars
whose centres are the components' smallest nodes in a number of rounds that is
logarithmic in practice. Minima are partial aggregates, so the centre of a huge
star is no single task's work; each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import mark, sweep, written


def _smallest(edges: DataFrame) -> DataFrame:
    """``(u, m)``: the smallest of each node and its neighbours; ``edges`` holds both directions."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest one."""
    both = _both(edges)
    out = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node with an edge to another; component is the smallest node reachable."""
    since = mark()
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())
    seen = None
    while (look := print_of(now)) != seen:
        seen = look
        now = written(_small_star(_large_star(now)), "edges")
        sweep(now.sparkSession, since, [now])
    # now every edge leads from a node to its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
