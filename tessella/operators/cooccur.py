"""Items that occur together, for units of any size.

Counting goes in passes, each of which leaves less to the next (Park, Chen and Yu, 1995): items in fewer units than the
least count can be in no frequent pair; of the other items' pairs only the numbers of pairs in ``BUCKETS`` hash buckets are counted, which
is a small table; then only pairs of frequent buckets are counted themselves. A unit's items are dealt into
blocks of about ``BLOCK``, and each pair of blocks is a group of its own, so one large unit's pairs are made in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

BLOCK, BUCKETS = 512, 1 << 20


def _blocks(once: DataFrame, block: int) -> DataFrame:
    """``(unit_id, left, right, whole)``: sorted items of two blocks of a unit; with ``whole`` they are the same block."""
    sizes = once.groupBy("unit_id").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    dealt = once.join(sizes, "unit_id").withColumn("own", F.pmod(F.xxhash64("item"), F.col("n")).cast("int"))
    blocks = dealt.groupBy("unit_id", "n", "own").agg(F.array_sort(F.collect_list("item")).alias("items"))
    alone = blocks.where("n = 1").select("unit_id", F.col("items").alias("left"), F.col("items").alias("right"), F.lit(True).alias("whole"))
    met = blocks.where("n > 1").select("unit_id", "own", "items", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    met = met.select("unit_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "items")
    sides = [F.max(F.when(F.col("own") == F.col(k), F.col("items"))).alias(name) for k, name in (("i", "left"), ("j", "right"))]
    met = met.groupBy("unit_id", "i", "j").agg(*sides).where("left is not null and right is not null")
    return alone.unionByName(met.select("unit_id", "left", "right", (F.col("i") == F.col("j")).alias("whole")))


def _pairs(blocks: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: a row for each pair of items of a unit."""
    rest = F.when(F.col("whole"), F.slice("right", F.col("pos") + 2, F.size("right"))).otherwise(F.col("right"))
    first = blocks.select(F.posexplode("left").alias("pos", "x"), "right", "whole").select("x", rest.alias("rest"))
    return first.select("x", F.explode("rest").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("a", "b"), F.lit(buckets)).cast("int")


def cooccurrence(obs: DataFrame, min_count: int = 1, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """``(a, b, n)``, a < b: in how many units two items occur together, if in ``min_count`` at least. Rows without an item or unit are left out."""
    once = obs.select("unit_id", "item").where("unit_id is not null and item is not null").distinct()
    filtered = False
    if min_count > 1:
        often = written(once.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).select("item"), "often")
        n = often.count()
        filtered = n * (n - 1) // 2 > buckets  # else the pairs that can occur are no more than buckets are
        once = once.join(often, "item", "left_semi")
    blocks = written(_blocks(once, block), "blocks") if filtered else _blocks(once, block)
    pairs = _pairs(blocks)
    if filtered:
        full = pairs.groupBy(_bucket(buckets).alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count).select("bucket")
        full = F.broadcast(written(full, "full"))  # at most ``buckets`` numbers
        pairs = pairs.withColumn("bucket", _bucket(buckets)).join(full, "bucket", "left_semi").select("a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
