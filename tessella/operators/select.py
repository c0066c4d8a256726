"""The heaviest and lightest items of each unit.

Ties are broken by item, so every result is determined. Ranks that are only
compared with a bound are planned as group-limited windows: each task keeps k rows of a unit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(items: DataFrame, heaviest: bool, by: str, ties: list[str]) -> DataFrame:
    order = F.desc(by) if heaviest else F.asc(by)
    return items.withColumn("rank", F.row_number().over(Window.partitionBy("unit_id").orderBy(order, *ties)))


def top(items: DataFrame, k: int, by: str = "weight", ties: list[str] | None = None) -> DataFrame:
    return _ranked(items, True, by, ties or ["item"]).where(F.col("rank") <= k)


def bottom(items: DataFrame, k: int, by: str = "weight", ties: list[str] | None = None) -> DataFrame:
    return _ranked(items, False, by, ties or ["item"]).where(F.col("rank") <= k)


def top_bottom(items: DataFrame, k_top: int, k_bottom: int, by: str = "weight") -> DataFrame:
    """The heaviest items in slots 0 to k_top - 1, then the lightest of the others from slot k_top on, lightest first.

    The item that is n-th from the end in the order of weight is the n-th lightest. Both ends are group-limited windows, so no
    unit's items are all ranked in one place; how many a unit has is an aggregate with map-side parts.
    """
    up = Window.partitionBy("unit_id").orderBy(F.asc(by), F.desc("item"))
    heaviest = top(items, k_top, by).withColumn("slot", (F.col("rank") - 1).cast("long")).drop("rank")
    lightest = items.withColumn("rank", F.row_number().over(up)).where(F.col("rank") <= k_bottom)
    # where a unit holds few items, those that are among the heaviest too are no longer among the lightest
    sizes = items.groupBy("unit_id").agg(F.count("*").alias("_size"))
    rest = lightest.join(sizes, "unit_id").where(F.col("_size") - F.col("rank") >= k_top)
    rest = rest.withColumn("slot", (k_top + F.col("rank") - 1).cast("long")).select(heaviest.columns)
    return heaviest.unionByName(rest)


def slotted(items: DataFrame, mode: str = "all", k_top: int = 0, k_bottom: int = 0) -> DataFrame:
    """The selected items with their places as ``slot``: heaviest first, for ``bottom`` lightest first."""
    if mode == "top_bottom":
        return top_bottom(items, k_top, k_bottom)
    ranked = top(items, k_top) if mode == "top" else bottom(items, k_bottom) if mode == "bottom" else _ranked(items, True, "weight", ["item"])
    return ranked.withColumn("slot", (F.col("rank") - 1).cast("long")).drop("rank")


def selected(items: DataFrame, mode: str = "all", k_top: int = 0, k_bottom: int = 0) -> DataFrame:
    if mode == "all":
        return items
    if mode == "top":
        return top(items, k_top).drop("rank")
    if mode == "bottom":
        return bottom(items, k_bottom).drop("rank")
    return top_bottom(items, k_top, k_bottom).drop("slot")
