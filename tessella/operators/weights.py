"""Weights of items in units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def composite_key(*columns: str) -> Column:
    """Parts joined by a colon; absent parts are left out."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])


def item_weights(obs: DataFrame, key: Column | str = "item", by: str = "weight", mode: str = "weight") -> DataFrame:
    """``(unit_id, item, weight)``: one row for each item of a unit; weights add up, or rows are counted. One shuffle with map-side sums."""
    key = F.col(key) if isinstance(key, str) else key
    total = F.sum(F.coalesce(F.col(by), F.lit(1.0))) if mode == "weight" else F.count("*").cast("double")
    return obs.groupBy("unit_id", key.alias("item")).agg(total.alias("weight"))


def normalised(items: DataFrame, mode: str = "raw", tiny: float = 1e-8) -> DataFrame:
    """Weights as they are, as shares of their unit's total (a tiny total counts as 1), or as log1p."""
    if mode == "raw":
        return items
    if mode == "log1p":
        return items.withColumn("weight", F.log1p("weight"))
    total = F.sum("weight").over(Window.partitionBy("unit_id"))
    return items.withColumn("weight", F.col("weight") / F.when(total < tiny, 1.0).otherwise(total))
