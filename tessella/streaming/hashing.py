"""Hash features of a stream: the encoding is a sum, so windows of a stream add up to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket_and_sign, hash_code


def windowed_hash(events: DataFrame, dim: int, window: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """``(window, unit_id, slot, value)`` of ``(ts, unit_id, item, weight)``, for streams (with a watermark) and tables alike."""
    bucket, sign = bucket_and_sign(F.col("_code"), dim)
    rows = events.withWatermark(time, late).where("item is not null").withColumn("_code", hash_code("item")).select(time, "unit_id", bucket.alias("slot"), (sign * F.coalesce("weight", F.lit(1.0))).alias("w"))
    return rows.groupBy(F.window(time, window).alias("window"), "unit_id", "slot").agg(F.sum("w").alias("value"))
