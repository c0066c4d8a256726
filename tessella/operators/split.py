"""Seeded splits that any engine can repeat: units are ordered by their hash, not by a random generator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_column
from .order import numbered


def shuffled(units: DataFrame, seed: int) -> DataFrame:
    """Adds ``position``, a unit's place from 1 in an order that the seed determines."""
    keyed = units.withColumn("_text", F.concat(F.lit(f"{seed}|"), F.col("unit_id").cast("string"))).withColumn("_h", hash_column("_text", 0))
    return numbered(keyed, "_h", "unit_id", name="position").drop("_text", "_h")


def train_test(units: DataFrame, test_share: float, seed: int) -> DataFrame:
    """Adds ``is_test``: the last floor(n * share) units of the shuffled order."""
    placed = shuffled(units, seed)
    n = placed.agg(F.count("*").alias("n"))
    both = placed.crossJoin(F.broadcast(n))  # one row
    return both.withColumn("is_test", F.col("position") > F.col("n") - F.floor(F.col("n") * test_share)).drop("n", "position")


def folds(units: DataFrame, k: int, seed: int) -> DataFrame:
    """Adds ``fold`` from 0 to k - 1 without any sort: the unit's hash modulo k."""
    text = units.withColumn("_text", F.concat(F.lit(f"{seed}|"), F.col("unit_id").cast("string")))
    return text.withColumn("fold", (hash_column("_text", 0) % k).cast("long")).drop("_text")


def class_codes(units: DataFrame, column: str) -> DataFrame:
    """Adds ``code`` from 0 in binary order of the classes; a missing class has none."""
    classes = units.where(F.col(column).isNotNull()).select(column).distinct()
    codes = numbered(classes, column, name="code").withColumn("code", F.col("code") - 1)
    return units.join(codes, column, "left")
