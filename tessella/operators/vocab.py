"""Vocabularies: values and their ids from 1; 0 stands for anything else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import numbered

UNKNOWN = 0


def _numbered(values: DataFrame, *order) -> DataFrame:
    return numbered(values, *order, name="idx").select("value", "idx")


def _counted(rows: DataFrame, column: str, n) -> DataFrame:
    """``(value, n)`` of a column's values; missing and empty ones never."""
    return rows.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(n.alias("n"))


def alphabetical(rows: DataFrame, column: str, min_count: int = 1) -> DataFrame:
    """``(value, idx)`` in binary order of the values that occur ``min_count`` times; empty ones never."""
    return _numbered(_counted(rows, column, F.count("*")).where(F.col("n") >= min_count), "value")


def by_frequency(rows: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """``(value, idx)`` from the most frequent value on, ties in binary order."""
    out = _numbered(_counted(rows, column, F.count("*")), F.desc("n"), "value")
    return out.where(F.col("idx") <= top) if top else out


def in_units(obs: DataFrame, column: str, min_units: int) -> DataFrame:
    """``(value, idx)`` of the values found in at least ``min_units`` units."""
    return _numbered(_counted(obs, column, F.count_distinct("unit_id")).where(F.col("n") >= min_units), "value")


def encoded(rows: DataFrame, column: str, vocabulary: DataFrame, out: str) -> DataFrame:
    """Adds the id of a column's value. The planner broadcasts the vocabulary if its size allows."""
    known = vocabulary.select(F.col("value").alias(column), F.col("idx").alias(out))
    return rows.join(known, column, "left").withColumn(out, F.coalesce(F.col(out), F.lit(UNKNOWN).cast("long")))


def unknown_share(obs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Per unit: the share of weight in items that the vocabulary lacks, how many such rows, and the confidence that is left."""
    rows = encoded(obs, "item", vocabulary, "idx")
    weight, lost = F.coalesce("weight", F.lit(1.0)), F.col("idx") == UNKNOWN
    share = F.coalesce(F.try_divide(F.sum(F.when(lost, weight).otherwise(0.0)), F.sum(weight)), F.lit(0.0))
    out = rows.groupBy("unit_id").agg(share.alias("unknown_fraction"), F.count_if(lost).alias("unknown_count"))
    return out.withColumn("confidence", 1 - F.col("unknown_fraction"))
