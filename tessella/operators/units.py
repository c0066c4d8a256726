"""Units and their observations: joins and filters on one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite


def with_observations(units: DataFrame, per_unit: DataFrame, fill: dict[str, float | int]) -> DataFrame:
    """Every unit once, with columns computed per unit; units without observations get the fill values."""
    return units.join(per_unit, "unit_id", "left").fillna(fill)


def first_occurrence(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in a total order; a window with a group limit, so one row per key and task is shuffled on."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def restrict(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose unit is among ``ids``."""
    return df.join(ids.select("unit_id").distinct(), "unit_id", "left_semi")


def requested(df: DataFrame, ids: list) -> DataFrame:
    """``df``'s rows for a caller's list of ids, with ``place`` (from 0) in the list's order.

    Ids may repeat and may have no rows: each place has a row, with nulls where there is nothing. The list is the caller's own, so it is broadcast.
    """
    kind = dict(df.dtypes)["unit_id"]
    asked = df.sparkSession.createDataFrame(list(enumerate(ids)), f"place long, unit_id {kind}")
    some = df.join(F.broadcast(asked.select("unit_id").distinct()), "unit_id", "left_semi")
    return asked.join(some, "unit_id", "left").select("place", *df.columns)


def has_target(target: str) -> Column:
    return finite(F.col(target).cast("double"))


def filter_by_target(units: DataFrame, obs: DataFrame, target: str, categorical: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both tables without the units that lack the target."""
    kept = units.where(F.col(target).isNotNull() if categorical else has_target(target))
    return kept, restrict(obs, kept)


def observations_of(obs: DataFrame, unit_id) -> DataFrame:
    """A point lookup; the filter reaches the scan."""
    return obs.where(F.col("unit_id") == unit_id)


def unknown_items(obs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return obs.join(vocabulary.select(F.col("value").alias("item")), "item", "left_anti")


def schema_summary(units: DataFrame, obs: DataFrame) -> DataFrame:
    """One row of counts; each side is a single aggregate."""
    empty = lambda c: F.count_distinct(F.when(F.col(c) != "", F.col(c)))
    names = [c for c in ("genus", "family") if c in obs.columns]
    of_obs = obs.agg(F.count("*").alias("n_obs"), empty("item").alias("n_items"), *[empty(c).alias(f"n_{c}") for c in names])
    return units.agg(F.count("*").alias("n_units")).crossJoin(of_obs)  # one row each
