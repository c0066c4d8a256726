"""Scalers: one aggregate to fit, a projection to apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-8


def fitted(df: DataFrame, columns: list[str], kind: str = "sample") -> DataFrame:
    """One row with mean and scale of each column; missing values don't count.

    ``sample``: sample deviation + 1e-8 (a single row: 1e-8); ``sample_guarded``: sample deviation, 1 if below 1e-8;
    ``population``: population deviation, 1 if below 1e-8, and (0, 1) without any value.
    """
    out = []
    for c in columns:
        x = F.col(c).cast("double")
        sd = F.coalesce(F.stddev_pop(x) if kind == "population" else F.stddev_samp(x), F.lit(0.0))
        scale = sd + TINY if kind == "sample" else F.when(sd < TINY, 1.0).otherwise(sd)
        out += [F.coalesce(F.avg(x), F.lit(0.0)).alias(f"{c}_mean"), scale.alias(f"{c}_scale")]
    return df.agg(*out)


def scaled(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as (x - mean) / scale; what is missing becomes 0 afterwards."""
    both = df.crossJoin(F.broadcast(scaler))  # one row
    z = {c: F.coalesce((F.col(c).cast("double") - F.col(f"{c}_mean")) / F.col(f"{c}_scale"), F.lit(0.0)) for c in columns}
    return both.withColumns(z).drop(*scaler.columns)


def unscaled(x: Column, mean: Column | float, scale: Column | float) -> Column:
    return x * scale + mean


def restored(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """What ``scaled`` came from."""
    both = df.crossJoin(F.broadcast(scaler))  # one row
    return both.withColumns({c: unscaled(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_scale")) for c in columns}).drop(*scaler.columns)
