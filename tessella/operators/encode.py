"""Encodings, as long tables ``(unit_id, slot, value)``; they become arrays only where a model reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bucket_and_sign, hash_code
from .select import selected, slotted, top
from .vocab import encoded
from .weights import item_weights, normalised


def hashed_rows(items: DataFrame, dim: int) -> DataFrame:
    """Adds ``slot`` and ``sign`` of each row's item; rows without an item are left out. A map: nothing is scanned twice or joined."""
    bucket, sign = bucket_and_sign(F.col("_code"), dim)
    return items.where("item is not null").withColumn("_code", hash_code("item")).withColumns({"slot": bucket, "sign": sign}).drop("_code")


def hashed_items(items: DataFrame, dim: int) -> DataFrame:
    """``(unit_id, slot, value)`` of weighted items: each adds its signed weight to its bucket."""
    return hashed_rows(items, dim).groupBy("unit_id", "slot").agg(F.sum(F.col("sign") * F.col("weight")).alias("value"))


def hash_features(obs: DataFrame, dim: int = 32, mode: str = "all", k_top: int = 0, k_bottom: int = 0, norm: str = "norm", key="item", dedupe: str = "item") -> DataFrame:
    """Feature hashing of each unit's (selected) items; ``dedupe='record'`` selects among records instead of summed items.

    Without a selection the encoding is a sum over rows, raw or divided by a unit's total, so rows go straight to
    their buckets with map-side sums, and no weight per item is ever shuffled.
    """
    if mode == "all" and norm in ("raw", "norm"):
        rows = obs.select("unit_id", (F.col(key) if isinstance(key, str) else key).alias("item"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
        signed = hashed_rows(rows, dim).groupBy("unit_id", "slot").agg(F.sum(F.col("sign") * F.col("weight")).alias("value"), F.sum("weight").alias("_total"))
        if norm == "raw":
            return signed.drop("_total")
        total = F.sum("_total").over(Window.partitionBy("unit_id"))
        return signed.select("unit_id", "slot", (F.col("value") / F.when(total < 1e-8, 1.0).otherwise(total)).alias("value"))
    items = item_weights(obs, key) if dedupe == "item" else obs.select("unit_id", "item", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return hashed_items(normalised(selected(items, mode, k_top, k_bottom), norm), dim)


def ids_of(items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(unit_id, slot, idx)`` of selected items that have a slot."""
    return encoded(items, "item", vocabulary, "idx").select("unit_id", "slot", "idx")


def embed_slots(obs: DataFrame, vocabulary: DataFrame, k: int, key="item") -> DataFrame:
    """``(unit_id, slot, idx)``: the ids of a unit's k heaviest items in order."""
    return ids_of(slotted(item_weights(obs, key), "top", k), vocabulary)


def taxonomy_slots(obs: DataFrame, genera: DataFrame, families: DataFrame, k: int) -> DataFrame:
    """``(unit_id, slot, genus_id, family_id)`` of a unit's k heaviest records."""
    best = top(obs, k, ties=["item", "genus", "family"])
    rows = encoded(encoded(best, "genus", genera, "genus_id"), "family", families, "family_id")
    return rows.select("unit_id", (F.col("rank") - 1).cast("long").alias("slot"), "genus_id", "family_id")


def sparse_vector(obs: DataFrame, vocabulary: DataFrame, presence: bool = False) -> DataFrame:
    """``(unit_id, idx, value)``: summed weight, or 1, of each vocabulary item of a unit; unknown items share idx 0."""
    rows = encoded(item_weights(obs), "item", vocabulary, "idx")
    return rows.groupBy("unit_id", "idx").agg((F.lit(1.0) if presence else F.sum("weight")).alias("value"))


def sparse_projection(vector: DataFrame, matrix: DataFrame) -> DataFrame:
    """``(unit_id, slot, value)``: the product with ``matrix (idx, slot, weight)`` as a join and a sum; nothing is made dense.

    The matrix has a row for each item and slot, which the planner's estimate leaves out, so it is shuffled at any size and never gathered in the driver.
    """
    return vector.join(matrix.hint("merge"), "idx").groupBy("unit_id", "slot").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def onehot(units: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """``(unit_id, slot, value)`` with a 1 at the value's id; unknown values stand at slot 0."""
    return encoded(units, column, vocabulary, "slot").select("unit_id", "slot", F.lit(1.0).alias("value"))


def multihot(obs: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """The same for all values that a unit's observations have."""
    return encoded(obs, column, vocabulary, "slot").select("unit_id", "slot").distinct().withColumn("value", F.lit(1.0))


def weighted_mean(obs: DataFrame, column: str) -> DataFrame:
    """``(unit_id, value)``: a numeric column of the observations, averaged by weight."""
    w, x = F.coalesce("weight", F.lit(1.0)), F.col(column)
    have = F.when(x.isNotNull(), w)
    return obs.groupBy("unit_id").agg(F.coalesce(F.try_divide(F.sum(x * w), F.sum(have)), F.lit(0.0)).alias("value"))


def weighted_means(obs: DataFrame, columns: list[str]) -> DataFrame:
    """``(unit_id, *columns)``: numeric columns of the observations, averaged by weight, in one aggregate; 0 where a unit has no value."""
    w = F.coalesce("weight", F.lit(1.0))
    mean = lambda x: F.coalesce(F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w))), F.lit(0.0))
    return obs.groupBy("unit_id").agg(*[mean(F.col(c).try_cast("double")).alias(c) for c in columns])


def pooled_vectors(rows: DataFrame, vectors: DataFrame, dim: int, key: str = "item", by: str | None = None) -> DataFrame:
    """``(unit_id, vector, unknown_fraction)``: the weighted mean of the vectors of a unit's items, from a table ``(item, vector)`` of others.

    Components are summed one by one with map-side parts, so no row per component is made. Items without a vector count as unknown; a unit without any known item has zeros.
    """
    fits = F.when(F.size("vector") == dim, F.col("vector").cast("array<double>")).otherwise(F.raise_error(F.lit(f"a vector has not {dim} components")).cast("array<double>"))
    known = vectors.where("item is not null").select(F.col("item").cast("string").alias("_item"), fits.alias("_v"))
    weight = F.coalesce(F.col(by).cast("double"), F.lit(1.0)) if by else F.lit(1.0)
    both = rows.select("unit_id", F.col(key).cast("string").alias("_item"), weight.alias("_w")).join(known, "_item", "left")
    total, held = F.sum("_w"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_w")))
    sums = both.groupBy("unit_id").agg(total.alias("_total"), held.alias("_held"), *[F.sum(F.col("_w") * F.get("_v", F.lit(k))).alias(f"_s{k}") for k in range(dim)])
    mean = F.array(*[F.coalesce(F.try_divide(f"_s{k}", "_held"), F.lit(0.0)) for k in range(dim)])
    return sums.select("unit_id", mean.alias("vector"), (1 - F.coalesce(F.try_divide(F.coalesce("_held", F.lit(0.0)), F.col("_total")), F.lit(0.0))).alias("unknown_fraction"))


def assembled(units: DataFrame, columns: list[str], per_unit: DataFrame | None = None, extra: list[str] | None = None, out: str = "features") -> DataFrame:
    """``(unit_id, features)``: numeric columns of the units, then those of a table with a row per unit; what is missing is 0."""
    extra = extra or []
    both = units if per_unit is None else units.join(per_unit.select("unit_id", *extra), "unit_id", "left")
    return both.select("unit_id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in [*columns, *extra]]).alias(out))


def dense(units: DataFrame, features: DataFrame, dim: int, out: str = "features") -> DataFrame:
    """Units with an array of ``dim`` doubles from a long table; absent slots are 0. Groups are bounded by ``dim``."""
    slots = features.groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), "value"))).alias("m"))
    array = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return units.join(slots, "unit_id", "left").withColumn(out, array).drop("m")
