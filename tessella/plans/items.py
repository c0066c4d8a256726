"""One call for a unit's items: selection, representation, normalisation, hashing or sparse vectors, unknown items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import encode, vocab
from ..operators.select import selected, slotted
from ..operators.weights import item_weights, normalised

SELECTIONS, REPRESENTATIONS, NORMS, AGGREGATIONS = ("top", "bottom", "top_bottom", "all"), ("hash", "embed", "sparse", "presence"), ("raw", "norm", "log1p"), ("weight", "count")


@dataclass(frozen=True)
class ItemEncoder:
    """``fit`` fixes the vocabulary (items in at least ``min_units`` units); ``transform`` gives ``(unit_id, slot, value)``."""

    dim: int = 32
    k: int = 3
    selection: str = "top"
    representation: str = "hash"
    norm: str = "norm"
    aggregation: str = "weight"
    min_units: int = 1

    def __post_init__(self) -> None:
        for value, known in ((self.selection, SELECTIONS), (self.representation, REPRESENTATIONS), (self.norm, NORMS), (self.aggregation, AGGREGATIONS)):
            if value not in known:
                raise ValueError(f"{value} is none of {', '.join(known)}")

    @property
    def slots(self) -> int:
        return 2 * self.k if self.selection == "top_bottom" else self.k

    def fit(self, obs: DataFrame) -> FittedItems:
        return FittedItems(self, vocab.in_units(obs, "item", self.min_units))


class FittedItems:
    def __init__(self, config: ItemEncoder, vocabulary: DataFrame):
        self.config, self.vocabulary = config, vocabulary

    def transform(self, obs: DataFrame) -> DataFrame:
        c = self.config
        weights = item_weights(obs, mode=c.aggregation)
        if c.representation == "embed":
            return encode.ids_of(slotted(weights, c.selection, c.k, c.k), self.vocabulary).withColumnRenamed("idx", "value")
        items = normalised(selected(weights, c.selection, c.k, c.k), c.norm)
        if c.representation == "hash":
            return encode.hashed_items(items, c.dim)
        return encode.sparse_vector(items, self.vocabulary, c.representation == "presence").withColumnRenamed("idx", "slot")

    def unknown(self, obs: DataFrame) -> DataFrame:
        """``(unit_id, unknown_fraction, unknown_count, confidence)``."""
        return vocab.unknown_share(obs, self.vocabulary)
