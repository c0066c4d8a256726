"""Which column plays which part."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import to_double

TASKS, TRANSFORMS = ("regression", "classification"), ("none", "log1p", "sqrt")


@dataclass(frozen=True)
class Roles:
    """Column names of the units table and of the observations table.

    ``unit`` identifies units in both tables unless ``obs_unit`` names it differently in
    the observations. Coordinates come as a pair or not at all, ordered latitude, longitude.
    """

    unit: str
    item: str
    obs_unit: str | None = None
    weight: str | None = None
    genus: str | None = None
    family: str | None = None
    latitude: str | None = None
    longitude: str | None = None
    covariates: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.unit or not self.item:
            raise ValueError("roles need a unit column and an item column")
        if (self.latitude is None) != (self.longitude is None):
            raise ValueError("latitude and longitude come together")

    @property
    def has_coordinates(self) -> bool:
        return self.latitude is not None

    @property
    def has_taxonomy(self) -> bool:
        return self.genus is not None and self.family is not None

    @property
    def has_weight(self) -> bool:
        return self.weight is not None

    def check(self, units: DataFrame, obs: DataFrame) -> None:
        """Raises a ValueError that names every missing column."""
        need = {"units": [self.unit, self.latitude, self.longitude, *self.covariates], "observations": [self.obs_unit or self.unit, self.item, self.weight, self.genus, self.family]}
        for table, df in (("units", units), ("observations", obs)):
            if missing := [c for c in need[table] if c and c not in df.columns]:
                raise ValueError(f"{table} lack {', '.join(missing)}")

    def units_of(self, units: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """``unit_id``, coordinates, covariates and the columns to keep; rows without an id are malformed and go."""
        columns = [F.col(self.unit).alias("unit_id")]
        if self.has_coordinates:
            columns += [to_double(self.latitude, 0.0).alias("latitude"), to_double(self.longitude, 0.0).alias("longitude")]
        columns += [to_double(c, 0.0).alias(c) for c in self.covariates] + [F.col(c) for c in keep]
        return units.select(*columns).where("unit_id is not null")

    def obs_of(self, obs: DataFrame) -> DataFrame:
        """``unit_id``, ``item``, ``weight`` (1 where missing) and, if mapped, ``genus`` and ``family``."""
        columns = [F.col(self.obs_unit or self.unit).alias("unit_id"), F.col(self.item).cast("string").alias("item")]
        columns.append((to_double(self.weight, 1.0) if self.weight else F.lit(1.0)).alias("weight"))
        columns += [F.col(c).alias(name) for name, c in (("genus", self.genus), ("family", self.family)) if c]
        return obs.select(*columns).where("unit_id is not null and item is not null")


@dataclass(frozen=True)
class Target:
    """What is to be learned."""

    name: str
    task: str = "regression"
    transform: str = "none"
    num_classes: int = 0
    weight: float = 1.0
    class_weights: tuple[float, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.task not in TASKS or self.transform not in TRANSFORMS:
            raise ValueError(f"{self.name}: task is one of {TASKS}, transform one of {TRANSFORMS}")

    @classmethod
    def regression(cls, name: str, transform: str = "none", weight: float = 1.0) -> Target:
        return cls(name, "regression", transform, weight=weight)

    @classmethod
    def classification(cls, name: str, num_classes: int, weight: float = 1.0, class_weights: tuple[float, ...] = ()) -> Target:
        return cls(name, "classification", num_classes=num_classes, weight=weight, class_weights=class_weights)

    @classmethod
    def parse(cls, text: str) -> Target:
        """``COL:TYPE``, split at the first colon; TYPE is regression, regression:log1p, regression:sqrt or classification:N."""
        name, _, kind = text.partition(":")
        task, _, rest = (kind or "regression").partition(":")
        return cls.classification(name, int(rest or 0)) if task == "classification" else cls(name, task, rest or "none")
