"""Encoders: column specifications, fitted on training rows, applied to any.

``transform`` lowers all continuous specifications to one plan: each row of a table is expanded to a row for each
term (the items, values or numbers that a specification reads from it), and all terms are selected, hashed, looked up
and added up together, so each table is scanned once, however many terms there are. ``fit`` takes all vocabularies from one pass and
all scalers of a table from one aggregate. Fitted state (vocabularies and scalers) is DataFrames; it is saved as
Parquet beside a JSON file of the specifications, and loads back to the same encoder.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import bucket_and_sign, hash_code
from ..operators import encode, scale, vocab
from ..operators.order import numbered
from ..operators.select import selected, top, top_bottom
from ..operators.weights import composite_key, item_weights, normalised
from ..sources.shared import written

KINDS = ("numeric", "raw", "hash", "embed", "onehot", "sparse", "vectors")


@dataclass(frozen=True)
class Spec:
    """One encoding. ``source`` is ``units`` or ``obs``; ``by`` names the weight column (null: the observations' weight); ``table`` a table of vectors."""

    kind: str
    name: str
    columns: tuple[str, ...]
    source: str = "units"
    dim: int = 32
    top: int = 0
    bottom: int = 0
    by: str | None = None
    table: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"{self.kind} is none of {', '.join(KINDS)}")
        if not self.columns:
            raise ValueError(f"{self.name} has no columns")

    @property
    def slots(self) -> int:
        """Ids for each column of an embedding; at least one."""
        return max(1, self.top + self.bottom) if self.source == "obs" else 1


class Encoder:
    """Collects specifications; ``fit`` gives an ``EncoderModel``."""

    def __init__(self, specs: list[Spec] | None = None, tables: dict[str, DataFrame] | None = None):
        self.specs, self.tables = list(specs or []), dict(tables or {})

    def _add(self, spec: Spec) -> Encoder:
        if any(s.name == spec.name for s in self.specs):
            raise ValueError(f"{spec.name} is defined twice")
        self.specs.append(spec)
        return self

    def add_numeric(self, name: str, columns: list[str], source: str = "units") -> Encoder:
        return self._add(Spec("numeric", name, tuple(columns), source))

    def add_raw(self, name: str, columns: list[str], source: str = "units") -> Encoder:
        return self._add(Spec("raw", name, tuple(columns), source))

    def add_hash(self, name: str, columns: list[str], dim: int = 32, top: int = 0, bottom: int = 0, by: str | None = None, source: str = "obs") -> Encoder:
        return self._add(Spec("hash", name, tuple(columns), source, dim, top, bottom, by))

    def add_embed(self, name: str, columns: list[str], dim: int = 16, top: int = 0, bottom: int = 0, by: str | None = None, source: str = "obs") -> Encoder:
        if source == "obs" and not top and not bottom:
            top = 1  # else nothing would be selected
        return self._add(Spec("embed", name, tuple(columns), source, dim, top, bottom, by))

    def add_sparse(self, name: str, columns: list[str], dim: int = 16, top: int = 0, bottom: int = 0, by: str | None = None, source: str = "obs") -> Encoder:
        """Shares of weight over the whole vocabulary of each column, of which the network learns a projection to ``dim``."""
        return self._add(Spec("sparse", name, tuple(columns), source, dim, top, bottom, by))

    def add_onehot(self, name: str, columns: list[str], source: str = "units") -> Encoder:
        return self._add(Spec("onehot", name, tuple(columns), source))

    def add_vectors(self, name: str, column: str, table: str, vectors: DataFrame, by: str | None = None, source: str = "obs", tune: bool = False) -> Encoder:
        """The weighted mean of the vectors ``(item, vector)`` that others have learned for a column's values.

        They stay as they are, or (``tune``) are where a sparse input's projection starts, which the network then goes on to learn.
        """
        first = vectors.select(F.size("vector")).first()
        if first is None:
            raise ValueError(f"{table} has no vectors")
        self.tables[table] = vectors.select(F.col("item").cast("string").alias("item"), F.col("vector").cast("array<double>").alias("vector"))
        return self._add(Spec("sparse" if tune else "vectors", name, (column,), source, first[0], by=by, table=table))

    def fit(self, units: DataFrame, obs: DataFrame | None = None) -> EncoderModel:
        tables = {"units": units, "obs": obs}
        for s in self.specs:
            if (rows := tables[s.source]) is None:
                raise ValueError(f"{s.name} needs observations")
            if missing := [c for c in s.columns if c not in rows.columns]:
                raise ValueError(f"{s.name}: no column {', '.join(missing)} in {s.source}")
        scalers = {}
        for source in tables:
            numeric = [s for s in self.specs if s.kind == "numeric" and s.source == source]
            if columns := list(dict.fromkeys(c for s in numeric for c in s.columns)):
                data = units if source == "units" else encode.weighted_means(obs, columns).join(units.select("unit_id"), "unit_id", "left_semi")
                found = scale.fitted(data, columns, "population").first().asDict()
                scalers |= {s.name: {k: found[k] for c in s.columns for k in (f"{c}_mean", f"{c}_scale")} for s in numeric}
        return EncoderModel(self.specs, self._vocabularies(tables), scalers, self.tables)

    def _vocabularies(self, tables: dict[str, DataFrame | None]) -> dict[str, DataFrame]:
        """The values of all columns that need ids, from one scan of each table, as parts of one written table; where vectors are given, their items."""
        values, keys = None, []
        tuned = {s.name: s for s in self.specs if s.kind == "sparse" and s.table}
        needed = {source: [(s.name, c) for s in self.specs if s.source == source and s.table is None and s.kind in ("embed", "onehot", "sparse") for c in s.columns] for source in tables}
        for s in tuned.values():
            needed.setdefault(s.table, []).append((s.name, "item"))
        for source, own in needed.items():
            rows = tables[source] if source in tables else self.tables[source]
            columns = list(dict.fromkeys(c for _, c in own))
            if not columns:
                continue
            cells = F.array(*[F.struct(F.lit(f"{source}:{c}").alias("of"), F.col(c).cast("string").alias("value")) for c in columns])
            found = rows.select(F.inline(cells)).where("value <> ''").distinct()
            values = found if values is None else values.unionByName(found)
            keys += [(f"{name}:{c}", f"{source}:{c}") for name, c in own]
        keys = [(f"{s.name}:{s.columns[0]}" if (s := tuned.get(key.partition(":")[0])) else key, of) for key, of in keys]
        if values is None:
            return {}
        placed = numbered(values, "of", "value", name="place")
        first = placed.groupBy(F.col("of").alias("_of")).agg(F.min("place").alias("_first"))  # a row for each vocabulary
        table = written(placed.join(F.broadcast(first), F.col("of") == F.col("_of")).select("of", "value", (F.col("place") - F.col("_first") + 1).alias("idx")), "vocabularies")
        return {key: table.where(F.col("of") == of).select("value", "idx") for key, of in keys}

    def fit_transform(self, units: DataFrame, obs: DataFrame | None = None) -> DataFrame:
        return self.fit(units, obs).transform(units, obs)


@dataclass(frozen=True)
class Term:
    """What one continuous specification reads from a row: its items, or one of its columns; ``at`` is its first slot."""

    spec: Spec
    column: str
    at: int


class EncoderModel:
    """A fitted encoder. ``transform`` gives the long table ``(unit_id, slot, value)`` of continuous features, ``ids`` the embedding ids."""

    def __init__(self, specs: list[Spec], vocabularies: dict[str, DataFrame], scalers: dict[str, dict], tables: dict[str, DataFrame] | None = None):
        self.specs, self.vocabularies, self.scalers, self.tables = specs, vocabularies, scalers, tables or {}
        self._sizes: dict[str, int] = {}

    def vocab_size(self, name: str, column: str) -> int:
        """Entries with the unknown one."""
        key = f"{name}:{column}"
        if key not in self._sizes:
            self._sizes[key] = self.vocabularies[key].count() + 1
        return self._sizes[key]

    def width(self, s: Spec) -> int:
        if s.kind in ("hash", "vectors"):
            return s.dim
        return sum(self.vocab_size(s.name, c) for c in s.columns) if s.kind == "onehot" else 0 if s.kind in ("embed", "sparse") else len(s.columns)

    @property
    def continuous_dim(self) -> int:
        return sum(self.width(s) for s in self.specs)

    @property
    def embeddings(self) -> list[tuple[str, str, int, int, int]]:
        """(name, column, slots, vocabulary size, dimension) of each embedding."""
        return [(s.name, c, s.slots, self.vocab_size(s.name, c), s.dim) for s in self.specs if s.kind == "embed" for c in s.columns]

    @property
    def bags(self) -> list[tuple[str, str, int, int]]:
        """(name, column, vocabulary size, dimension) of each sparse input."""
        return [(s.name, c, self.vocab_size(s.name, c), s.dim) for s in self.specs if s.kind == "sparse" for c in s.columns]

    def starts(self) -> dict[str, np.ndarray]:
        """Where the projections of sparse inputs with vectors start: a row for each id, zeros for unknown values. They become weights of the network."""
        out = {}
        for s in self.specs:
            if s.kind == "sparse" and s.table:
                key = f"{s.name}:{s.columns[0]}"
                rows = self.vocabularies[key].join(self.tables[s.table].withColumnRenamed("item", "value"), "value").select("idx", "vector").toArrow()
                out[key] = np.zeros((self.vocab_size(s.name, s.columns[0]), s.dim))
                out[key][rows.column("idx").to_numpy()] = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, s.dim)
        return out

    def sparse(self, units: DataFrame, obs: DataFrame | None, name: str, column: str) -> DataFrame:
        """``(unit_id, idx, value)``: the shares of a unit's (selected) weight in the known values; never made dense."""
        s = next((s for s in self.specs if s.name == name and s.kind == "sparse"), None)
        if s is None:
            raise KeyError(f"no sparse input {name}")
        items = self._items(s, F.col(column).cast("string"), units, obs).where("item is not null")
        shares = normalised(self._chosen(s, items), "norm")
        known = vocab.encoded(shares, "item", self.vocabularies[f"{name}:{column}"], "idx").where("idx > 0")
        return known.select("unit_id", "idx", F.col("weight").alias("value"))

    def _items(self, s: Spec, key, units: DataFrame, obs: DataFrame | None) -> DataFrame:
        if s.source == "units":
            return units.select("unit_id", key.alias("item"), F.lit(1.0).alias("weight"))
        return item_weights(obs, key, by=s.by or "weight")

    def _chosen(self, s: Spec, items: DataFrame) -> DataFrame:
        mode = "top_bottom" if s.top and s.bottom else "top" if s.top else "bottom" if s.bottom else "all"
        return selected(items, mode, s.top, s.bottom)

    def terms(self) -> list[Term]:
        """The continuous terms, in the order of their slots."""
        out, at = [], 0
        for s in self.specs:
            if s.kind in ("embed", "sparse"):
                continue
            if s.kind == "hash":
                out.append(Term(s, "", at))
            for k, c in enumerate(s.columns if s.kind not in ("hash", "vectors") else ()):
                before = sum(self.vocab_size(s.name, x) for x in s.columns[:k]) if s.kind == "onehot" else k
                out.append(Term(s, c, at + before))
            at += self.width(s)
        return out

    @staticmethod
    def _cells(terms: list[Term], source: str) -> list[Column]:
        """What a row of a table adds to each term: a key with a weight, or a weighted number; ``seen`` counts rows of observations."""

        def cell(k: int, key: Column | None = None, weight: Column | None = None, x: Column | None = None, seen: int = 0) -> Column:
            none = F.lit(None)
            values = [F.lit(k), none.cast("string") if key is None else key, none.cast("double") if weight is None else weight, none.cast("double") if x is None else x, F.lit(seen)]
            return F.struct(*[v.alias(n) for v, n in zip(values, ("term", "key", "weight", "x", "seen"), strict=True)])

        out = []
        for k, t in enumerate(terms):
            one = F.lit(1.0)
            weight = one if t.spec.source == "units" else F.coalesce(F.col(t.spec.by or "weight").cast("double"), one)
            if t.spec.source != source:
                if t.spec.kind in ("numeric", "raw"):  # units without observations have a number too
                    out.append(cell(k))
            elif t.spec.kind == "hash":
                out.append(cell(k, composite_key(*t.spec.columns), weight))
            elif t.spec.kind == "onehot":
                out.append(cell(k, F.col(t.column).cast("string"), one))
            else:
                x = F.col(t.column).try_cast("double")
                out.append(cell(k, None, F.when(x.isNotNull(), weight), x * weight, 1))
        return out

    def _expanded(self, terms: list[Term], units: DataFrame, obs: DataFrame | None) -> DataFrame:
        """``(unit_id, term, key, weight, x, seen)``: one scan of each table that a term needs."""
        out = None
        for source, rows in (("units", units), ("obs", obs)):
            if any(t.spec.source == source for t in terms) or (source == "units" and any(t.spec.kind in ("numeric", "raw") for t in terms)):
                cells = self._cells(terms, source)
                if source == "obs":
                    rows = rows.join(units.select("unit_id"), "unit_id", "left_semi") if self._units_only(terms) else rows
                part = rows.select("unit_id", F.inline(F.array(*cells)))
                out = part if out is None else out.unionByName(part)
        return out

    @staticmethod
    def _units_only(terms: list[Term]) -> bool:
        """Numbers of observations are a unit's columns, so observations of other units have no place in them."""
        return any(t.spec.source == "obs" and t.spec.kind in ("numeric", "raw") for t in terms)

    @staticmethod
    def _selected(rows: DataFrame, terms: list[Term]) -> DataFrame:
        """Summed items of each unit and term, of which those with a selection keep their heaviest or lightest."""
        keys = ["unit_id", "term", "key"]
        items = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("weight", "x", "seen")])
        each = Window.partitionBy("unit_id", "term")
        keep = F.lit(True)
        some = [(k, t.spec) for k, t in enumerate(terms) if t.spec.kind == "hash" and (t.spec.top or t.spec.bottom)]
        down, up = F.row_number().over(each.orderBy(F.desc("weight"), "key")), F.row_number().over(each.orderBy("weight", "key"))
        if any(s.top for _, s in some):
            items = items.withColumn("_down", down)
        if any(s.bottom and not s.top for _, s in some):
            items = items.withColumn("_up", up)
        if any(s.bottom and s.top for _, s in some):
            items = items.withColumn("_last", F.count("*").over(each) - F.col("_down"))
        for k, s in some:
            first = F.col("_down") <= s.top if s.top else F.lit(False)
            last = F.lit(False) if not s.bottom else F.col("_last") < s.bottom if s.top else F.col("_up") <= s.bottom
            keep = keep & ((F.col("term") != k) | first | last)
        return items.where(keep).drop("_down", "_up", "_last")

    def _placed(self, rows: DataFrame, terms: list[Term]) -> DataFrame:
        """Adds ``slot`` and ``signed``: a hashed item's bucket and signed weight, a value's id, a number's place."""
        of = {kind: [k for k, t in enumerate(terms) if t.spec.kind == kind] for kind in KINDS}
        first = F.get(F.array(*[F.lit(t.at) for t in terms]), F.col("term")).cast("long")
        slot, signed = first, F.lit(None).cast("double")
        if of["hash"]:
            hashed = F.col("term").isin(of["hash"])
            rows = rows.withColumn("_code", hash_code(F.when(hashed, F.col("key"))))
            bucket, sign = bucket_and_sign(F.col("_code"), F.get(F.array(*[F.lit(max(1, t.spec.dim)) for t in terms]), F.col("term")))
            slot, signed = F.when(hashed, first + bucket).otherwise(slot), F.when(hashed, sign * F.col("weight"))
        if of["onehot"]:
            known = None
            for k in of["onehot"]:
                one = self.vocabularies[f"{terms[k].spec.name}:{terms[k].column}"].select(F.lit(k).alias("term"), F.col("value").alias("key"), F.col("idx").alias("_idx"))
                known = one if known is None else known.unionByName(one)
            rows = rows.join(known, ["term", "key"], "left")
            slot = F.when(F.col("term").isin(of["onehot"]), first + F.coalesce("_idx", F.lit(0))).otherwise(slot)
        return rows.select("unit_id", "term", slot.alias("slot"), signed.alias("signed"), "weight", "x", "seen")

    def transform(self, units: DataFrame, obs: DataFrame | None = None) -> DataFrame:
        """``(unit_id, slot, value)``; slots of all specifications follow each other in their order."""
        terms, pooled = self.terms(), self._pooled(units, obs)
        if not terms:
            if pooled is None:
                raise ValueError("no continuous encoding")
            return pooled
        rows = self._expanded(terms, units, obs)
        if any(t.spec.kind == "hash" and (t.spec.top or t.spec.bottom) for t in terms):
            rows = self._selected(rows, terms)
        sums = self._placed(rows, terms).groupBy("unit_id", "term", "slot").agg(*[F.sum(c).alias(c) for c in ("signed", "weight", "x", "seen")])
        value = F.lit(1.0)  # a value that is there
        for k, t in enumerate(terms):
            if t.spec.kind == "hash":
                continue
            if t.spec.kind in ("numeric", "raw"):
                x = F.try_divide("x", "weight")
                x = F.when(F.col("seen") > 0, F.coalesce(x, F.lit(0.0))) if t.spec.source == "obs" else x
                if t.spec.kind == "numeric":
                    x = (x - self.scalers[t.spec.name][f"{t.column}_mean"]) / self.scalers[t.spec.name][f"{t.column}_scale"]
                value = F.when(F.col("term") == k, F.coalesce(x, F.lit(0.0))).otherwise(value)
        if hashes := [k for k, t in enumerate(terms) if t.spec.kind == "hash"]:
            total = F.sum("weight").over(Window.partitionBy("unit_id", "term"))
            value = F.when(F.col("term").isin(hashes), F.col("signed") / F.when(total < 1e-8, 1.0).otherwise(total)).otherwise(value)
        out = sums.select("unit_id", "slot", value.alias("value"))
        return out if pooled is None else out.unionByName(pooled)

    def _pooled(self, units: DataFrame, obs: DataFrame | None) -> DataFrame | None:
        """The components of pooled vectors, an aggregate for each such specification."""
        out, at = None, 0
        for s in self.specs:
            if s.kind == "vectors":
                rows = units if s.source == "units" else obs
                by = s.by or ("weight" if s.source == "obs" else None)
                one = encode.pooled_vectors(rows, self.tables[s.table], s.dim, s.columns[0], by).select("unit_id", F.posexplode("vector").alias("slot", "value"))
                one = one.select("unit_id", (F.col("slot") + at).cast("long").alias("slot"), "value")
                out = one if out is None else out.unionByName(one)
            at += self.width(s)
        return out

    def features(self, units: DataFrame, obs: DataFrame | None = None) -> DataFrame:
        """Units with an array ``features`` of ``continuous_dim`` doubles."""
        return encode.dense(units, self.transform(units, obs), self.continuous_dim)

    def ids(self, units: DataFrame, obs: DataFrame | None, name: str) -> DataFrame:
        """``(unit_id, column, slot, idx)`` of an embedding; absent slots are left out and stand for 0."""
        s = next((s for s in self.specs if s.name == name and s.kind == "embed"), None)
        if s is None:
            raise KeyError(f"no embedding {name}")
        out = None
        for c in s.columns:
            items = self._items(s, F.col(c).cast("string"), units, obs).where("item is not null")
            best = top_bottom(items, s.top, s.bottom) if s.bottom else top(items, s.slots).withColumn("slot", (F.col("rank") - 1).cast("long"))
            one = vocab.encoded(best, "item", self.vocabularies[f"{name}:{c}"], "idx").select("unit_id", F.lit(c).alias("column"), "slot", "idx")
            out = one if out is None else out.unionByName(one)
        return out

    def save(self, path: str, spark: SparkSession) -> None:
        spec = json.dumps({"specs": [asdict(s) for s in self.specs], "scalers": self.scalers})
        spark.createDataFrame([(spec,)], "encoder string").coalesce(1).write.mode("overwrite").text(f"{path}/encoder")
        rows = spark.createDataFrame([], "vocabulary string, value string, idx long")
        for key, df in self.vocabularies.items():
            rows = rows.unionByName(df.select(F.lit(key).alias("vocabulary"), F.col("value").cast("string").alias("value"), "idx"))
        rows.write.mode("overwrite").parquet(f"{path}/vocabularies")
        rows = spark.createDataFrame([], "name string, item string, vector array<double>")
        for name, df in self.tables.items():
            rows = rows.unionByName(df.select(F.lit(name).alias("name"), "item", "vector"))
        rows.write.mode("overwrite").parquet(f"{path}/tables")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> EncoderModel:
        found = json.loads(spark.read.text(f"{path}/encoder").first()[0])
        specs = [Spec(**(s | {"columns": tuple(s["columns"])})) for s in found["specs"]]
        rows, tables = spark.read.parquet(f"{path}/vocabularies"), spark.read.parquet(f"{path}/tables")
        keys = [f"{s.name}:{c}" for s in specs if s.kind in ("embed", "onehot", "sparse") for c in s.columns]
        return cls(specs, {k: rows.where(F.col("vocabulary") == k).select("value", "idx") for k in keys}, found["scalers"], {n: tables.where(F.col("name") == n).select("item", "vector") for n in {s.table for s in specs if s.table}})
