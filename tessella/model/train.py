"""Training and prediction on encoded units.

Features, targets and scalers are computed by Spark. All labelled units train: they are dealt into shards once, and
every pass works on all shards at the same time (``passes``), so the driver holds weights only. Prediction runs on the
executors, a batch at a time, with the weights broadcast.
"""

from __future__ import annotations

import io
import json
import pickle
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import to_double
from ..operators import metrics, split, vocab
from ..operators.calibrate import temperature
from ..operators.loss import PHASES, PRESETS as LOSSES, Phase
from ..plans.encoder import EncoderModel
from ..plans.formula import lowered
from ..sources.roles import Target
from ..sources.cache import Cache
from ..sources.shared import written
from . import passes
from .nn import AdamW, Bags, Network, UnitRandom
from .objective import Objective, restored
from .schedules import cosine_lr, onecycle_lr, step_lr

#: The default loss: absolute error, then with a share of SMAPE, then also with a band penalty; phases begin at the boundaries.
PHASED = (Phase(mae=1.0), Phase(mae=1.0, smape=0.2), Phase(mae=1.0, smape=0.15, band=0.05))
#: Fixed values. Named sizes, as first and last hidden width (each is half of the one before), and what all of them train with.
PRESETS = {"tiny": (128, 64), "small": (256, 64), "medium": (512, 64), "large": (1024, 64), "xl": (2048, 64), "max": (2048, 32)}
COMMON = {"epochs": 1000, "patience": 50, "batch": 16384, "lr": 1e-3, "dropout": 0.1, "test_share": 0.2, "seed": 42, "loss": "combined", "decay": 1e-5}


def preset_keywords(name: str, checkpoint: str | None = None, checkpoint_every: int = 50) -> dict:
    """The keyword arguments of ``Trainer`` that a named size stands for, with a place for checkpoints if one is given."""
    if name not in PRESETS:
        raise ValueError(f"{name} is none of {', '.join(PRESETS)}")
    width, last = PRESETS[name]
    hidden = tuple(width >> k for k in range(width.bit_length() - last.bit_length() + 1))
    return COMMON | {"hidden": hidden} | ({"checkpoint": checkpoint, "checkpoint_every": checkpoint_every} if checkpoint else {})


@dataclass
class Result:
    best_epoch: int = 0
    best_loss: float = float("inf")
    history: list[dict] = field(default_factory=list)


class Trainer:
    """``fit`` on units and observations, then ``predict``; ``save`` and ``load`` keep everything that either needs.

    ``unknown_features`` adds two inputs: the share of a unit's weight in items that are unknown (found in fewer than
    ``min_units`` units, or not seen in training), and the number of such rows. ``clip`` bounds the gradient's norm;
    ``min_delta`` is the least gain that counts as one; the rate rises over the first ``warmup`` epochs. With ``checkpoint``
    everything is saved there every ``checkpoint_every`` epochs: ``load`` it and ``fit(.., resume=True)`` goes on.
    A step is taken after ``accumulate`` batches; ``shards`` is how many parts of the units train side by side between two
    averages of the weights (null: as many as the units' number and size ask for). With ``calibrate`` the confidences of classes
    come from scores divided by a temperature that is fitted on the held-out units. ``tables`` holds the vectors that a formula names.
    With ``cache``, a folder, the encoded units are kept there and read again while files, formula and split are the same.
    """

    def __init__(self, formula: str, targets: list[Target], hidden: tuple[int, ...] = (64, 32), epochs: int = 50, batch: int = 256, lr: float = 1e-3, schedule: str = "none", patience: int = 20, test_share: float = 0.2, dropout: float = 0.1, seed: int = 42, loss: str | list[Phase] = "phased", boundaries: tuple[int, ...] = PHASES, callback=None, progress: str | None = None, unknown_features: bool = False, min_units: int = 1, clip: float = 1.0, min_delta: float = 0.0, warmup: int = 0, checkpoint: str | None = None, checkpoint_every: int = 10, decay: float = 1e-4, accumulate: int = 1, shards: int | None = None, calibrate: bool = False, tables: dict[str, DataFrame] | None = None, cache: str | None = None):
        self.formula, self.targets, self.hidden, self.epochs, self.batch, self.lr = formula, targets, tuple(hidden), epochs, batch, lr
        self.schedule, self.patience, self.test_share, self.dropout, self.seed, self.loss, self.callback = schedule, patience, test_share, dropout, seed, loss, callback
        self.phases = list(PHASED) if loss == "phased" else [LOSSES[loss]] if isinstance(loss, str) else list(loss)
        self.boundaries, self.progress = tuple(boundaries)[: len(self.phases) - 1], progress
        if len(self.phases) != len(self.boundaries) + 1 or list(self.boundaries) != sorted(self.boundaries):
            raise ValueError("n phases need n - 1 ascending boundaries")
        self.unknown_features, self.min_units, self.clip, self.min_delta, self.warmup, self.checkpoint, self.checkpoint_every = unknown_features, min_units, clip, min_delta, warmup, checkpoint, checkpoint_every
        self.decay, self.accumulate, self.shards, self.calibrate = decay, accumulate, shards, calibrate
        self.temperatures: dict[str, float] = {}
        self.tables, self.cache = tables, cache
        self.encoder: EncoderModel | None = None
        self.net: Network | None = None
        self.scalers: dict[str, tuple[float, float]] = {}
        self.inputs: tuple[np.ndarray, np.ndarray] | None = None
        self.result = Result()
        self.known: DataFrame | None = None

    def _item_column(self) -> str | None:
        """The column of the observations whose unseen values make predictions less certain."""
        return next((s.columns[0] for s in self.encoder.specs if s.source == "obs" and s.kind in ("hash", "embed", "sparse", "vectors")), None)

    def _certain(self, table: DataFrame, obs: DataFrame | None) -> DataFrame:
        """Adds ``_sure``: 1 less the share of a unit's weight in unknown items; and the unknown features to the others, if wanted."""
        if self.known is None or obs is None:
            bare = table.withColumn("_sure", F.lit(1.0))
            return bare.withColumn("features", F.concat("features", F.array(F.lit(0.0), F.lit(0.0)))) if self.unknown_features and self.known is not None else bare
        weight = F.col("weight") if "weight" in obs.columns else F.lit(1.0)
        rows = obs.select("unit_id", F.col(self._item_column()).cast("string").alias("item"), weight.alias("weight"))
        share = vocab.unknown_share(rows, self.known).select("unit_id", F.col("confidence").alias("_sure"), F.col("unknown_count").cast("double").alias("_lost"))
        both = table.join(share, "unit_id", "left").fillna({"_sure": 1.0, "_lost": 0.0})
        if self.unknown_features:
            both = both.withColumn("features", F.concat("features", F.array(1 - F.col("_sure"), F.col("_lost"))))
        return both.drop("_lost")

    def _known(self, obs: DataFrame, column: str) -> DataFrame:
        rows = obs.select("unit_id", F.col(column).cast("string").alias(column))
        return vocab.in_units(rows, column, self.min_units) if self.min_units > 1 else vocab.alphabetical(rows, column)

    def summary(self) -> str:
        """What the model is, line by line."""
        lines = [f"formula   {self.formula}", f"targets   {', '.join(f'{t.name} ({t.task})' for t in self.targets)}", f"network   {' > '.join(map(str, self.hidden))}, dropout {self.dropout}, {self.n_params} parameters"]
        lines += [f"training  {self.schedule} rate {self.lr}, batch {self.batch}, {self.epochs} epochs, patience {self.patience}"]
        if self.encoder is not None:
            lines += [f"  {x.name:<8}{x.kind} of {', '.join(x.columns)} ({x.source})" for x in self.encoder.specs]
        if self.result.history:
            lines.append(f"best      epoch {self.result.best_epoch}, test loss {self.result.best_loss:.6g}")
        return "\n".join(lines)

    @classmethod
    def preset(cls, name: str, formula: str, targets: list[Target], **more) -> Trainer:
        return cls(formula, targets, **(preset_keywords(name) | more))

    def keywords(self) -> dict:
        """The keyword arguments that make an untrained trainer like this one."""
        plain = ("hidden", "epochs", "batch", "lr", "schedule", "patience", "test_share", "dropout", "seed", "boundaries", "callback", "progress", "unknown_features", "min_units", "clip", "min_delta", "warmup", "checkpoint", "checkpoint_every", "decay", "accumulate", "shards", "calibrate", "tables", "cache")
        return {k: getattr(self, k) for k in plain} | {"loss": self.phases}

    # --- features
    def _table(self, units: DataFrame, obs: DataFrame | None, encoder: EncoderModel) -> DataFrame:
        """``unit_id``, ``features`` and an array of ids per embedding, with the targets if the units have them."""
        keep = [c for c in (t.name for t in self.targets) if c in units.columns]
        out = encoder.features(units, obs).select("unit_id", "features", *keep) if encoder.continuous_dim else units.select("unit_id", F.array().cast("array<double>").alias("features"), *keep)
        for name, column, slots, _, _ in encoder.embeddings:
            got = encoder.ids(units, obs, name).where(F.col("column") == column).groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), "idx"))).alias("m"))
            ids = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
            out = out.join(got, "unit_id", "left").withColumn(f"ids_{name}_{column}", ids).drop("m")
        for name, column, _, _ in encoder.bags:
            bag = F.array_sort(F.collect_list(F.struct("idx", "value")))
            got = encoder.sparse(units, obs, name, column).groupBy("unit_id").agg(bag.alias("b"))
            at = F.coalesce(F.col("b.idx"), F.array().cast("array<long>"))
            of = F.coalesce(F.col("b.value"), F.array().cast("array<double>"))
            out = out.join(got, "unit_id", "left").withColumn(f"at_{name}_{column}", at).withColumn(f"of_{name}_{column}", of).drop("b")
        return out

    @staticmethod
    def _arrays(rows: pa.Table | pa.RecordBatch, encoder: EncoderModel) -> tuple[np.ndarray, list[np.ndarray | Bags]]:
        n = rows.num_rows

        def whole(name: str) -> pa.ListArray:
            column = rows.column(name)
            return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column

        def flat(name: str) -> np.ndarray:
            return whole(name).flatten().to_numpy(zero_copy_only=False)

        def bags(name: str) -> Bags:
            sizes = whole(f"at_{name}").value_lengths().to_numpy(zero_copy_only=False)
            return Bags(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), flat(f"at_{name}").astype(np.int64), flat(f"of_{name}").astype(float))

        x = flat("features").astype(float).reshape(n, -1) if n else np.zeros((0, encoder.continuous_dim))
        ids = [flat(f"ids_{name}_{column}").astype(np.int64).reshape(n, slots) for name, column, slots, _, _ in encoder.embeddings]
        return x, ids + [bags(f"{name}_{column}") for name, column, _, _ in encoder.bags]

    # --- fitting
    def fit(self, units: DataFrame, obs: DataFrame | None = None, resume: bool = False) -> Result:
        labelled = units
        for t in self.targets:
            ok = F.col(t.name).isNotNull() if t.task == "classification" else to_double(t.name).isNotNull()
            labelled = labelled.where(ok)
        if not resume or self.encoder is None:
            self.encoder = lowered(self.formula, units, obs, tables=self.tables).fit(units, obs)
            column = self._item_column()
            self.known = written(self._known(obs, column), "known") if column and obs is not None else None
        shards = self._shards(labelled, obs)
        regressions = {t.name: t.transform for t in self.targets if t.task == "regression"}
        if not resume or self.net is None:
            found = passes.moments(shards, regressions)
            wide = self.encoder.continuous_dim + 2 * self.unknown_features
            n, mean, m2 = found.get("", (0, np.zeros(wide), np.zeros(wide)))
            sd = np.sqrt(m2 / max(n - 1, 1))
            self.inputs = (mean, np.where(sd < 1e-8, 1.0, sd))
            for t in self.targets:
                n, mean, m2 = found.get(t.name, (0, np.zeros(1), np.zeros(1)))
                sd = float(np.sqrt(m2[0] / max(n - 1, 1)))
                self.scalers[t.name] = (float(mean[0]), sd if sd >= 1e-8 else 1.0) if n else (0.0, 1.0)
            heads = {t.name: t.num_classes if t.task == "classification" else 1 for t in self.targets}
            sizes = [(slots, size, dim) for _, _, slots, size, dim in self.encoder.embeddings]
            self.net = Network(len(self.inputs[0]), sizes, self.hidden, heads, self.dropout, self.seed, [(size, dim) for _, _, size, dim in self.encoder.bags])
            starts = self.encoder.starts()
            for k, (name, column, *_) in enumerate(self.encoder.bags):
                if f"{name}:{column}" in starts:
                    self.net.p[f"q{k}"] = starts[f"{name}:{column}"]
            self.optimizer, self.epoch, self.result = AdamW(self.net.p, self.decay, self.clip), 0, Result()
        self._passes(shards, units.sparkSession)
        self.temperatures = {}
        for t in self.targets if self.calibrate else ():
            if t.task == "classification":
                self.temperatures[t.name], *_ = temperature(written(passes.held_logits(shards, self.net, self.inputs, t.name), "logits"))
        return self.result

    def _shards(self, labelled: DataFrame, obs: DataFrame | None) -> DataFrame:
        """The labelled units' shards; kept ones if nothing that they are made from has changed."""

        def build() -> DataFrame:
            marked = split.train_test(labelled.select("unit_id"), self.test_share, self.seed)
            table = self._table(labelled, obs, self.encoder)
            if self.unknown_features:
                table = self._certain(table, obs).drop("_sure")
            return self._dealt(table.join(marked, "unit_id"), labelled.count())

        if self.cache is None or self.tables:
            return written(build(), "shards")
        spec = {"specs": [asdict(s) for s in self.encoder.specs], "scalers": self.encoder.scalers, "targets": [t.name for t in self.targets], **{k: getattr(self, k) for k in ("test_share", "seed", "shards", "unknown_features", "min_units")}}
        inputs = [labelled] + ([obs] if obs is not None else [])
        return Cache(labelled.sparkSession, self.cache).table("shards", inputs, spec, build)

    def _dealt(self, table: DataFrame, n: int) -> DataFrame:
        """The units' shards."""
        encoder, wide = _Shape(self.encoder), self.encoder.continuous_dim + 2 * self.unknown_features
        row_bytes = 8 * (wide + len(self.targets) + sum(e[2] for e in encoder.embeddings) + 64 * len(encoder.bags))
        many = self.shards or passes.shards_for(n, row_bytes)
        return passes.sharded(table, lambda rows: Trainer._arrays(rows, encoder), [t.name for t in self.targets], many, self.seed)

    def _passes(self, shards: DataFrame, spark: SparkSession) -> None:
        """Passes until the epochs are over or the held-out loss has stopped falling; the best weights stay.

        The held-out loss of an epoch comes with the next pass, so the last pass trains in vain when patience ends.
        """
        objective = Objective(self.targets, self.scalers, self.phases, self.boundaries)
        state = passes.State(self.net, self.optimizer)
        copy = lambda: {k: v.copy() for k, v in (self.net.p | self.net.stats).items()}
        best, waited, row = copy(), 0, None
        for epoch in range(self.epoch, self.epoch + self.epochs + 1):
            more = epoch < self.epoch + self.epochs
            if not more and row is None:
                break
            lr = self._rate(epoch)
            out = passes.run_pass(shards, state, objective, self.inputs, epoch, lr, self.batch, self.accumulate, self.seed, more, row is not None)
            if row is not None:
                held = {k: (value / over if over else 0.0, over) for k, (value, over) in (out.held or {}).items()}
                row["test_loss"] = objective.total(held) if any(over for _, over in held.values()) else row["train_loss"]
                waited += 1
                if row["test_loss"] < self.result.best_loss - self.min_delta:
                    self.result.best_epoch, self.result.best_loss, waited, best = row["epoch"], row["test_loss"], 0, copy()
                self._report(row, spark)
                if waited >= self.patience:
                    break
            if out.arrays is not None:
                state.load({k: v / out.units for k, v in out.arrays.items()}, self.optimizer.t + out.steps)
            row = {"epoch": epoch, "lr": lr, "train_loss": out.loss / max(out.units, 1), "test_loss": 0.0} if more else None
        if self.result.history:
            self.epoch = self.result.history[-1]["epoch"] + 1
        for of in (self.net.p, self.net.stats):
            of.update({k: best[k] for k in of})

    def _report(self, row: dict, spark: SparkSession) -> None:
        self.result.history.append(row)
        if self.callback:
            self.callback(row)
        if self.progress:
            Path(self.progress).write_text(json.dumps(row | {"epochs": self.epochs, "best_epoch": self.result.best_epoch, "best_loss": self.result.best_loss}))
        if self.checkpoint and (row["epoch"] + 1) % self.checkpoint_every == 0:
            first, self.epoch = self.epoch, row["epoch"] + 1
            self.save(self.checkpoint, spark)
            self.epoch = first

    def _rate(self, epoch: int) -> float:
        """The schedule's rate, rising in equal steps over the warm-up epochs."""
        return self._scheduled(epoch) * min(1.0, (epoch + 1) / self.warmup if self.warmup else 1.0)

    def _scheduled(self, epoch: int) -> float:
        if self.schedule == "step":
            return step_lr(epoch, self.lr, 100, 0.1)
        if self.schedule == "onecycle":
            return onecycle_lr(epoch, self.lr, self.epochs)
        return cosine_lr(epoch, self.lr, 1e-6, self.epochs) if self.schedule == "cosine" else self.lr

    # --- prediction
    @property
    def n_params(self) -> int:
        return self.net.size if self.net else 0

    def predict(self, units: DataFrame, obs: DataFrame | None = None, latent: bool = False, space: str = "raw", threshold: float = 0.0, samples: int = 0) -> DataFrame:
        """A row per unit: each target's prediction and confidence, null below the threshold.

        ``space='transformed'`` leaves targets as they were learned; ``latent`` adds the last hidden layer;
        ``samples`` adds ``low``, ``mid`` and ``high`` of that many passes with dropout (5 %, 50 % and 95 % by index).
        """
        if self.net is None:
            raise ValueError("fit or load first")
        inputs = {c for s in self.encoder.specs if s.source == "units" for c in s.columns}
        bare = units.drop(*[t.name for t in self.targets if t.name not in inputs])
        own = self._table(bare, obs, self.encoder)
        table = self._certain(own.select(*[c for c in own.columns if c not in {t.name for t in self.targets}]), obs)
        shared = units.sparkSession.sparkContext.broadcast(pickle.dumps((self.net, self.inputs, self.scalers)))
        targets, encoder, seed, temperatures = self.targets, _Shape(self.encoder), self.seed, dict(self.temperatures)

        def forward(batches):
            net, (mean, scale), scalers = pickle.loads(shared.value)
            for b in batches:
                x, ids = Trainer._arrays(b, encoder)
                x = (x - mean) / scale
                h = net.latent(x, ids)
                columns, names = [b.column("unit_id")], ["unit_id"]

                def values(t, h, net=net, scalers=scalers):
                    m, s = scalers[t.name]
                    y = net.head(t.name, h)[:, 0] * s + m
                    return restored(y, t.transform) if space == "raw" else y

                for t in targets:
                    if t.task == "classification":
                        z = net.head(t.name, h) / temperatures.get(t.name, 1.0)
                        z = z - z.max(1, keepdims=True)
                        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
                        sure = p.max(1)
                        columns += [pa.array(p.argmax(1).astype(float), mask=sure < threshold), pa.array(sure)]
                    else:
                        sure = np.array(b.column("_sure").to_pylist(), float)
                        columns += [pa.array(values(t, h), mask=sure < threshold), pa.array(sure)]
                    names += [t.name, f"{t.name}_confidence"]
                    if samples and t.task == "regression":
                        # masks depend on the unit, not on the batch it comes in
                        rng = UnitRandom(seed, b.column("unit_id").to_pylist())
                        runs = np.sort(np.stack([values(t, net.latent(x, ids, rng)) for _ in range(samples)]), axis=0)
                        for label, at in (("low", int(0.05 * samples)), ("mid", samples // 2), ("high", min(samples - 1, int(0.95 * samples)))):
                            columns.append(pa.array(runs[at]))
                            names.append(f"{t.name}_{label}")
                if latent:
                    columns.append(pa.array(list(h), pa.list_(pa.float64())))
                    names.append("latent")
                yield pa.RecordBatch.from_arrays(columns, names=names)

        parts = [f"unit_id {dict(table.dtypes)['unit_id']}"]
        for t in self.targets:
            parts += [f"`{t.name}` double, `{t.name}_confidence` double"]
            if samples and t.task == "regression":
                parts += [f"`{t.name}_{label}` double" for label in ("low", "mid", "high")]
        return table.mapInArrow(forward, ", ".join(parts + ["latent array<double>"] * latent))

    def evaluate(self, units: DataFrame, obs: DataFrame | None = None) -> DataFrame:
        """``(target, metric, value)`` of all targets, in their original scale."""
        truth = units.select("unit_id", *[F.col(t.name).cast("double").alias(f"_{t.name}") for t in self.targets])
        rows, out = self.predict(units, obs).join(truth, "unit_id"), None
        for t in self.targets:
            pair = rows.select(F.col(t.name).alias("pred"), F.col(f"_{t.name}").alias("target"))
            if t.task == "classification":
                got = metrics.classification(pair.select(F.col("pred").cast("long").alias("pred"), F.col("target").cast("long").alias("target")), t.num_classes)
            else:
                got = metrics.regression(pair)
            got = got.select(F.lit(t.name).alias("target"), "metric", "value")
            out = got if out is None else out.unionByName(got)
        return out

    def embeddings(self, name: str, column: str) -> DataFrame:
        """``(value, slot, vector)``: the learned vectors of each vocabulary value, one for each slot (one in all for the projection of a sparse input).

        The table is looked up where the vocabulary's rows are; only the weights are sent.
        """
        tables = [(n, c, self.net.p[f"q{k}"][None]) for k, (n, c, *_) in enumerate(self.encoder.bags)]
        tables += [(n, c, self.net.p[f"e{k}"]) for k, (n, c, *_) in enumerate(self.encoder.embeddings)]
        found = next((p for n, c, p in tables if (n, c) == (name, column)), None)
        if found is None:
            raise KeyError(f"no embedding {name} of {column}")
        rows = self.encoder.vocabularies[f"{name}:{column}"]
        shared = rows.sparkSession.sparkContext.broadcast(found)

        def look_up(batches):
            for b in batches:
                vectors = shared.value[:, b.column("idx").to_numpy()]
                for slot, of in enumerate(vectors):
                    flat = pa.array(np.ascontiguousarray(of).ravel())
                    at = pa.array(np.arange(len(of) + 1) * of.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column("value"), pa.array(np.full(len(of), slot)), pa.ListArray.from_arrays(at, flat)], names=["value", "slot", "vector"])

        return rows.select("value", "idx").mapInArrow(look_up, "value string, slot long, vector array<double>")

    # --- persistence
    def save(self, path: str, spark: SparkSession) -> None:
        self.encoder.save(path, spark)
        known = self.known.select(F.col("value").cast("string").alias("value"), "idx") if self.known is not None else spark.createDataFrame([], "value string, idx long")
        known.write.mode("overwrite").parquet(f"{path}/known")
        buffer = io.BytesIO()
        np.savez(buffer, in_mean=self.inputs[0], in_scale=self.inputs[1], **{f"p_{k}": v for k, v in self.net.p.items()}, **{f"s_{k}": v for k, v in self.net.stats.items()}, **{f"om_{k}": v for k, v in self.optimizer.m.items()}, **{f"ov_{k}": v for k, v in self.optimizer.v.items()})
        about = {"formula": self.formula, "targets": [asdict(t) for t in self.targets], "hidden": self.hidden, "epochs": self.epochs, "batch": self.batch, "lr": self.lr, "schedule": self.schedule, "patience": self.patience, "test_share": self.test_share, "dropout": self.dropout, "seed": self.seed, "loss": [asdict(p) for p in self.phases], "boundaries": self.boundaries, **{k: getattr(self, k) for k in ("unknown_features", "min_units", "clip", "min_delta", "warmup", "decay", "accumulate", "shards", "calibrate")}, "scalers": self.scalers, "temperatures": self.temperatures, "epoch": self.epoch, "t": self.optimizer.t, "result": asdict(self.result)}
        spark.createDataFrame([(json.dumps(about), bytearray(buffer.getvalue()))], "about string, weights binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Trainer:
        row = spark.read.parquet(f"{path}/model").first()
        a, w = json.loads(row["about"]), np.load(io.BytesIO(bytes(row["weights"])))
        targets = [Target(**(t | {"class_weights": tuple(t["class_weights"])})) for t in a["targets"]]
        keep = ("hidden", "epochs", "batch", "lr", "schedule", "patience", "test_share", "dropout", "seed", "boundaries")
        more = ("unknown_features", "min_units", "clip", "min_delta", "warmup", "decay", "accumulate", "shards", "calibrate")
        out = cls(a["formula"], targets, loss=[Phase(**p) for p in a["loss"]], **{k: a[k] for k in keep}, **{k: a[k] for k in more if k in a})
        out.encoder = EncoderModel.load(path, spark)
        out.known = spark.read.parquet(f"{path}/known") if out._item_column() else None
        out.inputs, out.scalers = (w["in_mean"], w["in_scale"]), {k: tuple(v) for k, v in a["scalers"].items()}
        heads = {t.name: t.num_classes if t.task == "classification" else 1 for t in targets}
        out.net = Network(len(out.inputs[0]), [(s, n, d) for _, _, s, n, d in out.encoder.embeddings], out.hidden, heads, out.dropout, out.seed, [(n, d) for _, _, n, d in out.encoder.bags])
        out.net.p = {k[2:]: w[k].copy() for k in w.files if k.startswith("p_")}
        out.net.stats = {k[2:]: w[k].copy() for k in w.files if k.startswith("s_")}
        out.optimizer, out.epoch, out.result = AdamW(out.net.p, out.decay, out.clip), a["epoch"], Result(**a["result"])
        out.optimizer.t = a["t"]
        out.temperatures = a.get("temperatures", {})
        out.optimizer.m, out.optimizer.v = ({k[3:]: w[k].copy() for k in w.files if k.startswith(x)} for x in ("om_", "ov_"))
        return out


class _Shape:
    """What executors need to know of an encoder."""

    def __init__(self, encoder: EncoderModel):
        self.continuous_dim, self.embeddings, self.bags = encoder.continuous_dim, encoder.embeddings, encoder.bags
