"""Command line: ``python -m tessella.cli train|predict|info``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .model.train import Trainer
from .sources.io import from_two_tables, read_table, write_predictions
from .sources.roles import Roles, Target


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("train", "predict"):
        c = sub.add_parser(name)
        c.add_argument("--units", required=True)
        c.add_argument("--obs", required=True)
        for role in ("unit", "item"):
            c.add_argument(f"--{role}", required=True)
        for role in ("obs-unit", "weight", "genus", "family", "latitude", "longitude"):
            c.add_argument(f"--{role}")
        c.add_argument("--covariate", action="append", default=[])
        c.add_argument("--model", required=True)
    t, q = sub.choices["train"], sub.choices["predict"]
    t.add_argument("--formula", required=True)
    t.add_argument("--target", action="append", required=True, help="COL:TYPE, split at the first colon; repeatable")
    t.add_argument("--epochs", type=int, default=50)
    t.add_argument("--hidden", type=int, nargs="+", default=[64, 32])
    t.add_argument("--seed", type=int, default=42)
    t.add_argument("--accumulate", type=int, default=1, help="batches for each step")
    t.add_argument("--calibrate", action="store_true", help="fit a temperature for the confidences of classes")
    q.add_argument("--out", required=True)
    q.add_argument("--threshold", type=float, default=0.0)
    sub.add_parser("info").add_argument("--model", required=True)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
    if a.command == "info":
        t = Trainer.load(a.model, spark)
        print(f"formula: {t.formula}\ntargets: {', '.join(f'{x.name} ({x.task}, {x.transform})' for x in t.targets)}\nhidden: {list(t.hidden)}\nparameters: {t.n_params}\nepochs: {t.epoch}, best {t.result.best_epoch} with loss {t.result.best_loss:.6g}")
        return 0
    roles = Roles(a.unit, a.item, a.obs_unit, a.weight, a.genus, a.family, a.latitude, a.longitude, tuple(a.covariate))
    units, obs = read_table(spark, a.units), read_table(spark, a.obs)
    if a.command == "train":
        targets = [Target.parse(x) for x in a.target]
        t = Trainer(a.formula, targets, hidden=tuple(a.hidden), epochs=a.epochs, seed=a.seed, accumulate=a.accumulate, calibrate=a.calibrate)
        u, o = from_two_tables(units, obs, roles, keep=tuple(x.name for x in targets if x.name not in a.covariate))
        result = t.fit(u, o)
        t.save(a.model, spark)
        print(f"best epoch {result.best_epoch}, loss {result.best_loss:.6g}")
    else:
        u, o = from_two_tables(units, obs, roles)
        write_predictions(Trainer.load(a.model, spark).predict(u, o, threshold=a.threshold), a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
