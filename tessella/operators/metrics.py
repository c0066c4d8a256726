"""Metrics of predictions as distributed aggregates; each returns a DataFrame.

Regression takes columns ``pred`` and ``target``, classification ``pred`` and ``target`` codes. Values keep
full precision; callers round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..sources.shared import written
from .order import running

EPS = 1e-8


def finite_pairs(df: DataFrame) -> DataFrame:
    return df.where(finite("pred") & finite("target"))


def _error() -> Column:
    return F.abs(F.col("pred") - F.col("target"))


def mae() -> Column:
    return F.avg(_error())


def rmse() -> Column:
    return F.sqrt(F.avg(_error() * _error()))


def smape(kind: str = "sum") -> Column:
    """``sum``: the denominator is |p| + |t| + eps, values from 0 to 1; ``half``: half of |p| + |t|, plus eps, from 0 to 2."""
    size = F.abs("pred") + F.abs("target")
    return F.avg(_error() / (size + EPS if kind == "sum" else size / 2 + EPS))


def r2() -> Column:
    """1 - residual / total sum of squares; 1 for a constant target. One pass: n times the population variance is the total."""
    total = F.var_pop("target") * F.count("target")
    return F.when(total < 1e-10, 1.0).otherwise(1 - F.sum(_error() * _error()) / total)


def band(share: float, kind: str = "ratio") -> Column:
    """How many predictions lie within a share of the target: by p / (t + eps), or by |p - t| / max(|t|, eps), 0 if there are none."""
    if kind == "ratio":
        ratio = F.col("pred") / (F.col("target") + EPS)
        return F.avg(F.when((ratio >= 1 - share) & (ratio <= 1 + share), 1.0).otherwise(0.0))
    near = _error() / F.greatest(F.abs("target"), F.lit(EPS)) <= share
    return F.coalesce(F.avg(F.when(near, 1.0).otherwise(0.0)), F.lit(0.0))


def regression(df: DataFrame, bands: tuple[float, ...] = (0.25, 0.5, 0.75), smape_kind: str = "sum") -> DataFrame:
    """``(metric, value)``: all regression metrics in one aggregate, then turned into rows."""
    named = {"mae": mae(), "rmse": rmse(), "r2": r2(), "smape": smape(smape_kind)} | {f"band_{round(100 * b)}": band(b) for b in bands}
    one = finite_pairs(df).agg(*[x.alias(name) for name, x in named.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in named])).alias("m")).select("m.*")


def accuracy() -> Column:
    return F.avg(F.when(F.col("pred") == F.col("target"), 1.0).otherwise(0.0))


def confusion(df: DataFrame, classes: int) -> DataFrame:
    """``(target, pred, n)`` of the codes in range."""
    inside = F.col("target").between(0, classes - 1) & F.col("pred").between(0, classes - 1)
    return df.where(inside).groupBy("target", "pred").agg(F.count("*").alias("n"))


def per_class(df: DataFrame, classes: int) -> DataFrame:
    """``(class, precision, recall, f1, support)`` for every class; undefined ones are 0. Works on the confusion counts."""
    cells = confusion(df, classes)
    sides = cells.select(F.explode(F.array(F.struct(F.col("target").alias("class"), F.lit(True).alias("t"), F.lit(False).alias("p")), F.struct(F.col("pred").alias("class"), F.lit(False).alias("t"), F.lit(True).alias("p")))).alias("s"), "n", (F.col("target") == F.col("pred")).alias("hit"))
    counts = sides.groupBy(F.col("s.class").alias("class")).agg(
        F.sum(F.when(F.col("s.t") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.t"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.p"), F.col("n")).otherwise(0)).alias("picked"),
    )
    spine = df.sparkSession.range(classes).select(F.col("id").alias("class"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = spine.join(counts.withColumn("class", F.col("class").cast("long")), "class", "left").fillna(0, ["tp", "support", "picked"])
    out = out.select("class", ratio("tp", "picked").alias("precision"), ratio("tp", "support").alias("recall"), "support")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.select("class", "precision", "recall", f1.alias("f1"), F.col("support").cast("long").alias("support"))


def f1_scores(df: DataFrame, classes: int) -> DataFrame:
    """One row: macro_f1, of the mean precision and mean recall over classes with support, and weighted_f1."""
    have = per_class(df, classes).where("support > 0")
    one = have.agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.sum(F.col("f1") * F.col("support")).alias("f"), F.sum("support").alias("n"))
    macro = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return one.select(macro.alias("macro_f1"), F.coalesce(F.try_divide(F.col("f"), F.col("n").cast("double")), F.lit(0.0)).alias("weighted_f1"))


def classification(df: DataFrame, classes: int) -> DataFrame:
    """``(metric, value)``: accuracy, macro_f1, weighted_f1 and precision, recall and f1 of each class."""
    cells = lambda name: F.struct(F.concat(F.lit(f"{name}_"), F.col("class").cast("string")).alias("metric"), F.col(name).alias("value"))
    each = per_class(df, classes).select(F.explode(F.array(cells("precision"), cells("recall"), cells("f1"))).alias("m")).select("m.*")
    f1 = f1_scores(df, classes)
    one = lambda name: f1.select(F.lit(name).alias("metric"), F.col(name).alias("value"))
    return df.agg(accuracy().alias("value")).select(F.lit("accuracy").alias("metric"), "value").unionByName(one("macro_f1")).unionByName(one("weighted_f1")).unionByName(each)


def coverage(df: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.5, 0.8, 0.9, 0.95)) -> DataFrame:
    """``(threshold, accuracy, coverage, n_samples, n_total)`` of predictions at least that confident; all thresholds in one pass."""
    columns = []
    for k, t in enumerate(thresholds):
        sure = F.col("confidence") >= t
        columns += [F.count_if(sure).alias(f"n{k}"), F.count_if(sure & (F.col("pred") == F.col("target"))).alias(f"h{k}")]
    one = df.agg(F.count("*").alias("n_total"), *columns)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{k}").alias("n_samples"), F.col(f"h{k}").alias("hits")) for k, t in enumerate(thresholds)])
    cells = one.select("n_total", F.explode(rows).alias("r")).select("n_total", "r.*")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return cells.select("threshold", share("hits", "n_samples").alias("accuracy"), share("n_samples", "n_total").alias("coverage"), "n_samples", "n_total")


def _steps(df: DataFrame) -> DataFrame:
    """Per distinct score, from the highest: positives and negatives there, and sums down to it."""
    at = df.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    return running(at, F.desc("score"), {"tp": "p", "fp": "q"})


def roc_auc(df: DataFrame) -> DataFrame:
    """One row ``roc_auc`` of ``(score, label)``; ties count half."""
    steps = _steps(df)
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2))
    return steps.agg(F.try_divide(area, F.sum("p").cast("double") * F.sum("q")).alias("roc_auc"))


def pr_auc(df: DataFrame) -> DataFrame:
    """One row ``pr_auc``: average precision, the sum of precision times the step in recall."""
    steps = _steps(df)
    return steps.agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("p").cast("double")).alias("pr_auc"))


#: Samples of a key from which its quantiles are searched for rather than sorted out, and the accuracy of the sketch that the search starts from.
LARGE, ACCURACY = 200_000, 10_000


def intervals(samples: DataFrame, key: str, value: str, low: float = 0.05, high: float = 0.95, large: int = LARGE) -> DataFrame:
    """``(key, low, mid, high)``: quantiles by index of each key's sorted samples (nulls first); the values are exact.

    Keys with few samples are ranked in a window. Samples of a key with more than ``large`` are never brought together: a sketch
    with map-side parts gives bounds around each index, the samples below them are counted, and only those within are put in order,
    equal ones as one row. Where a sketch was wrong (its error is bounded, but for this nothing is left to chance) the key is ranked after all.
    """
    rows = samples.select(F.col(key), F.col(value).alias("v"))
    many = written(rows.groupBy(key).agg(F.count("*").alias("n"), F.count("v").alias("held")).where(F.col("n") > large), "large")
    if not many.head(1):
        return _ranked(rows, key, low, high)
    same = F.col(key).eqNullSafe(F.col("_key"))
    names = many.select(F.col(key).alias("_key"))
    found = written(_searched(rows.join(names, same, "left_semi"), many, key, low, high), "quantiles")
    sure_ = found.where("sure")
    rest = rows.join(sure_.select(F.col(key).alias("_key")), same, "left_anti")
    return _ranked(rest, key, low, high).unionByName(sure_.drop("sure"))


def _ranked(rows: DataFrame, key: str, low: float, high: float) -> DataFrame:
    w = Window.partitionBy(key)
    rows = rows.select(key, "v", F.row_number().over(w.orderBy("v")).alias("r"), F.count("*").over(w).alias("n"))
    at = lambda i: F.max(F.when(F.col("r") == F.least(i + 1, F.col("n")), F.col("v")))
    return rows.groupBy(key).agg(at(F.floor(low * F.col("n"))).alias("low"), at(F.floor(F.col("n") / 2)).alias("mid"), at(F.floor(high * F.col("n"))).alias("high"))


def _searched(rows: DataFrame, many: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """``(key, low, mid, high, sure)`` of large keys; ``many``: their numbers of samples, and of those that are not null."""
    shares = {"low": low, "mid": 0.5, "high": high}
    near = [p for share in shares.values() for p in (max(0.0, share - 4 / ACCURACY), min(1.0, share + 4 / ACCURACY))]
    sketch = rows.groupBy(key).agg(F.percentile_approx("v", near, ACCURACY).alias("near"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    # a row for each large key: their number is at most that of all samples over ``large``
    plan = many.join(sketch.withColumnRenamed(key, "_key"), same, "left").select(F.col(key).alias("_key"), "n", "held", "near")
    plan = written(plan, "bounds")
    index = [F.least(F.floor((F.col("n") / 2) if name == "mid" else share * F.col("n")), F.col("n") - 1) - (F.col("n") - F.col("held")) for name, share in shares.items()]
    bounds = plan.select("_key", F.posexplode(F.array(*index)).alias("q", "index"), "near").select("_key", "q", "index", F.get("near", 2 * F.col("q")).alias("least"), F.get("near", 2 * F.col("q") + 1).alias("most"))
    held = rows.where("v is not null").join(bounds, same)
    below = held.groupBy("_key", "q", "index").agg(F.count_if(F.col("v") < F.col("least")).alias("below"))
    inside = held.where("v >= least and v <= most").groupBy("_key", "q", "v").agg(F.count("*").alias("m"))
    up = Window.partitionBy("_key", "q").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("m").over(up)).withColumnRenamed("_key", "_k").withColumnRenamed("q", "_q")
    both = below.join(inside, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("q") == F.col("_q")), "left")
    rank = F.col("index") - F.col("below")
    hit = (rank >= F.col("upto") - F.col("m")) & (rank < F.col("upto"))
    one = both.groupBy("_key", "q").agg(F.max(F.when(hit, F.col("v"))).alias("v"), F.max(F.coalesce(hit, F.lit(False))).alias("hit"), F.first("index").alias("index"))
    out = plan.select("_key").join(one.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k")), "left")
    value = lambda k: F.max(F.when(F.col("q") == k, F.col("v"))).alias(list(shares)[k])
    # an index below 0 is among the nulls, and so is everything where all are null
    good = F.coalesce(F.min(F.col("hit") | (F.col("index") < 0)), F.lit(True))
    return out.groupBy("_key").agg(*[value(k) for k in range(3)], good.alias("sure")).withColumnRenamed("_key", key)


def sure(prediction: Column, confidence: Column, threshold: float) -> Column:
    """The prediction, or null where the confidence is below the threshold."""
    return F.when(confidence >= threshold, prediction)
