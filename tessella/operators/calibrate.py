"""Temperature scaling: one number by which a classifier's scores are divided, so that its confidences match how often it is right.

The mean cross-entropy is convex in the inverse temperature b. Newton's method needs its value, slope and curvature at
one b, which are means over rows; so each step is one aggregate, whatever the number of rows. Steps are kept between the
last values of b with a falling and a rising loss, and halve that interval where Newton's step would leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST, STEPS, CLOSE = 1e-3, 1e3, 40, 1e-10


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + f(x))


def calibration_sums(rows: DataFrame, b: float | Column) -> DataFrame:
    """One row ``(n, loss, slope, curvature)`` of ``rows (logits, target)`` at inverse temperature b; rows without a usable target are left out."""
    b = F.lit(float(b)) if isinstance(b, (int, float)) else b
    z = F.transform("logits", lambda x: x - F.array_max("logits"))  # the mean loss is the same, and no exponential overflows
    usable = rows.where((F.col("target") >= 0) & (F.col("target") < F.size("logits"))).select(z.alias("z"), F.get("logits", F.col("target").cast("int")).alias("own"), F.array_max("logits").alias("top"))
    parts = usable.select("z", (F.col("own") - F.col("top")).alias("y"), _sum(F.col("z"), lambda x: F.exp(b * x)).alias("s0"), _sum(F.col("z"), lambda x: x * F.exp(b * x)).alias("s1"), _sum(F.col("z"), lambda x: x * x * F.exp(b * x)).alias("s2"))
    mean = F.col("s1") / F.col("s0")
    return parts.agg(F.count("*").alias("n"), F.avg(F.log("s0") - b * F.col("y")).alias("loss"), F.avg(mean - F.col("y")).alias("slope"), F.avg(F.col("s2") / F.col("s0") - mean * mean).alias("curvature"))


def temperature(rows: DataFrame) -> tuple[float, float, float]:
    """The temperature that makes the mean cross-entropy of ``rows (logits, target)`` least, between 1/``MOST`` and 1/``LEAST``; the loss before and after.

    ``rows`` are read once for each step: write them first. Without rows, or if no temperature is better, it is 1.
    """
    low, high, b, first, best = LEAST, MOST, 1.0, None, (1.0, None)
    for _ in range(STEPS):
        n, loss, slope, curvature = calibration_sums(rows, b).first()
        if not n:
            return 1.0, 0.0, 0.0
        first = loss if first is None else first
        if best[1] is None or loss < best[1]:
            best = (b, loss)
        low, high = (b, high) if slope < 0 else (low, b)
        if abs(slope) < CLOSE or high / low < 1 + CLOSE:
            break
        step = b - slope / curvature if curvature > 1e-15 else 0.0
        b = step if low < step < high else (low * high) ** 0.5
    return 1 / best[0], first, best[1]
