"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_double(x: Column | str, default: float | None = None) -> Column:
    """A number, or the default where there is none."""
    out = _col(x).try_cast("double")
    return out if default is None else F.coalesce(out, F.lit(default))


def finite(x: Column | str) -> Column:
    x = _col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def expm1_clamped(x: Column | str, bound: float = 88.0) -> Column:
    return F.expm1(F.greatest(F.least(_col(x), F.lit(bound)), F.lit(-bound)))


def transformed(x: Column | str, transform: str) -> Column:
    x = _col(x)
    return {"none": x, "log1p": F.log1p(x), "sqrt": F.sqrt(x)}[transform]


def restored(x: Column | str, transform: str) -> Column:
    x = _col(x)
    return {"none": x, "log1p": expm1_clamped(x), "sqrt": x * x}[transform]


def argmax_first(scores: Column | str) -> Column:
    """Index from 0 of the first maximum of an array."""
    scores = _col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("long")


def softmax_max(scores: Column | str) -> Column:
    """The largest softmax probability of an array of scores."""
    scores = _col(scores)
    top = F.array_max(scores)
    return 1 / F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))


def cosine(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def linear(x: Column | str, w: Column, bias: float = 0.0) -> Column:
    """A linear head: the product of an array with weights, and a bias."""
    return F.aggregate(F.zip_with(_col(x), w, lambda p, q: p.cast("double") * q), F.lit(bias), lambda a, v: a + v)


def unit_vector(x: Column | str) -> Column:
    """The array as doubles, over its length; null if that is 0."""
    x = _col(x).cast("array<double>")
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(x, lambda v: F.try_divide(v, length))
