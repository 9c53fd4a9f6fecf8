"""Array functions of the network's layers, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lambdas import bind


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(x: Column, weight: Column | None = None) -> Column:
    """x / max(|x|, 1e-12) * sqrt(size), times weight."""
    scale = F.sqrt(F.size(x).cast("double")) / F.greatest(F.sqrt(dot(x, x)), F.lit(1e-12))
    out = bind(scale, lambda s: F.transform(x, lambda v: v * s))
    return out if weight is None else F.zip_with(out, weight, lambda a, b: a * b)


#: erf after Abramowitz and Stegun, 7.1.26; its error is at most 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2.0)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def glu(x: Column) -> Column:
    """The first half times the sigmoid of the second."""
    half = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda v, g: v * sigmoid(g))


def softmax(x: Column) -> Column:
    def shares(e: Column) -> Column:
        return bind(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda v: v / total))

    return bind(F.array_max(x), lambda top: bind(F.transform(x, lambda v: F.exp(v - top)), shares))


def rope(x: Column, place: Column, base: float = 10000.0) -> Column:
    """Turns each pair (2i, 2i+1) by place / base ** (2i / size)."""
    n = F.size(x).cast("double")

    def turned(v: Column, i: Column) -> Column:
        pair = F.floor(i / 2)
        angle = place / F.pow(F.lit(base), 2.0 * pair / n)
        other = F.get(x, F.when(i % 2 == 0, i + 1).otherwise(i - 1))
        return v * F.cos(angle) + F.when(i % 2 == 0, -other).otherwise(other) * F.sin(angle)

    return F.transform(x, turned)


def linear(x: Column, rows: Column, bias: Column | None = None) -> Column:
    """rows: an array of weight rows, one an output; a literal is best. x is computed once, not for each output."""
    out = bind(x, lambda v: F.transform(rows, lambda w: dot(v, w)))
    return out if bias is None else F.zip_with(out, bias, lambda a, b: a + b)
