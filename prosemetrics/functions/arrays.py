"""Array functions on columns of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def moving_average(x: Column) -> Column:
    """Means over max(10, n div 10) neighbours, only where the window fits; a shorter array gives equal shares."""
    n = F.size(x)
    w = F.greatest(F.lit(10), F.floor(n / 10).cast("int"))
    short = F.array_repeat(total(x) / w, (w - n + 1).cast("int"))
    return F.when(n >= w, F.transform(F.sequence(F.lit(0), n - w), lambda i: total(F.slice(x, i + 1, w)) / w)).otherwise(short)


def resample(x: Column, points: int = 100) -> Column:
    """Linear interpolation at ``points`` even places from the first to the last value."""

    def at(s: Column, i: Column) -> Column:
        t = i * (F.size(s) - 1) / float(points - 1)
        f = F.floor(t).cast("int")
        return F.get(s, f) + (t - f) * (F.get(s, F.least(f + 1, F.size(s) - 1)) - F.get(s, f))

    return let(x, lambda s: F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: at(s, i)))


def centred(x: Column) -> Column:
    return let(x, lambda v: let(total(v) / F.size(v), lambda m: F.transform(v, lambda a: a - m)))


def standard(x: Column) -> Column:
    """Centred, over the population deviation plus 1e-8."""
    return let(centred(x), lambda v: let(F.sqrt(total(F.transform(v, lambda a: a * a)) / F.size(v)) + 1e-8, lambda s: F.transform(v, lambda a: a / s)))
