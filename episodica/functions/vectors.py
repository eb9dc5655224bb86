"""Arithmetic on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a value several times, or inside a lambda, and compute it once per row.

    Catalyst shares no work between lambda calls: a row-level expression written inside a lambda
    would run for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def mean(v: Column) -> Column:
    return let(v, lambda x: total(x) / F.size(x))


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(v: Column, k: Column | float) -> Column:
    return F.transform(v, lambda x: x * k)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference; vectors of different sizes raise an error, a null vector gives null."""
    uneven = F.raise_error(F.lit("vectors differ in length")).cast("double")
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.when(
        p["a"].isNotNull() & p["b"].isNotNull(), F.when(F.size(p["a"]) != F.size(p["b"]), uneven).otherwise(
            squared_distance(p["a"], p["b"]) / F.size(p["b"]))))


def argmax(v: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    lo = F.lit(lo) if not isinstance(lo, Column) else lo
    hi = F.lit(hi) if not isinstance(hi, Column) else hi
    return F.least(F.greatest(x, lo), hi)
