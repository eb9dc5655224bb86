"""Number text and reproducible randomness.

``rand(seed)`` depends on the partitioning, so random draws here are functions of a row key: the
same row gets the same draw on any cluster, and again after a lost executor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

TWO_32 = 4294967296.0


def fixed(x: Column, decimals: int = 5) -> Column:
    """``%.{decimals}f`` text. ``format_number`` rounds the exact binary value, as C printf does."""
    text = F.call_function("format_number", x, F.lit("0." + "0" * decimals))
    return (F.when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf"))
            .otherwise(text))


def fixed_list(v: Column, sep: str = ",", decimals: int = 5) -> Column:
    return F.array_join(F.transform(v, lambda x: fixed(x, decimals)), sep)


def order_key(seed: int, *ids: Column) -> Column:
    """32 hex digits that order rows at random; unique when the ids are."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def _hex_uniform(digits: Column, start: int) -> Column:
    word = F.conv(F.substring(digits, start, 8), 16, 10).cast("bigint")
    return (word + F.lit(0.5)) / F.lit(TWO_32)


def uniform(seed: int, *ids: Column) -> Column:
    """A draw in (0, 1) fixed by the seed and the row key."""
    return _hex_uniform(order_key(seed, *ids), 1)


def uniform_pair(seed: int, *ids: Column) -> Column:
    """STRUCT<a, b> of two independent draws from one digest."""
    return let(order_key(seed, *ids), lambda key: F.struct(
        _hex_uniform(key, 1).alias("a"), _hex_uniform(key, 9).alias("b")))


def _box_muller(a: Column, b: Column) -> Column:
    return F.sqrt(-2.0 * F.log(a)) * F.cos(2.0 * math.pi * b)


def normal_pair_from(u: Column) -> Column:
    """Both Box-Muller values of a ``uniform_pair`` as a 2-vector."""
    radius, angle = F.sqrt(-2.0 * F.log(u["a"])), 2.0 * math.pi * u["b"]
    return F.array(radius * F.cos(angle), radius * F.sin(angle))


def normal(seed: int, *ids: Column) -> Column:
    """A standard normal draw fixed by the seed and the row key."""
    return let(order_key(seed, *ids), lambda key: _box_muller(_hex_uniform(key, 1), _hex_uniform(key, 9)))
