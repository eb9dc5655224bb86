"""Numbers to 0..999 tokens and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import MAX_TOKEN
from .vectors import clamp

# Observation ranges used when a half-cheetah policy is evaluated.
HALFCHEETAH_OBS_RANGES = [
    (-0.60093, 1.65039),
    (-3.37066, 33.0926),
    (-0.71955, 1.16646),
    (-1.07522, 0.97051),
    (-0.66226, 0.92309),
    (-1.21191, 0.94732),
    (-1.32284, 1.13311),
    (-0.65082, 0.85277),
    (-2.98412, 18.19746),
    (-5.99159, 7.16734),
    (-12.61812, 16.07245),
    (-29.60571, 26.28331),
    (-34.81563, 31.061),
    (-31.80877, 25.972),
    (-30.01456, 32.53572),
    (-28.39937, 37.98769),
    (-19.99082, 36.14906),
]


def ranges_literal(pairs: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(lo)).alias("min"), F.lit(float(hi)).alias("max")) for lo, hi in pairs])


def quantize_obs(obs: Column, ranges: Column) -> Column:
    """Clamp to the range, scale to 0..999, truncate. A constant dimension gives token 0."""
    def token(x: Column, r: Column) -> Column:
        width = r["max"] - r["min"]
        scaled = (clamp(x, r["min"], r["max"]) - r["min"]) / width * float(MAX_TOKEN)
        return F.when(width == 0, F.lit(0)).otherwise(scaled.cast("int"))
    return F.zip_with(obs, ranges, token)


def dequantize_action(tokens: Column, ranges: Column) -> Column:
    """Tokens to values by range; NULL when a token lies outside 0..999."""
    bad = F.exists(tokens, lambda t: (t < 0) | (t > MAX_TOKEN))
    return F.when(~bad, F.zip_with(
        tokens, ranges, lambda t, r: r["min"] + (t / float(MAX_TOKEN)) * (r["max"] - r["min"])))
