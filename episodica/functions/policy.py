"""Distribution and loss mathematics on vector columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors

LOG_SQRT_2PI = 0.5 * math.log(2.0 * math.pi)


def gaussian_log_prob(action: Column, mean: Column, std: Column, reduce: str = "sum") -> Column:
    """Log density of a diagonal normal; ``reduce`` is ``sum`` or ``mean`` over dimensions."""
    if reduce not in ("sum", "mean"):
        raise ValueError("reduce must be 'sum' or 'mean'")
    z = F.zip_with(vectors.sub(action, mean), std, lambda d, s: d / s)
    per_dim = F.zip_with(z, std, lambda q, s: -0.5 * q * q - F.log(s) - LOG_SQRT_2PI)
    return vectors.total(per_dim) if reduce == "sum" else vectors.mean(per_dim)


def gaussian_kl(mean1: Column, std1: Column, mean2: Column, std2: Column) -> Column:
    """KL(N1 || N2) of diagonal normals, summed over dimensions."""
    spread = F.zip_with(std1, std2, lambda a, b: F.log(b / a) + (a * a) / (2.0 * b * b) - 0.5)
    shift = F.zip_with(vectors.sub(mean1, mean2), std2, lambda d, b: d * d / (2.0 * b * b))
    return vectors.total(spread) + vectors.total(shift)


def clipped_surrogate(advantage: Column, log_prob: Column, clip: float = 0.2) -> Column:
    """Only the clipped term, with exp(log_prob) as the ratio."""
    return -advantage * vectors.clamp(F.exp(log_prob), 1.0 - clip, 1.0 + clip)


def log_softmax_at(logits: Column, index: Column) -> Column:
    def normaliser(top: Column) -> Column:
        return top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))
    return F.get(logits, index) - vectors.let(F.array_max(logits), normaliser)


def softmax(logits: Column) -> Column:
    def shares(powers: Column) -> Column:
        return vectors.let(vectors.total(powers), lambda t: F.transform(powers, lambda p: p / t))
    powers = vectors.let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return vectors.let(powers, shares)


def guard_loss(loss: Column, limit: float = 10.0) -> Column:
    """True for a loss that is NaN, infinite or beyond the limit. NaN sorts above every number."""
    return F.isnan(loss) | (loss > limit) | (loss < -limit)


def checked_loss(loss: Column, limit: float = 10.0) -> Column:
    """The loss itself; one that ``guard_loss`` flags stops the job with its value."""
    message = F.concat(F.lit("loss out of bounds: "), loss.cast("string"))
    return F.when(guard_loss(loss, limit), F.raise_error(message).cast("double")).otherwise(loss)


def normalize(v: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / (std + 1e-8); statistics that were never set raise."""
    unset = F.forall(std, lambda s: s == 1.0) & F.forall(mean, lambda m: m == 0.0)
    centred = F.zip_with(vectors.sub(v, mean), std, lambda d, s: d / (s + 1e-8))
    return F.when(unset, F.raise_error(F.lit("normalization statistics have not been updated"))
                  .cast("array<double>")).otherwise(centred)


def denormalize_reward(reward: Column, mean: Column, std: Column) -> Column:
    unset = (std == 1.0) & (mean == 0.0)
    return F.when(unset, F.raise_error(F.lit("normalization statistics have not been updated"))
                  .cast("double")).otherwise(reward * std + mean)
