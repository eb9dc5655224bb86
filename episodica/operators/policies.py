"""Draws from policies and simple baselines."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, policy
from ..functions.vectors import let
from .align import repeat_prompts
from .sampling import categorical_draw


def _with_index(v: Column, draw) -> Column:
    return F.transform(v, lambda x, i: draw(x, i))


def sample_gaussian_actions(states: DataFrame, n: int, seed: int, row_id: str = "prompt_id", mean: str = "mean",
                            std: str = "std") -> DataFrame:
    """n draws mean + std * e per state, keyed by (state, gen_id)."""
    repeated = repeat_prompts(states, n)
    noise = _with_index(F.col(mean), lambda m, i: numbers.normal(seed, F.col(row_id), F.col("gen_id"), i))
    scaled = F.zip_with(F.col(std), noise, lambda s, e: s * e)
    return repeated.withColumn("sampled", F.zip_with(F.col(mean), scaled, lambda m, d: m + d))


def gaussian_draws(row_id: Column, mean: Column, std: Column, n: int, seed: int) -> Column:
    """The n draws of ``sample_gaussian_actions`` as an array of vectors, for work on whole groups in a row."""
    def draw(gen: Column) -> Column:
        noise = _with_index(mean, lambda m, i: numbers.normal(seed, row_id, gen, i))
        return F.zip_with(mean, F.zip_with(std, noise, lambda s, e: s * e), lambda m, d: m + d)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), draw)


def sample_categorical_actions(states: DataFrame, n: int, seed: int, row_id: str = "prompt_id",
                               logits: str = "logits") -> DataFrame:
    """n draws per state from softmax(logits)."""
    probabilities = states.withColumn("__p", policy.softmax(F.col(logits)))
    u = numbers.uniform(seed, F.col(row_id), F.col("gen_id"))
    return repeat_prompts(probabilities, n).withColumn("sampled", categorical_draw(F.col("__p"), u)).drop("__p")


def add_exploration_noise(action: Column, row_id: Column, seed: int, sigma: float = 0.1) -> Column:
    return _with_index(action, lambda a, i: a + sigma * numbers.normal(seed, row_id, i))


def constant_action(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def random_action(row_id: Column, bounds: Sequence[tuple[float, float]], seed: int) -> Column:
    """Uniform in the bounds of each dimension."""
    return F.array(*[F.lit(lo) + numbers.uniform(seed, row_id, F.lit(i)) * (hi - lo)
                     for i, (lo, hi) in enumerate(bounds)])


def random_discrete_action(row_id: Column, n: int, seed: int) -> Column:
    return F.floor(numbers.uniform(seed, row_id) * n).cast("int")


def gaussian_pdf_grid(models: DataFrame, keys: Sequence[str], mean: str = "mean", std: str = "std",
                      points: int = 100) -> DataFrame:
    """Density on equally spaced points of mean +- 3 std, for each row and dimension."""
    dims = models.select(*keys, F.posexplode(F.arrays_zip(F.col(mean).alias("m"), F.col(std).alias("s")))
                         .alias("dim", "d"))
    m, s = F.col("d.m"), F.col("d.s")
    grid = dims.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = m - 3.0 * s + F.col("point") * (6.0 * s / (points - 1))
    return grid.withColumn("x", x).select(
        *keys, "dim", "point", "x",
        (F.exp(-0.5 * F.pow((F.col("x") - m) / s, 2)) / (s * math.sqrt(2.0 * math.pi))).alias("pdf"))


def sample_cloud(center: Column, n: int, sigma: float, kind: str, row_id: Column, seed: int,
                 frame: Column | None = None) -> Column:
    """n points around a 2-d centre: gaussian, uniform (+-2 sigma) or a mixture of two gaussians.

    With ``frame`` the points are turned by 0.05 * frame about the origin.
    """
    if kind not in ("gaussian", "uniform", "mixture"):
        raise ValueError("kind must be 'gaussian', 'uniform' or 'mixture'")

    def offset(i: Column) -> Column:
        u = numbers.uniform_pair(seed, row_id, i)
        if kind == "uniform":
            return let(u, lambda p: F.array((2.0 * p["a"] - 1.0) * (2.0 * sigma), (2.0 * p["b"] - 1.0) * (2.0 * sigma)))
        shift = F.when(i < n // 2, 0.2).otherwise(-0.2) if kind == "mixture" else F.lit(0.0)
        return F.transform(let(u, numbers.normal_pair_from), lambda z: shift + z * sigma)

    offsets = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), offset)
    points = let(center, lambda c: F.transform(offsets, lambda o: F.array(c[0] + o[0], c[1] + o[1])))
    if frame is None:
        return points
    turn = F.array(F.cos(frame * 0.05), F.sin(frame * 0.05))
    return let(turn, lambda t: F.transform(points, lambda p: F.array(p[0] * t[0] - p[1] * t[1],
                                                                    p[0] * t[1] + p[1] * t[0])))


def sample_clouds(rows: DataFrame, center: str, n: int, sigma: float, kinds: Sequence[str], row_id: str, seed: int,
                  repeats: int = 1, frame: str | None = None) -> DataFrame:
    """Each row with ``repeats`` independent clouds of each kind: columns ``kind``, ``repeat`` (from 0) and ``points``.

    The draws of a repeat have a seed of their own, seed + 1000 * repeat.
    """
    clouds = [F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("repeat"), sample_cloud(
        F.col(center), n, sigma, kind, F.col(row_id), seed + 1000 * k, None if frame is None else F.col(frame)).alias("points"))
        for kind in kinds for k in range(repeats)]
    return rows.withColumn("__c", F.explode(F.array(*clouds))).select(*rows.columns, "__c.*")
