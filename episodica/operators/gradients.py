"""Direction of the squared-error gradient against the reward-weighted one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, vectors
from ..functions.vectors import let


def cloud_rewards(samples: Column, target: Column) -> Column:
    """Negative squared distance of each sample to the target."""
    return let(target, lambda t: F.transform(samples, lambda p: -vectors.squared_distance(p, t)))


def weighted_direction(samples: Column, rewards: Column, prediction: Column, reward_scale: Column | float,
                       weight_eps: float = 0.0) -> Column:
    """Mean direction from the prediction to the samples, weighted by softmax(reward * scale)."""
    def direction(top: Column) -> Column:
        powers = F.transform(rewards, lambda r: F.exp(r * reward_scale - top))
        start = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
        # Weight total and weighted sum of the samples in one pass.
        sums = F.aggregate(F.arrays_zip(powers.alias("w"), samples.alias("p")), start, lambda acc, s: F.array(
            acc[0] + s["w"], acc[1] + s["w"] * s["p"][0], acc[2] + s["w"] * s["p"][1]))
        extra = weight_eps * F.exp(-top) if weight_eps else F.lit(0.0)
        return let(sums, lambda t: F.transform(F.array(F.lit(0), F.lit(1)), lambda i: (
            F.get(t, i + 1) - t[0] * F.get(prediction, i)) / (t[0] + extra)))

    return let(F.array_max(rewards) * reward_scale, direction)


def gradient_compare(df: DataFrame, prediction: str, target: str, samples: str, reward_scale: Column | float = 2.0,
                     gradient_scale: float = 1.0, weight_eps: float = 0.0, angle_eps: float = 1e-8) -> DataFrame:
    """Both gradients, their magnitudes, the angle between them in degrees and the ratio.

    With ``angle_eps`` 0 the angle of a zero gradient is 0. Each row carries its own samples, so no
    row meets another.
    """
    p, t = F.col(prediction), F.col(target)
    weighted = let(F.col(samples), lambda s: let(cloud_rewards(s, t), lambda r: let(
        p, lambda q: weighted_direction(s, r, q, reward_scale, weight_eps))))
    scaled = F.struct(vectors.scale(vectors.sub(t, p), gradient_scale).alias("m"),
                      vectors.scale(weighted, gradient_scale).alias("g"))
    measured = let(scaled, lambda v: F.struct(
        v["m"].alias("mse_grad"), v["g"].alias("grpo_grad"), vectors.norm(v["m"]).alias("mse_magnitude"),
        vectors.norm(v["g"]).alias("grpo_magnitude"), vectors.dot(v["m"], v["g"]).alias("inner")))
    out = df.withColumn("__v", measured)
    m, g, inner = F.col("__v.mse_magnitude"), F.col("__v.grpo_magnitude"), F.col("__v.inner")

    def angle(cosine: Column) -> Column:
        return F.degrees(F.acos(vectors.clamp(cosine, -1.0, 1.0)))

    if angle_eps:
        degrees = angle(inner / (m * g + angle_eps))
    else:
        degrees = F.when((m > 0) & (g > 0), angle(inner / (m * g))).otherwise(0.0)
    shown = [F.col(f"__v.{c}").alias(c) for c in ("mse_grad", "grpo_grad", "mse_magnitude", "grpo_magnitude")]
    return out.select(*df.columns, *shown, degrees.alias("angle_diff"),
                      F.when(m > 0, g / m).otherwise(0.0).alias("magnitude_ratio"))


def gradient_series_stats(compared: DataFrame) -> DataFrame:
    """Averages over the steps of a comparison; the std is the population one."""
    return compared.agg(
        F.avg("mse_magnitude").alias("avg_mse_magnitude"), F.avg("grpo_magnitude").alias("avg_grpo_magnitude"),
        F.avg("angle_diff").alias("avg_angle_diff"), F.stddev_pop("angle_diff").alias("std_angle_diff"),
        F.max("angle_diff").alias("max_angle_diff"), F.avg("magnitude_ratio").alias("avg_ratio"))


# The parameter grid of the sweep.
SWEEP_SAMPLES = [5, 10, 15, 20]
SWEEP_SIGMAS = [0.2, 0.4, 0.6, 0.8]
SWEEP_REWARD_SCALES = [1.0, 2.0, 3.0, 4.0]


def sweep_cells(steps: DataFrame, row_id: str, prediction: str, target: str, seed: int,
                n_samples: Sequence[int] = tuple(SWEEP_SAMPLES), sigmas: Sequence[float] = tuple(SWEEP_SIGMAS),
                reward_scales: Sequence[float] = tuple(SWEEP_REWARD_SCALES)) -> DataFrame:
    """Average angle and magnitude ratio for each parameter cell, each row being one step.

    The noise of a row is drawn once for the largest cell; each cell scales a prefix z of it. The samples are
    prediction + sigma * z, so their weighted direction is sigma * sum(w z) / sum(w). NumPy runs all cells over each Arrow
    batch and emits one row of sums per cell, so rows are not multiplied and only partial sums are shuffled. Standard
    deviations are merged from per-batch means and squared distances.
    """
    pair = F.transform(F.sequence(F.lit(0), F.lit(max(n_samples) - 1)),
                       lambda i: let(numbers.uniform_pair(seed, F.col(row_id), i), numbers.normal_pair_from))
    rows = steps.select(pair.alias("z"), vectors.sub(F.col(target), F.col(prediction)).alias("gap"))
    grid = [(int(n), float(s), float(k)) for n in n_samples for s in sigmas for k in reward_scales]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            noise = batch.column(0).flatten().flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1, 2)
            gap = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, :2]
            columns = list(zip(*[(*cell, *_cell_sums(noise[:, :cell[0]], gap, *cell[1:])) for cell in grid]))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *map(pa.array, columns[1:])], names=_CELL_COLUMNS)

    sums = rows.mapInArrow(run, "n_samples int, sigma double, reward_scale double, n bigint, angle double, spread double, "
                                "ratio double")
    sums = sums.withColumn("n", F.col("n").cast("double")).groupBy("n_samples", "sigma", "reward_scale").agg(
        F.sum("n").alias("n"), F.sum("angle").alias("angle"), F.sum("ratio").alias("ratio"), F.sum("spread").alias("spread"),
        F.sum(F.when(F.col("n") > 0, F.col("angle") * F.col("angle") / F.col("n"))).alias("squares"))
    mean = F.col("angle") / F.col("n")
    variance = (F.col("spread") + F.col("squares")) / F.col("n") - mean * mean
    return sums.where("n > 0").select(
        "n_samples", "sigma", "reward_scale", mean.alias("avg_angle_diff"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std_angle_diff"), (F.col("ratio") / F.col("n")).alias("avg_magnitude_ratio"))


_CELL_COLUMNS = ["n_samples", "sigma", "reward_scale", "n", "angle", "spread", "ratio"]


def _cell_sums(noise: np.ndarray, gap: np.ndarray, sigma: float, scale: float) -> tuple[int, float, float, float]:
    """Steps that move, the sum of their angles, of its squared distances from the mean, and of their magnitude ratios."""
    apart = sigma * noise - gap[:, None, :]
    score = -scale * (apart * apart).sum(axis=2)
    top = score.max(axis=1)
    weight = np.exp(score - top[:, None])
    total = weight.sum(axis=1) + 1e-8 * np.exp(-top)
    mean = sigma * (weight[:, :, None] * noise).sum(axis=1) / total[:, None]
    m, g = np.hypot(gap[:, 0], gap[:, 1]), np.hypot(mean[:, 0], mean[:, 1])
    moving = (m > 0) & (g > 0)
    m, g, mean, gap = m[moving], g[moving], mean[moving], gap[moving]
    if not len(m):
        return 0, 0.0, 0.0, 0.0
    angle = np.degrees(np.arccos(np.clip((gap * mean).sum(axis=1) / (m * g), -1.0, 1.0)))
    return len(m), float(angle.sum()), float(((angle - angle.mean()) ** 2).sum()), float((g / m).sum())


def reinforce_gradients(df: DataFrame, x: Column, f: Column, y: Column, row_id: Column, n: int, sigma: float,
                        seed: int, kind: str = "normal") -> DataFrame:
    """Per-sample score-function gradients beside the squared-error gradient, for scalar predictions."""
    if kind not in ("normal", "uniform"):
        raise ValueError("kind must be 'normal' or 'uniform'")
    rows = df.withColumns({"x": x, "f": f, "y": y}).withColumn(
        "sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if kind == "normal":
        offset = numbers.normal(seed, row_id, F.col("sample")) * sigma
    else:
        offset = (2.0 * numbers.uniform(seed, row_id, F.col("sample")) - 1.0) * (2.0 * sigma)
    drawn = rows.withColumn("y_hat", F.col("f") + offset)
    reward = -0.5 * (F.col("y_hat") - F.col("y")) * (F.col("y_hat") - F.col("y"))
    return drawn.withColumns({
        "sample_reward": reward,
        "grpo_grad": -reward * (F.col("y_hat") - F.col("f")) / (sigma * sigma) * F.col("x"),
        "mse_grad": (F.col("f") - F.col("y")) * F.col("x")})


def capped_direction(prediction: Column, sampled: Column, target: Column, longest: float = 3.0) -> Column:
    """(sampled - prediction) * |sampled - target|^2, shortened to ``longest``."""
    raw = vectors.scale(vectors.sub(sampled, prediction), vectors.squared_distance(sampled, target))
    length = vectors.norm(raw)
    return F.when(length > longest, vectors.scale(raw, longest / length)).otherwise(raw)
