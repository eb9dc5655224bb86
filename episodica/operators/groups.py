"""Group-relative rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import with_group_stats


def group_advantage(scored: DataFrame, reward: str = "reward", keys: tuple[str, ...] = ("prompt_id",),
                    scaled: bool = True, eps: float = 1e-4) -> DataFrame:
    """(reward - group mean) / (unbiased group std + eps); only the difference when not ``scaled``.

    Adds ``group_mean``, ``group_std`` and ``advantage``. A group of one has a NULL std and, scaled,
    a NULL advantage.
    """
    r = F.col(reward)
    rows = with_group_stats(scored, list(keys), {"group_mean": F.avg(r), "group_std": F.stddev_samp(r)})
    centred = F.col(reward) - F.col("group_mean")
    return rows.withColumn("advantage", centred / (F.col("group_std") + eps) if scaled else centred)


def group_advantage_in_row(groups: DataFrame, draws: str = "draws", reward: str = "reward", scaled: bool = True,
                           eps: float = 1e-4) -> DataFrame:
    """Advantages where a row holds a whole group, as an array of structs with a reward: no exchange, one evaluation.

    Each draw becomes a row with the group's other columns, ``gen_id`` (its place), its fields, ``group_mean``,
    ``group_std`` and ``advantage``, as ``group_advantage`` defines them.
    """
    columns = [c for c in groups.columns if c != draws]
    rewards = groups.withColumn("__r", F.filter(F.transform(draws, lambda d: d[reward].cast("double")), lambda r: r.isNotNull()))
    n = F.size("__r")
    summed = rewards.withColumn("__mean", F.when(n > 0, F.aggregate("__r", F.lit(0.0), lambda acc, r: acc + r) / n))
    squares = F.aggregate("__r", F.lit(0.0), lambda acc, r: acc + (r - F.col("__mean")) * (r - F.col("__mean")))
    summed = summed.withColumn("__std", F.when(n > 1, F.sqrt(squares / (n - 1))))
    rows = summed.select(*columns, "__mean", "__std", F.posexplode(draws).alias("gen_id", "__d"))
    centred = F.col(f"__d.{reward}") - F.col("__mean")
    return rows.select(*columns, "gen_id", "__d.*", F.col("__mean").alias("group_mean"), F.col("__std").alias("group_std"),
                       (centred / (F.col("__std") + eps) if scaled else centred).alias("advantage"))


def minmax_scale_group(df: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    """(x - min) / (max - min + 1e-8) inside the group, and the marker size 50 + 100 * scaled."""
    c = F.col(column)
    rows = with_group_stats(df, list(keys), {"group_min": F.min(c), "group_max": F.max(c)})
    scaled = (c - F.col("group_min")) / (F.col("group_max") - F.col("group_min") + 1e-8)
    return rows.withColumn("scaled", scaled).withColumn("marker_size", 50.0 + 100.0 * F.col("scaled"))
