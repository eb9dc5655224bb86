"""Ranges, normalisation statistics, histograms and sweep summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = 100


def _per_dim(df: DataFrame, column: str, dim: int | None, measures: dict[str, object]) -> DataFrame:
    """One row ``stats``: ARRAY<STRUCT<measures>> over the dimensions of a vector column.

    With a known, narrow width: one pass of plain aggregates and a single result row. Otherwise
    the vector is exploded and pre-aggregated by position.
    """
    if dim is not None and dim <= WIDE:
        return df.agg(F.array(*[
            F.struct(*[m(F.get(F.col(column), F.lit(i))).alias(n) for n, m in measures.items()])
            for i in range(dim)]).alias("stats"))
    by_dim = (df.select(F.posexplode(column).alias("pos", "x")).groupBy("pos")
              .agg(*[m(F.col("x")).alias(n) for n, m in measures.items()]))
    packed = by_dim.agg(F.array_sort(F.collect_list(F.struct("pos", *measures))).alias("s"))  # one row per dimension
    return packed.select(F.transform("s", lambda r: F.struct(*[r[n].alias(n) for n in measures])).alias("stats"))


def dim_ranges(df: DataFrame, column: str, dim: int | None = None) -> DataFrame:
    """One row ``ranges``: (min, max) per dimension."""
    return _per_dim(df, column, dim, {"min": F.min, "max": F.max}).select(F.col("stats").alias("ranges"))


def normalization_stats(df: DataFrame, state: str = "observation", action: str = "action", reward: str = "reward",
                        state_dim: int | None = None, action_dim: int | None = None,
                        fit_on: Column | None = None) -> DataFrame:
    """One row: mean and unbiased std + 1e-8 per dimension of state and action, and of the reward.

    Statistics cover all rows unless ``fit_on`` selects some.
    """
    rows = df.where(fit_on) if fit_on is not None else df
    measures = {"mean": F.avg, "std": lambda x: F.stddev_samp(x) + 1e-8}
    if state_dim is not None and action_dim is not None:
        def packed(column: str, dim: int, name: str) -> Column:
            return F.array(*[measures[name](F.get(F.col(column), F.lit(i))) for i in range(dim)])
        return rows.agg(packed(state, state_dim, "mean").alias("state_mean"),
                        packed(state, state_dim, "std").alias("state_std"),
                        packed(action, action_dim, "mean").alias("action_mean"),
                        packed(action, action_dim, "std").alias("action_std"),
                        F.avg(reward).alias("reward_mean"),
                        (F.stddev_samp(reward) + 1e-8).alias("reward_std"))
    scalars = rows.agg(F.avg(reward).alias("reward_mean"), (F.stddev_samp(reward) + 1e-8).alias("reward_std"))
    out = scalars
    for name, column, dim in (("state", state, state_dim), ("action", action, action_dim)):
        out = out.withColumn("__s", _per_dim(rows, column, dim, measures).scalar()).withColumns({
            f"{name}_mean": F.transform("__s", lambda r: r["mean"]),
            f"{name}_std": F.transform("__s", lambda r: r["std"])}).drop("__s")
    return out.select("state_mean", "state_std", "action_mean", "action_std", "reward_mean", "reward_std")


def moments(df: DataFrame, state_dim: int, action_dim: int, state: str = "observation", action: str = "action",
            reward: str = "reward") -> DataFrame:
    """One row that merges: count, and for each dimension and the reward the mean and the sum of squared deviations."""
    def each(column: str, dim: int, measure) -> Column:
        return F.array(*[F.coalesce(measure(F.get(F.col(column), F.lit(i)).cast("double")), F.lit(0.0)) for i in range(dim)])

    def squares(x: Column) -> Column:
        return F.var_pop(x) * F.count(x)

    r = F.array(F.col(reward).cast("double"))
    return df.withColumn("__r", r).agg(F.count(F.lit(1)).alias("n"), *[
        each(column, dim, measure).alias(f"{name}_{what}") for name, column, dim in (
            ("state", state, state_dim), ("action", action, action_dim), ("reward", "__r", 1))
        for what, measure in (("mean", F.avg), ("m2", squares))])


def merged_moments(parts: DataFrame) -> DataFrame:
    """The moments of all rows from those of parts of them (one row for each part; parts without rows count nothing)."""
    names = ("state", "action", "reward")
    parts = parts.where("n > 0")
    widths = parts.agg(*[F.coalesce(F.max(F.size(f"{k}_mean")), F.lit(0)).alias(k) for k in names]).first()

    def each(name: str, term) -> Column:
        return F.array(*[term(name, i) for i in range(widths[name])])

    total = F.sum("n")
    means = parts.agg(F.struct(*[each(k, lambda k, i: F.sum(F.col("n") * F.get(f"{k}_mean", F.lit(i))) / total).alias(k) for k in names]).alias("m"))

    def squares(name: str, i: int) -> Column:
        shift = F.get(f"{name}_mean", F.lit(i)) - F.get(F.col("m")[name], F.lit(i))
        return F.sum(F.get(f"{name}_m2", F.lit(i)) + F.col("n") * shift * shift)

    return parts.withColumn("m", means.scalar()).agg(F.coalesce(total, F.lit(0)).cast("bigint").alias("n"), *[c for k in names for c in (
        F.any_value(F.col("m")[k]).alias(f"{k}_mean"), each(k, squares).alias(f"{k}_m2"))])


def stats_of_moments(one_row: DataFrame) -> DataFrame:
    """``normalization_stats`` from merged moments."""
    def std(m2: Column) -> Column:
        return F.when(F.col("n") > 1, F.sqrt(m2 / (F.col("n") - 1)) + 1e-8)

    return one_row.select("state_mean", F.transform("state_m2", std).alias("state_std"), "action_mean",
                          F.transform("action_m2", std).alias("action_std"), F.get("reward_mean", F.lit(0)).alias("reward_mean"),
                          std(F.get("reward_m2", F.lit(0))).alias("reward_std"))


def apply_ranges(df: DataFrame, ranges: DataFrame, name: str = "ranges") -> DataFrame:
    """Attach a one-row ranges frame to every row as a scalar subquery."""
    return df.withColumn(name, ranges.scalar())


def min_reward(df: DataFrame, reward: str = "reward") -> DataFrame:
    return df.agg(F.min(reward).alias("min_reward"))


def distinct_actions(df: DataFrame, action: str) -> DataFrame:
    return df.select(action).distinct().orderBy(action)


def count_distinct_actions(df: DataFrame, action: str) -> DataFrame:
    return df.select(action).distinct().agg(F.count(action).alias("n_actions"))


def dataset_size(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Row count, and the effective size ``min(limit, n)``; no limit, or 0, keeps all."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows"), (F.least(n, F.lit(limit)) if limit else n).cast("bigint").alias("effective_size"))


def histogram_density(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between min and max, the last one closed; density = count / (n * width).

    Empty bins are included. A constant column is widened by 0.5 on both sides.
    """
    present = df.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    lo, hi = F.min("x"), F.max("x")
    pad = F.when(lo == hi, 0.5).otherwise(0.0)
    extent = present.agg(F.struct((lo - pad).alias("lo"), (hi + pad).alias("hi"), F.count("x").alias("n")).alias("e"))
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    placed = present.withColumn("e", extent.scalar()).select(
        F.least(F.floor((F.col("x") - F.col("e.lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("bin_count"))
    grid = extent.select("e", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    filled = F.coalesce("bin_count", F.lit(0).cast("bigint"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("e.lo") + width * F.col("bin")).alias("left_edge"), filled.alias("bin_count"),
        (filled / (F.col("e.n") * width)).alias("density"))


def sweep_summary(cells: DataFrame, parameters: list[str], metric: str) -> DataFrame:
    """Mean of the metric for each value of each parameter on its own: one pass of grouping sets."""
    sets = [[F.col(p)] for p in parameters]
    grouped = cells.groupingSets(sets, *[F.col(p) for p in parameters]).agg(
        F.avg(metric).alias("mean_metric"), F.grouping_id().alias("__g"))
    last = len(parameters) - 1
    which, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for i, p in enumerate(parameters):
        only = (1 << len(parameters)) - 1 - (1 << (last - i))
        which = F.when(F.col("__g") == only, F.lit(p)).otherwise(which)
        value = F.when(F.col("__g") == only, F.col(p).cast("double")).otherwise(value)
    return grouped.select(which.alias("parameter"), value.alias("value"), "mean_metric")
