"""Group statistics and row numbers that survive one group holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import range_number


def _attach(df: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys. Both sides are exchanged for it, so adaptive execution can split a hot key."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"__right_{key}"))
    return df.join(right, match, "left").drop(*[f"__right_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Add statistics of each row's group; rows with null keys are a group too.

    The statistics are aggregated before the shuffle and joined back, so no task needs a whole group: the input is
    evaluated twice, and its rows are exchanged once, in a join whose hot keys Spark splits.
    """
    grouped = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return _attach(df, grouped, keys)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_index", size: str | None = None) -> DataFrame:
    """0-based position of each row in its group (rows with null keys are a group), and the group's ``size`` if named.

    All rows are numbered in the order of group and ``order`` by ranges of near equal size (``range_number``), so neither a
    hot group nor many rows of one time meet in a task; a position is the number less that of the group's first row. The
    input is read once and written; give only the columns that are needed.
    """
    numbered = range_number(df, [F.col(k) for k in [*keys, *order]], "__number")
    groups = numbered.groupBy(*keys).agg(F.min("__number").alias("__first"), F.count(F.lit(1)).alias("__size"))
    more = [F.col("__size").alias(size)] if size else []
    return _attach(numbered, groups, keys).select(*df.columns, (F.col("__number") - F.col("__first")).alias(name), *more)
