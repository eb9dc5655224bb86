"""Reports on rollouts, attempts, rewards and training curves."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCHS_PER_BUCKET = 10_000


def episode_returns(rollouts: DataFrame, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Return and length of each episode; steps are summed before the shuffle."""
    return rollouts.groupBy(*keys).agg(F.sum("reward").alias("episode_return"),
                                       F.count(F.lit(1)).alias("episode_length"))


def evaluation_summary(returns: DataFrame, keys: Sequence[str] = (), overall: bool = False) -> DataFrame:
    """Mean and population std of returns and lengths, for each value of ``keys`` and, if ``overall``, for all episodes.

    The row of all episodes has null keys. The lists stay rows of ``episode_returns``.
    """
    grouped = returns.groupingSets([list(keys), []], *keys) if overall else returns.groupBy(*keys)
    return grouped.agg(
        F.avg("episode_return").alias("mean_return"), F.stddev_pop("episode_return").alias("std_return"),
        F.avg("episode_length").alias("mean_length"), F.stddev_pop("episode_length").alias("std_length"),
        F.count(F.lit(1)).alias("n_episodes"))


def first_valid_attempt(attempts: DataFrame, action: Column, tol: int, key: str = "prompt_id") -> DataFrame:
    """The first attempt that parses within tol + 1 tries; ``failed`` when none does.

    ``action`` parses the response (NULL when invalid). Only the earliest valid attempt per prompt
    leaves the map side.
    """
    tried = attempts.where(F.col("attempt") <= tol + 1).select(key, "attempt", action.alias("action"))
    valid = F.when(F.col("action").isNotNull(), F.col("attempt"))
    return (tried.groupBy(key).agg(F.min_by("action", valid).alias("action"), F.min(valid).alias("tries"))
            .withColumn("failed", F.col("tries").isNull()))


def retry_stats(first: DataFrame, tries: str = "tries") -> DataFrame:
    return first.agg(F.avg(tries).alias("mean_tries"), F.stddev_pop(tries).alias("std_tries"),
                     F.min(tries).alias("min_tries"), F.max(tries).alias("max_tries"))


def reward_report(rows: DataFrame, reward_columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(metric, value): mean per reward function, mean total, mean group std and other means, one pass."""
    names = {**{f"rewards/{c.removeprefix('reward_')}": c for c in reward_columns},
             "reward": "reward", "reward_std": "group_std", **{c: c for c in extra}}
    means = rows.agg(*[F.avg(c).alias(n) for n, c in names.items()])
    return means.unpivot([], list(names), "metric", "value")


def to_metric_rows(wide: DataFrame, run: str, step: str, tags: Sequence[str]) -> DataFrame:
    """Wide metrics to (run, tag, step, value) rows."""
    typed = wide.select(F.col(run).cast("string").alias("run"), F.col(step).cast("bigint").alias("step"),
                        *[F.col(t).cast("double").alias(t) for t in tags])
    return typed.unpivot(["run", "step"], list(tags), "tag", "value").select("run", "tag", "step", "value")


def batched_mean_loss(rows: DataFrame, loss: str = "loss", batch: str = "batch",
                      keys: Sequence[str] = ()) -> DataFrame:
    """Mean of batch means, so a short last batch weighs as much as a full one."""
    per_batch = rows.groupBy(*keys, batch).agg(F.avg(loss).alias("__m"))
    return per_batch.groupBy(*keys).agg(F.avg("__m").alias("mean_loss"), F.count(F.lit(1)).alias("n_batches"))


def best_epoch(metrics: DataFrame, loss: str = "val_loss", run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Epoch and loss of the best validation loss; the first epoch wins ties."""
    order = F.struct(F.col(loss).alias("l"), F.col(epoch).alias("e"))
    best = metrics.groupBy(run).agg(F.min(order).alias("b"))
    return best.select(run, F.col("b.e").alias("best_epoch"), F.col("b.l").alias("best_loss"))


_STATE = "struct<best: double, at: bigint, stop: bigint>"
_STARTS = "bucket bigint, last bigint, e array<bigint>, l array<double>, best array<double>, at array<bigint>, stop array<bigint>"


def _chain(e: np.ndarray, l: np.ndarray, start: int, patience: int, delta: float) -> tuple[float, int, int | None]:
    """Best loss, its epoch and the first stop of decreasing records, from an accepted one on."""
    at = start
    while True:
        following = at + 1 + int(np.searchsorted(-l[at + 1:], -(l[at] - delta), "right"))
        if following == len(l):
            return float(l[at]), int(e[at]), None
        if e[following] - e[at] > patience:
            return float(l[at]), int(e[at]), int(e[at]) + patience
        at = following


def _summary(patience: int, delta: float, run: str):
    """A bucket of a run as a function of the best loss before it.

    That best loss lies between the running minimum ``low`` and low + delta, so only the records from the first below
    ``low`` to the first below low - delta can be the first to be accepted; each is kept with what follows from it.
    """
    def summarise(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["e"].to_numpy(), kind="stable")
        e, l = rows["e"].to_numpy()[order], rows["l"].to_numpy(zero_copy_only=False)[order]
        low = rows["low"][0].as_py()
        number = np.where(np.isnan(l), np.inf, l)
        records = number < np.minimum(np.minimum.accumulate(np.concatenate([[np.inf], number[:-1]])), low)
        re, rl = e[records], l[records]
        starts = range(min(len(rl), int(np.searchsorted(-rl, -(low - delta), "right")) + 1))
        ends = [_chain(re, rl, k, patience, delta) for k in starts]
        return pa.table({run: rows[run].slice(0, 1), "bucket": rows["bucket"].slice(0, 1), "last": [int(e[-1])],
                         "e": pa.array([re[:len(ends)]], pa.list_(pa.int64())), "l": pa.array([rl[:len(ends)]], pa.list_(pa.float64())),
                         **{name: pa.array([[x[k] for x in ends]], kind) for k, (name, kind) in enumerate(
                             (("best", pa.list_(pa.float64())), ("at", pa.list_(pa.int64())), ("stop", pa.list_(pa.int64()))))}})
    return summarise


def _advance(state: Column, bucket: Column, patience: int, delta: float) -> Column:
    """The state after a summarised bucket."""
    first = F.array_position(F.transform(bucket["l"], lambda x: x < state["best"] - delta), True).cast("int")
    silent = F.when(bucket["last"] - state["at"] >= patience, state["at"] + patience)
    late = F.get(bucket["e"], first - 1) - state["at"] > patience

    def struct(best: Column, at: Column, stop: Column) -> Column:
        return F.struct(best.alias("best"), at.alias("at"), stop.alias("stop")).cast(_STATE)

    went_on = struct(F.get(bucket["best"], first - 1), F.get(bucket["at"], first - 1), F.get(bucket["stop"], first - 1))
    return (F.when(state["stop"].isNotNull(), state).when(first == 0, struct(state["best"], state["at"], silent))
            .when(late, struct(state["best"], state["at"], state["at"] + patience)).otherwise(went_on))


def early_stop_epoch(metrics: DataFrame, patience: int, min_delta: float = 0.0, loss: str = "val_loss",
                     run: str = "run", epoch: str = "epoch") -> DataFrame:
    """First epoch at which ``patience`` epochs in a row failed to beat best - min_delta, the best loss and its epoch.

    Epochs of a run are numbered consecutively and dealt into buckets of EPOCHS_PER_BUCKET. In the first bucket of a run the
    running minima, which alone can beat the best, are folded in order. Of every later bucket a summary says how the best
    loss before it leads to the one after it; summaries, few numbers each, are folded in the order of the buckets. So no
    task holds more than a bucket, however long the run and however often its loss falls. A NULL loss beats nothing; a run
    none of whose losses is a number has best loss infinity and no best epoch.
    """
    width = F.floor(F.col("e") / EPOCHS_PER_BUCKET)
    rows = metrics.select(run, F.col(epoch).cast("bigint").alias("e"), F.col(loss).cast("double").alias("l")).withColumn("bucket", width)
    buckets = rows.groupBy(run, "bucket").agg(F.min("l").alias("m"), F.min("e").alias("first"), F.max("e").alias("last"))
    by_bucket = Window.partitionBy(run).orderBy("bucket")  # a row for each bucket
    infinity = F.lit(float("inf"))
    buckets = buckets.select(run, "bucket", "first", "last", (F.row_number().over(by_bucket) == 1).alias("opens"), F.coalesce(
        F.min("m").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), infinity).alias("low"))
    known = rows.join(buckets, [run, "bucket"])

    inside = Window.partitionBy(run, "bucket").orderBy("e").rowsBetween(Window.unboundedPreceding, -1)
    records = known.where("opens").withColumn("before", F.coalesce(F.min("l").over(inside), infinity)).where("l < before")
    folded = records.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("e", "l"))).alias("rs"))  # of one bucket

    def state(best: Column, at: Column, stop: Column) -> Column:
        return F.struct(best.alias("best"), at.alias("at"), stop.alias("stop")).cast(_STATE)

    def step(s: Column, r: Column) -> Column:
        late = s["stop"].isNull() & (r["e"] - s["at"] > patience)
        better = s["stop"].isNull() & (r["l"] < s["best"] - min_delta)
        return (F.when(late, state(s["best"], s["at"], s["at"] + patience))
                .when(better, state(r["l"], r["e"], F.lit(None))).otherwise(s))

    opened = buckets.where("opens").join(folded, run, "left").withColumn("s", F.aggregate(
        F.coalesce("rs", F.array().cast("array<struct<e:bigint,l:double>>")), state(infinity, F.col("first") - 1, F.lit(None)), step))
    kind = metrics.schema[run].dataType.simpleString()
    later = known.where("NOT opens").groupBy(run, "bucket").applyInArrow(
        _summary(patience, min_delta, run), f"`{run}` {kind}, {_STARTS}")
    summaries = later.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(
        "bucket", "last", "e", "l", "best", "at", "stop"))).alias("later"), F.max("last").alias("end"))
    ended = opened.join(summaries, run, "left").withColumn("s", F.when(F.col("later").isNull(), F.col("s")).otherwise(
        F.aggregate("later", F.when(F.col("s.stop").isNull() & (F.col("last") - F.col("s.at") >= patience),
                                    state(F.col("s.best"), F.col("s.at"), F.col("s.at") + patience)).otherwise(F.col("s")),
                    lambda s, b: _advance(s, b, patience, min_delta))))
    end = F.when(F.coalesce("end", "last") - F.col("s.at") >= patience, F.col("s.at") + patience)
    return ended.select(run, F.coalesce("s.stop", end).alias("stop_epoch"), F.col("s.best").alias("best_loss"),
                        F.when(F.col("s.at") >= F.col("first"), F.col("s.at")).alias("best_epoch"))


def offline_policy_eval(logged: DataFrame, policies: dict[str, Column], reward: str = "reward") -> DataFrame:
    """Policies on logged transitions: error, disagreement and reward, best (least error) first.

    Each policy is a struct of squared_error and wrong (0/1). The log is read once; a row is repeated per policy after
    scoring, and only sums are shuffled.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("policy"), p["squared_error"].alias("squared_error"),
                                        p["wrong"].alias("wrong")) for name, p in policies.items()]))
    report = logged.select(F.col(reward).alias("reward"), each.alias("p")).groupBy("p.policy").agg(
        F.avg("p.squared_error").alias("mse"), F.avg("p.wrong").alias("zero_one_loss"),
        F.sum("reward").alias("total_reward"), F.count(F.lit(1)).alias("n_steps"))
    return report.orderBy("mse", "policy")
