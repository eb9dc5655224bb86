"""Returns, training curves, histograms and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import evaluate, sampling, stats
from ..sources.tables import Inputs
from .registry import hash_key, oracle, query, rnd, rounded
from .rewards import mse_sql

_RETURNS = {"returns": """SELECT user_id % 4 AS policy, user_id AS episode_id, sum(value) AS ret, count(*) AS len
                          FROM events GROUP BY user_id"""}


@query("episode_returns", oracle(f"""
    SELECT episode_id, {rnd('ret', 4)} AS episode_return, len AS episode_length FROM returns""", more=_RETURNS))
def episode_returns(i: Inputs) -> DataFrame:
    return evaluate.episode_returns(i.rollouts()).select(
        "episode_id", rounded("episode_return", 4).alias("episode_return"), "episode_length")


@query("evaluation_summary", oracle(f"""
    SELECT policy, {rnd('avg(ret)', 4)} AS mean_return, {rnd('stddev_pop(ret)', 4)} AS std_return,
           {rnd('avg(len)', 4)} AS mean_length, {rnd('stddev_pop(len)', 4)} AS std_length, count(*) AS n_episodes
    FROM returns GROUP BY GROUPING SETS ((policy), ())""", more=_RETURNS))
def evaluation_summary(i: Inputs) -> DataFrame:
    """One row for each policy, and one (policy null) for all episodes, from one pass over the log."""
    returns = evaluate.episode_returns(i.rollouts(), ["policy", "episode_id"])
    return evaluate.evaluation_summary(returns, ["policy"], overall=True).select("policy", *[rounded(c, 4).alias(c) for c in (
        "mean_return", "std_return", "mean_length", "std_length")], "n_episodes")


@query("best_epoch", oracle("""
    SELECT run, arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS best_loss
    FROM (SELECT run, epoch, val_loss FROM metrics) GROUP BY run""", "metrics"))
def best_epoch(i: Inputs) -> DataFrame:
    return evaluate.best_epoch(i.metrics())


PATIENCE, MIN_DELTA = 7, 0.5


@query("early_stop_epoch", oracle(f"""
    SELECT run, min(CASE WHEN streak >= {PATIENCE} THEN epoch END) AS stop_epoch,
           arg_max(best, epoch) AS best_loss, max(CASE WHEN streak = 0 AND epoch >= 0 THEN epoch END) AS best_epoch
    FROM walk GROUP BY run""", "metrics", more={"walk": f"""
    SELECT run, -1::BIGINT AS epoch, 'infinity'::DOUBLE AS best, 0 AS streak FROM (SELECT DISTINCT run FROM metrics)
    UNION ALL
    SELECT m.run, m.epoch,
           CASE WHEN m.val_loss < w.best - {MIN_DELTA}::DOUBLE THEN m.val_loss ELSE w.best END,
           CASE WHEN m.val_loss < w.best - {MIN_DELTA}::DOUBLE THEN 0 ELSE w.streak + 1 END
    FROM walk w JOIN metrics m ON m.run = w.run AND m.epoch = w.epoch + 1 WHERE w.streak < {PATIENCE}"""}
    ).replace("WITH ", "WITH RECURSIVE ", 1))
def early_stop_epoch(i: Inputs) -> DataFrame:
    return evaluate.early_stop_epoch(i.metrics(), PATIENCE, MIN_DELTA).select("run", "stop_epoch", "best_loss", "best_epoch")


_BATCHED = {"losses": f"""
    SELECT prompt_id, {mse_sql('mean', 'action')} AS loss,
           (row_number() OVER (ORDER BY {hash_key(42, 'prompt_id')}, prompt_id) - 1) // 2048 AS batch,
           CASE WHEN CASE WHEN logits[1] >= logits[2] THEN 0 ELSE 1 END = action_disc THEN 0::DOUBLE ELSE 1::DOUBLE END
             AS wrong FROM policy_outputs"""}


def _batched(i: Inputs) -> DataFrame:
    rows = sampling.minibatches(i.policy_outputs(), "prompt_id", 2048, 42, drop_last=False)
    wrong = F.when(vectors.argmax(F.col("logits")) == F.col("action_disc"), 0.0).otherwise(1.0)
    return rows.withColumns({"loss": vectors.mse(F.col("mean"), F.col("action")), "wrong": wrong})


@query("batched_mean_loss", oracle(f"""
    SELECT {rnd('avg(m)')} AS mean_loss, count(*) AS n_batches
    FROM (SELECT batch, avg(loss) AS m FROM losses GROUP BY batch)""", "policy_outputs", more=_BATCHED))
def batched_mean_loss(i: Inputs) -> DataFrame:
    return evaluate.batched_mean_loss(_batched(i)).select(rounded("mean_loss").alias("mean_loss"), "n_batches")


@query("policy_mse", oracle(f"""
    SELECT {rnd('avg(loss)')} AS mse, {rnd('(SELECT avg(m) FROM (SELECT avg(loss) AS m FROM losses GROUP BY batch))')}
           AS batched_mse FROM losses""", "policy_outputs", more=_BATCHED))
def policy_mse(i: Inputs) -> DataFrame:
    per_batch = _batched(i).groupBy("batch").agg(F.sum("loss").alias("s"), F.count(F.lit(1)).alias("n"))
    return per_batch.agg(rounded(F.sum("s") / F.sum("n")).alias("mse"),
                         rounded(F.avg(F.col("s") / F.col("n"))).alias("batched_mse"))


@query("policy_zero_one_loss", oracle(f"""
    SELECT {rnd('avg(m)')} AS mean_loss, count(*) AS n_batches
    FROM (SELECT batch, avg(wrong) AS m FROM losses GROUP BY batch)""", "policy_outputs", more=_BATCHED))
def policy_zero_one_loss(i: Inputs) -> DataFrame:
    return evaluate.batched_mean_loss(_batched(i), "wrong").select(
        rounded("mean_loss").alias("mean_loss"), "n_batches")


@query("histogram_density", oracle(f"""
    SELECT b.bin::INTEGER AS bin, {rnd('e.lo + e.w * b.bin', 4)} AS left_edge, coalesce(c.n, 0) AS bin_count,
           {rnd('coalesce(c.n, 0) / (e.n * e.w)')} AS density
    FROM (SELECT unnest(range(20)) AS bin) b, extent e LEFT JOIN counts c ON c.bin = b.bin""", "transitions", more={
    "extent": "SELECT min(reward) AS lo, (max(reward) - min(reward)) / 20 AS w, count(*) AS n FROM transitions",
    "counts": """SELECT least(floor((t.reward - e.lo) / e.w), 19)::INTEGER AS bin, count(*) AS n
                 FROM transitions t, extent e GROUP BY 1"""}))
def histogram_density(i: Inputs) -> DataFrame:
    bars = stats.histogram_density(i.transitions(), "reward", 20)
    return bars.select("bin", rounded("left_edge", 4).alias("left_edge"), "bin_count",
                       rounded("density").alias("density"))
