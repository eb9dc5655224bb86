"""Streaming queries, run to the end of the available files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources.tables import GENERATIONS, Inputs
from ..streaming import completions, processors
from .groups import ADVANTAGES
from .registry import oracle, query, rnd, rounded
from .rewards import BC_DISCRETE_SQL, FORMAT_DISCRETE_SQL, discrete_registry, discrete_scores


def _as_feed(i: Inputs, rows: DataFrame, folder: str, per_trigger: int) -> DataFrame:
    rows.write.parquet(folder)
    return i.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


@query("stream_score_completions", oracle(f"""
    SELECT prompt_id, gen_id, {rnd(f'({FORMAT_DISCRETE_SQL}) + ({BC_DISCRETE_SQL})')} AS reward
    FROM completions_discrete""", "completions_discrete"))
def stream_score_completions(i: Inputs) -> DataFrame:
    folder = scratch_dir(i.spark, "scoring")
    feed = _as_feed(i, i.completions_discrete("action_disc"), f"{folder}/in", 3)  # several micro-batches
    job = completions.start_scoring(feed, discrete_registry(), f"{folder}/out", f"{folder}/checkpoint", f"{folder}/log")
    job.awaitTermination()
    return i.spark.read.parquet(f"{folder}/out").select("prompt_id", "gen_id", rounded("reward").alias("reward"))


#: Parts in which the feed arrives, the silence that ends an episode, and how late a step may come.
ARRIVALS, IDLE, LATENESS = 3, "6 hours", "10 minutes"


@query("stream_episode_returns", oracle(f"""
    SELECT user_id AS episode_id, min_by(event_id, (ts, event_id)) AS start_id, {rnd('sum(value)', 4)} AS episode_return,
           count(*) AS episode_length, bool_or(done) AS complete
    FROM (SELECT *, sum(CASE WHEN before_done OR gap > INTERVAL {IDLE} THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS episode
          FROM (SELECT user_id, event_id, ts, value, event_type = 'error' AS done,
                       coalesce(lag(event_type = 'error') OVER w, false) AS before_done, ts - lag(ts) OVER w AS gap
                FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
    GROUP BY user_id, episode"""))
def stream_episode_returns(i: Inputs) -> DataFrame:
    """The raw log as a feed of steps: an error ends a user's episode, and so does a long silence.

    The log arrives in parts, partly twice and, within the lateness, out of order; a last step of nobody moves the
    watermark, so that every episode is closed and its state dropped. Nothing is numbered or ordered beforehand.
    """
    folder = scratch_dir(i.spark, "returns")
    log = i.table("events").select(
        F.col("user_id").alias("episode_id"), F.col("event_id").alias("step_id"), F.col("value").alias("reward"),
        (F.col("event_type") == "error").alias("done"), F.col("ts").cast("timestamp").alias("ts"))
    extent = log.agg(F.min(F.unix_micros("ts")).alias("first"), F.max(F.unix_micros("ts")).alias("last")).first()
    own = processors.with_state_store(i.spark)
    early = F.pmod(F.xxhash64("step_id"), F.lit(2)) * 1_000_000 * 300   # half of the steps come up to five minutes early
    share = F.least(F.floor((F.unix_micros("ts") - early - extent["first"]) / (extent["last"] - extent["first"] + 1) * ARRIVALS), F.lit(ARRIVALS - 1))
    for k in range(ARRIVALS + 1):
        part = log.where(F.greatest(share, F.lit(0)) == k)
        nobody = i.spark.range(1).select(F.lit(-1).cast("bigint").alias("episode_id"), F.lit(-1).cast("bigint").alias("step_id"),
                                         F.lit(0.0).alias("reward"), F.lit(False).alias("done"),
                                         F.timestamp_micros(F.lit(extent["last"] + 30 * 86_400 * 1_000_000)).alias("ts"))
        part = nobody if k == ARRIVALS else part.unionByName(part.where("step_id % 10 = 0"))
        part.write.mode("append").parquet(f"{folder}/in")
        feed = own.readStream.schema(log.schema).parquet(f"{folder}/in")
        returns = processors.episode_returns(feed, idle=IDLE, lateness=LATENESS)
        processors.start(returns, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return i.spark.read.parquet(f"{folder}/out").select(
        "episode_id", "start_id", rounded("episode_return", 4).alias("episode_return"), "episode_length", "complete")


@query("stream_group_advantage", oracle(f"""
    SELECT prompt_id, gen_id, {rnd('reward', 4)} AS reward, {rnd('group_std', 4)} AS group_std,
           {rnd('advantage', 4)} AS advantage FROM advantages""", "completions_discrete", more=ADVANTAGES))
def stream_group_advantage(i: Inputs) -> DataFrame:
    """Scored completions in two arrivals that cut through groups, the second with repeats; a group leaves when it is full."""
    folder = scratch_dir(i.spark, "advantages")
    own = processors.with_state_store(i.spark, timers=False)
    scored = discrete_scores(i).select("prompt_id", F.col("gen_id").cast("int").alias("gen_id"), "reward")
    scored.write.partitionBy("gen_id").parquet(f"{folder}/scored")
    scored = i.spark.read.schema(scored.schema).parquet(f"{folder}/scored")
    for part in ("gen_id < 2", "gen_id >= 2 OR prompt_id % 5 = 0"):
        scored.where(part).write.mode("append").parquet(f"{folder}/in")
        feed = own.readStream.schema(scored.schema).parquet(f"{folder}/in")
        processors.start(processors.group_advantages(feed, GENERATIONS, "7 days"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return i.spark.read.parquet(f"{folder}/out").select(
        "prompt_id", "gen_id", *[rounded(c, 4).alias(c) for c in ("reward", "group_std", "advantage")])
