"""Returns of episodes that only silence ends: built-in stateful aggregates, summed before the shuffle.

Episodes that a final step ends are in ``processors``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _totals() -> list:
    last = F.max(F.when(F.col("done"), F.col("step")))
    n = F.count(F.lit(1))
    return [F.sum("reward").alias("episode_return"), n.alias("episode_length"),
            F.coalesce(n > last, F.lit(False)).alias("complete")]


def session_returns(feed: DataFrame, event_time: str = "ts", idle: str = "1 hour",
                    lateness: str = "10 minutes") -> DataFrame:
    """One row per episode once it has been silent for ``idle``, for append mode.

    Repeated steps within the lateness are dropped, later rows cannot change a closed episode, lost
    episodes come out with ``complete`` false, and state is evicted by the watermark.
    """
    steps = feed.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["episode_id", "step"])
    sessions = steps.groupBy("episode_id", F.session_window(event_time, idle).alias("session")).agg(*_totals())
    return sessions.select("episode_id", "episode_return", "episode_length", "complete")


def start_session_returns(feed: DataFrame, out: str, checkpoint: str, event_time: str = "ts", idle: str = "1 hour",
                          lateness: str = "10 minutes", **trigger) -> StreamingQuery:
    """Append episodes closed by silence to Parquet."""
    return (session_returns(feed, event_time, idle, lateness).writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
