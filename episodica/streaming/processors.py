"""Stateful processors: what a stream remembers of each key, and when it forgets.

They need the RocksDB state store (``with_state_store``). Rows and state cross to Python in batches, a few calls for each
key and micro-batch, not one for each row.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Spark asks a Python process beside the driver for a processor's states before the package is shipped anywhere, so
# processors travel whole, not as the name of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession, partitions: int | None = None, timers: bool = True) -> SparkSession:
    """A session of its own for a stream: the state store the processors need, and one state partition for each core.

    Without ``timers`` no micro-batch runs without data: state that only has a TTL needs none, and in processing time Spark
    would ask for another one forever, so that a stream of the available rows would not end.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    own.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(timers).lower())
    return own


class EpisodeReturns(StatefulProcessor):
    """Returns of the episodes of each key, from steps in any order of arrival.

    Steps (``us`` event time in microseconds, ``step_id``, ``reward``, ``done``) wait in a list until the watermark has passed
    them; no earlier step can come then, so they are added up in the order of time and id. A step with ``done`` ends its
    episode, which leaves at once; a silence longer than ``idle_us`` ends it too, as lost, when a later step shows it or the
    timer does. A repeated step counts once, and a step behind the watermark is late and dropped. A key whose episode has
    ended and that has no step waiting holds no state and no timer; otherwise it holds one timer.
    """

    OUTPUT = "episode_id bigint, start_id bigint, episode_return double, episode_length bigint, complete boolean"

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, step_id bigint, reward double, done boolean")
        # of the open episode (null without one), and the timer: one call reads or writes them all
        self.open = handle.getValueState("open", "start_id bigint, total double, length bigint, last_us bigint, timer bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        first = None
        for batch in rows:
            batch = batch[batch["us"] > passed] if passed > 0 else batch
            if len(batch):
                self.waiting.appendList(list(batch[["us", "step_id", "reward", "done"]].itertuples(index=False, name=None)))
                first = min(int(batch["us"].min()), first or int(batch["us"].min()))
        if first is not None:
            held, at = self.open.get(), -(-first // 1000)
            timer = held[4] if held else None
            if timer is None or at < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(at)
                self.open.update((*(held[:4] if held else (None,) * 4), at))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, held = list(self.waiting.get()), self.open.get()
        steps = sorted({(us, step_id): (us, step_id, reward, done) for us, step_id, reward, done in waiting}.values())
        due, later = [s for s in steps if s[0] <= passed], [s for s in steps if s[0] > passed]
        ended: list[tuple] = []
        state = tuple(held[:4]) if held and held[2] is not None else None
        for us, step_id, reward, done in due:
            if state and us - state[3] > self.idle_us:
                ended.append((*state[:3], False))
                state = None
            state = (step_id, reward, 1, us) if state is None else (state[0], state[1] + reward, state[2] + 1, us)
            if done:
                ended.append((*state[:3], True))
                state = None
        if state and passed > state[3] + self.idle_us:  # whatever comes is after the silence
            ended.append((*state[:3], False))
            state = None
        if later and len(later) < len(waiting):
            self.waiting.put(later)
        elif waiting and not later:
            self.waiting.clear()
        if later or state:
            at = -(-(later[0][0] if later else state[3] + self.idle_us + 1) // 1000)
            self.handle.registerTimer(at)
            self.open.update((*(state or (None,) * 4), at))
        else:
            self.open.clear()
        if ended:
            start, total, length, complete = zip(*ended)
            yield pd.DataFrame({"episode_id": [key[0]] * len(ended), "start_id": start, "episode_return": total,
                                "episode_length": length, "complete": complete})

    def close(self) -> None:
        pass


def episode_returns(feed: DataFrame, event_time: str = "ts", idle: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """One row per episode of the feed (episode_id, step_id, reward, done and an event time), for append mode.

    ``start_id`` is the id of the episode's first step; ``complete`` is false for episodes that fell silent.
    """
    idle_us = pd.Timedelta(idle) // pd.Timedelta(microseconds=1)
    steps = feed.withWatermark(event_time, lateness).select(
        "episode_id", event_time, F.unix_micros(F.col(event_time).cast("timestamp")).alias("us"), "step_id", F.col("reward").cast("double").alias("reward"),
        F.coalesce("done", F.lit(False)).alias("done"))
    return steps.groupBy("episode_id").transformWithStateInPandas(EpisodeReturns(int(idle_us)), EpisodeReturns.OUTPUT, "append", "EventTime")


ADVANTAGE = Row("prompt_id", "gen_id", "reward", "group_mean", "group_std", "advantage")


def _plain(x: float | None) -> float | None:
    """NaN is null."""
    return None if x is None or x != x else x


class GroupAdvantages(StatefulProcessor):
    """Advantages of a prompt's completions once all of them are in.

    Generations wait in a list that expires ``ttl_ms`` after its last change; a full group leaves at once, and what stays is
    a mark, with the same life, that keeps repeated generations silent. A group that stays incomplete is forgotten by its
    TTL, without a timer. Groups are small, so rows come one by one: a data frame for each group costs more than its state.
    """

    OUTPUT = "prompt_id bigint, gen_id int, reward double, group_mean double, group_std double, advantage double"

    def __init__(self, num_generations: int, ttl_ms: int, eps: float):
        self.num_generations, self.ttl_ms, self.eps = num_generations, ttl_ms, eps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "gen_id int, reward double", self.ttl_ms)
        self.full = handle.getValueState("full", "full boolean", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = dict(self.waiting.get())
        before = len(held)
        if not before and self.full.exists():  # what waits is not full
            return
        for row in rows:
            if len(held) < self.num_generations:
                held.setdefault(row[1], row[2])
        if len(held) < self.num_generations:
            if not before:
                self.waiting.appendList(list(held.items()))
            elif len(held) > before:
                self.waiting.put(list(held.items()))  # all of them live on
            return
        if before:
            self.waiting.clear()
        self.full.update((True,))
        known = [r for r in held.values() if _plain(r) is not None]
        mean = sum(known) / len(known) if known else math.nan
        std = math.sqrt(sum((r - mean) * (r - mean) for r in known) / (len(known) - 1)) if len(known) > 1 else math.nan
        scale = std + self.eps
        for gen, r in held.items():
            advantage = None if _plain(r) is None or scale == 0 else (r - mean) / scale
            yield ADVANTAGE(key[0], gen, *map(_plain, (r, mean, std, advantage)))

    def close(self) -> None:
        pass


def group_advantages(scored: DataFrame, num_generations: int, ttl: str = "1 hour", eps: float = 1e-4) -> DataFrame:
    """The feed's (prompt_id, gen_id, reward) with the statistics of full groups, for append mode."""
    life = int(pd.Timedelta(ttl) // pd.Timedelta(milliseconds=1))
    rows = scored.select("prompt_id", F.col("gen_id").cast("int").alias("gen_id"), F.col("reward").cast("double").alias("reward"))
    return rows.groupBy("prompt_id").transformWithState(
        GroupAdvantages(num_generations, life, eps), GroupAdvantages.OUTPUT, "append", "ProcessingTime")


def start(rows: DataFrame, out: str, checkpoint: str, **trigger):
    """Append the rows of a stream to Parquet."""
    return (rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
