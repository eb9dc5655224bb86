"""Stateful streams: order of arrival, repeats, late rows, restarts and what is forgotten."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from episodica.session import ship_package
from episodica.streaming import processors

STEP = "episode_id bigint, step_id bigint, reward double, done boolean, ts timestamp"
SCORED = "prompt_id bigint, gen_id int, reward double"


@pytest.fixture(scope="module")
def own(spark):
    ship_package(spark)
    return processors.with_state_store(spark, 2)


@pytest.fixture(scope="module")
def without_timers(spark):
    ship_package(spark)
    return processors.with_state_store(spark, 2, timers=False)


def arrive(own, path, rows, run):
    """Write ``rows`` (episode, step, reward, done, minute) as one file and run the stream over what is new."""
    base = own.createDataFrame([(*r[:4], float(r[4])) for r in rows], "episode_id bigint, step_id bigint, reward double, done boolean, m double")
    ts = (F.lit(1_700_000_000) + F.col("m") * 60).cast("timestamp")
    base.withColumn("ts", ts).drop("m").coalesce(1).write.mode("append").parquet(f"{path}/in")
    run(own.readStream.schema(STEP).parquet(f"{path}/in"))


def returns(path):
    return lambda feed: processors.start(processors.episode_returns(feed), f"{path}/out", f"{path}/cp").awaitTermination()


def found(own, path):
    return sorted((tuple(r) for r in own.read.parquet(f"{path}/out").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def left(own, path, name):
    return own.read.format("statestore").option("stateVarName", name).load(f"{path}/cp")


def test_episodes_end_by_done_or_silence_and_leave_no_state(own, tmp_path):
    path = str(tmp_path)
    run = returns(path)
    arrive(own, path, [(1, 10, 1.0, False, 0), (1, 12, 4.0, True, 2), (1, 11, 2.0, False, 1), (1, 11, 2.0, False, 1), (2, 20, 5.0, False, 0)], run)
    arrive(own, path, [(1, 13, 8.0, False, 3), (3, 30, 1.0, False, 0.5), (3, 31, 1.5, False, 62), (None, 32, 9.0, True, 1)], run)  # a restart
    assert (1, 10, 7.0, 3, True) in found(own, path)
    arrive(own, path, [(9, 90, 0.0, False, 500)], run)  # the watermark passes all
    arrive(own, path, [(1, 14, 100.0, True, 4), (9, 90, 0.0, False, 500)], run)  # late, and repeated
    assert found(own, path) == [(1, 10, 7.0, 3, True), (1, 13, 8.0, 1, False), (2, 20, 5.0, 1, False), (3, 30, 1.0, 1, False),
                                (3, 31, 1.5, 1, False), (None, 32, 9.0, 1, True)]
    assert [(r.key.episode_id, r.value.length) for r in left(own, path, "open").collect()] == [(9, None)]  # its timer
    assert {r.key.episode_id for r in left(own, path, "waiting").collect()} == {9}  # the last step waits


def test_any_order_of_arrival_gives_the_rows_of_a_loop(own, tmp_path):
    r = random.Random(3)
    steps = [(r.randint(1, 4), k, float(r.randint(-9, 9)), r.random() < 0.1, k * 3 + r.choice((0, 0, 0.5))) for k in range(160)]
    wanted, open_ = [], {}
    for e, k, reward, done, m in sorted(steps, key=lambda s: (s[4], s[1])):
        if e in open_ and m - open_[e][3] > 20:
            wanted.append((e, *open_.pop(e)[:3], False))
        start, total, n, _ = open_.get(e, (k, 0.0, 0, 0))
        open_[e] = (start, total + reward, n + 1, m)
        if done:
            wanted.append((e, *open_.pop(e)[:3], True))
    wanted += [(e, *s[:3], False) for e, s in open_.items()]
    path = str(tmp_path)

    def run(feed):
        rows = processors.episode_returns(feed, idle="20 minutes", lateness="3 hours")
        processors.start(rows, f"{path}/out", f"{path}/cp").awaitTermination()

    for k in range(0, 160, 40):  # a part spans two hours; its rows are mixed, and ten of the part before come again
        part = steps[k:k + 40] + steps[max(0, k - 10):k]
        r.shuffle(part)
        arrive(own, path, part, run)
    arrive(own, path, [(-1, 10_000, 0.0, False, 10_000)], run)
    assert found(own, path) == sorted(wanted)


def scored(own, path, rows, ttl):
    own.createDataFrame(rows, SCORED).coalesce(1).write.mode("append").parquet(f"{path}/in")
    feed = own.readStream.schema(SCORED).parquet(f"{path}/in")
    processors.start(processors.group_advantages(feed, 3, ttl), f"{path}/out", f"{path}/cp").awaitTermination()


def test_full_groups_leave_once(without_timers, tmp_path):
    own, path = without_timers, str(tmp_path)
    scored(own, path, [(1, 0, 1.0), (1, 1, 2.0), (1, 1, 50.0), (2, 0, 5.0)], "1 hour")
    scored(own, path, [(1, 2, 6.0), (1, 3, 9.0), (2, 0, 5.0)], "1 hour")  # a restart; one generation too many
    scored(own, path, [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 6.0)], "1 hour")  # all again
    rows = sorted((r.prompt_id, r.gen_id, r.reward, r.group_mean, round(r.advantage, 3)) for r in own.read.parquet(f"{path}/out").collect())
    assert rows == [(1, 0, 1.0, 3.0, -0.756), (1, 1, 2.0, 3.0, -0.378), (1, 2, 6.0, 3.0, 1.134)]
    assert {(r.key.prompt_id, r.list_element.value.gen_id) for r in left(own, path, "waiting").collect()} == {(2, 0)}


def test_incomplete_groups_are_forgotten(without_timers, tmp_path):
    own, path = without_timers, str(tmp_path)
    scored(own, path, [(1, 0, 1.0), (1, 1, 2.0), (2, 0, 1.0)], "1 second")
    time.sleep(2)
    scored(own, path, [(1, 2, 6.0), (3, 0, 1.0)], "1 second")  # the first two have expired
    scored(own, path, [(4, k, float(k)) for k in range(3)], "1 second")
    assert {r.prompt_id for r in own.read.parquet(f"{path}/out").collect()} == {4}
    time.sleep(2)
    scored(own, path, [(5, 0, 1.0)], "1 second")
    assert {r.key.prompt_id for r in left(own, path, "waiting").collect()} == {5}


class Counted:
    """A state of one key in memory that counts the calls it gets."""

    def __init__(self):
        self.held, self.calls = None, []

    def __getattr__(self, name):
        def call(*values):
            self.calls.append(name)
            before = self.held
            if name in ("put", "update"):
                self.held = values[0]
            elif name == "appendList":
                self.held = [*(before or []), *values[0]]
            elif name == "clear":
                self.held = None
            return before is not None if name == "exists" else iter(before or [])
        return call


def test_few_state_calls_for_each_prompt():
    """Each call is a trip to the state store's process, for every prompt of a micro-batch."""
    group = processors.GroupAdvantages(4, 1_000, 0.0)
    group.waiting, group.full = Counted(), Counted()

    def arrive(*rows):
        group.waiting.calls, group.full.calls = [], []
        out = [r.asDict() for r in group.handleInputRows((7,), iter([Row(prompt_id=7, gen_id=g, reward=x) for g, x in rows]), None)]
        return out, len(group.waiting.calls) + len(group.full.calls)

    assert arrive((0, 1.0), (1, None)) == ([], 3)
    assert arrive((1, 5.0)) == ([], 1) and arrive((3, 9.0)) == ([], 2)
    out, calls = arrive((0, 1.0), (2, 2.0), (4, 8.0))
    assert calls == 3 and group.waiting.held is None
    assert [(r["gen_id"], r["reward"], r["group_mean"]) for r in out] == [(0, 1.0, 4.0), (1, None, 4.0), (3, 9.0, 4.0), (2, 2.0, 4.0)]
    assert all(r["group_std"] == pytest.approx(19 ** 0.5) for r in out) and out[1]["advantage"] is None
    assert arrive((0, 1.0), (5, 2.0)) == ([], 2)


@pytest.mark.parametrize("rewards", [(1e300, -1e300, 0.0), (2.0, 2.0, 2.0), (float("inf"), 1.0, 2.0), (float("nan"), None, 3.0), (None, None, None)])
def test_statistics_of_odd_rewards_equal_those_of_a_series(rewards):
    group = processors.GroupAdvantages(3, 1_000, 0.0)
    group.waiting, group.full = Counted(), Counted()
    got = [tuple(r)[2:] for r in group.handleInputRows((7,), iter([Row(prompt_id=7, gen_id=g, reward=x) for g, x in enumerate(rewards)]), None)]
    series = pd.Series(rewards, dtype=float)
    wanted = pd.DataFrame({"reward": series, "mean": series.mean(), "std": series.std(), "advantage": (series - series.mean()) / series.std()})
    assert got == [tuple(None if pd.isna(x) else pytest.approx(x) for x in r) for r in wanted.itertuples(index=False)]
