"""Skewed groups, exact cuts, folds, scoring and plans, each against brute force on small fixtures."""

import datetime
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica import schemas
from episodica.functions import numbers, policy
from episodica.operators import episodes, evaluate, groups, ranking, sampling, scoring, skew, stats
from episodica.plans import QUERIES
from episodica.streaming.episodes import start_session_returns

SF = "/root/testdata/sf0.001"


def skewed(spark, n=600):
    """A third of the rows belong to key 0."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50)
    return spark.range(n).select(F.col("id").alias("gen_id"), key.alias("prompt_id"),
                                 (F.col("id") * 37 % 101).cast("double").alias("reward"))


def rows_of(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_advantage_of_hot_and_null_groups_equals_windows(spark):
    df = skewed(spark).withColumn("prompt_id", F.when(F.col("prompt_id") > 3, F.col("prompt_id")))  # half the keys are null
    columns = ("gen_id", "group_mean", "group_std", "advantage")
    w = Window.partitionBy("prompt_id")
    plain = df.withColumns({"group_mean": F.avg("reward").over(w), "group_std": F.stddev_samp("reward").over(w)})
    plain = plain.withColumn("advantage", (F.col("reward") - F.col("group_mean")) / (F.col("group_std") + 1e-4))
    assert rows_of(plain, *columns) == rows_of(groups.group_advantage(df), *columns)
    literal = spark.createDataFrame([(1, g, float(g + 1)) for g in range(3)], "prompt_id int, gen_id int, reward double")
    got = [r["advantage"] for r in groups.group_advantage(literal).orderBy("gen_id").collect()]
    assert got == pytest.approx([-0.9999, 0.0, 0.9999], abs=1e-4)
    single = groups.group_advantage(literal.where("gen_id = 0")).first()
    assert single["advantage"] is None


def test_number_rows_of_hot_groups_equals_plain(spark):
    df = skewed(spark)
    w = Window.partitionBy("prompt_id").orderBy("reward", "gen_id")
    expected = rows_of(df.withColumn("p", (F.row_number().over(w) - 1).cast("bigint")), "gen_id", "p")
    got = skew.number_rows(df, ["prompt_id"], ["reward", "gen_id"], "p", "n")
    assert rows_of(got, "gen_id", "p") == expected
    counts = {r["prompt_id"]: r["count"] for r in df.groupBy("prompt_id").count().collect()}
    assert all(r["n"] == counts[r["prompt_id"]] for r in got.collect())


def test_ranges_are_even_for_one_hot_minute_and_a_far_key(spark, monkeypatch):
    """All rows of one group in one minute, and one key far off: no range has more than twice the mean."""
    rows = spark.range(40_000).select(F.lit(1).alias("user"), F.lit("2024-01-01 00:00").alias("minute"),
                                      F.when(F.col("id") == 0, F.lit(2**60)).otherwise(F.col("id")).alias("event"))
    written, write = [], ranking._written
    monkeypatch.setattr(ranking, "_written", lambda frame, label: written.append(write(frame, label)) or written[-1])
    got = skew.number_rows(rows, ["user"], ["minute", "event"], "step", "n")
    assert {r["event"]: r["step"] for r in got.collect()} == {**{k: k - 1 for k in range(1, 40_000)}, 2**60: 39_999}
    sizes = [r["count"] for r in written[-1].groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 40_000 / 8


@pytest.mark.parametrize("k", [0, 1, 12_345, 39_999, 40_000, 10**6])
def test_cut_by_sketches(spark, k):
    crowded = spark.range(40_000).select(F.when(F.col("id") == 39_999, F.lit(2**60)).otherwise(F.col("id") * 3).alias("key"))
    assert ranking.cut_number(crowded, "key", k, in_one_task=500) == (None if not k else 2**60 if k >= 40_000 else 3 * (k - 1))


@pytest.mark.parametrize("k", [0, 1, 17, 599, 600, 5000])
def test_exact_cuts(spark, k):
    df = spark.range(600)
    order = [r["id"] for r in df.orderBy(numbers.order_key(7, F.col("id"))).collect()]
    got = {r["id"] for r in ranking.first_k_by_hash(df, "id", 7, k).where("chosen").collect()}
    assert got == set(order[:k])
    head = {r["id"] for r in ranking.first_k_by_number(df.where("id % 7 <> 3"), "id", k).collect()}
    assert head == set([i for i in range(600) if i % 7 != 3][:k])


def test_seeded_operators_ignore_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "prompt_id")
    for fn in (lambda d: sampling.train_val_split_exact(d, "prompt_id", 3),
               lambda d: sampling.minibatches(d, "prompt_id", 64, 3),
               lambda d: sampling.bernoulli_sample(d, "prompt_id", 0.3, 3)):
        one, seven = fn(df.repartition(1)), fn(df.repartition(7))
        assert sorted(one.collect()) == sorted(seven.collect())
    split = sampling.train_val_split_exact(df.limit(25), "prompt_id", 3)
    assert split.where("split = 'val'").count() == round(2.5)
    batches = sampling.minibatches(df, "prompt_id", 64, 3).groupBy("batch").count().collect()
    assert len(batches) == 7 and {b["count"] for b in batches} == {64}


def test_episode_round_trip_with_segments(spark):
    rows = [(e, s, [float(s), 1.0], [float(e)], float(s)) for e, n in ((1, 10), (2, 3), (3, 4)) for s in range(n)]
    df = spark.createDataFrame(rows, "episode_id bigint, step bigint, observation array<double>, action array<double>, reward double")
    packed = episodes.assemble_episodes(df, 4)
    assert packed.count() == 5
    ends = {(r["episode_id"], r["segment"]): (r["first_step"], r["observations"][-1][0]) for r in packed.collect()}
    assert ends == {(1, 0): (0, 4.0), (1, 1): (4, 8.0), (1, 2): (8, 9.0), (2, 0): (0, 2.0), (3, 0): (0, 3.0)}
    assert sorted(tuple(r) for r in episodes.flatten_episodes(packed).collect()) == sorted(rows)
    running = {(r["episode_id"], r["step"]): r["running_return"]
               for r in episodes.running_return(df, bucket_steps=4).collect()}
    assert running[(1, 9)] == 45.0 and running[(2, 2)] == 3.0


def stop_twin(losses, patience, delta):
    best, streak = math.inf, 0
    for e, loss in enumerate(losses):
        if loss < best - delta:
            best, streak = loss, 0
        else:
            streak += 1
            if streak >= patience:
                return e, best
    return None, best


def test_early_stop_equals_loop(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "EPOCHS_PER_BUCKET", 5)
    rng = random.Random(11)
    runs = [[max(0.0, 5 - 0.1 * e * rng.random()) + rng.random() * rng.choice([0.1, 1, 3]) for e in range(rng.randint(1, 60))]
            for _ in range(120)] + [[math.nan] * 4, [3.0, math.nan, 2.0], [1.0]]
    df = spark.createDataFrame([(r, e, x) for r, run in enumerate(runs) for e, x in enumerate(run)],
                               "run int, epoch bigint, val_loss double").cache()
    for patience, delta in ((3, 0.0), (3, 0.2), (8, 0.05), (12, 0.9), (1, 0.0)):
        got = {r["run"]: (r["stop_epoch"], r["best_loss"])
               for r in evaluate.early_stop_epoch(df, patience, delta).collect()}
        assert got == {r: stop_twin(run, patience, delta) for r, run in enumerate(runs)}


def test_early_stop_of_a_run_that_always_falls(spark):
    """A million epochs: no group has more rows than a bucket, and what is folded is a few numbers for each bucket."""
    n = 1_000_000
    falls = spark.range(n, numPartitions=8).select(F.lit("a").alias("run"), F.col("id").alias("epoch"), (-F.col("id") * 0.4).alias("val_loss"))
    ends = spark.range(n, n + 30).select(F.lit("a").alias("run"), F.col("id").alias("epoch"), F.lit(0.0).alias("val_loss"))
    got = evaluate.early_stop_epoch(falls.unionByName(ends), 20, 1.0)
    # with a delta of one, every third epoch is an improvement: 0, 3, .., 999999
    assert tuple(got.first()) == ("a", 999_999 + 20, -999_999 * 0.4, 999_999)
    sizes = []
    summarise = evaluate._summary(20, 1.0, "run")
    import pyarrow as pa
    for bucket in range(3):
        e = list(range(bucket * 10_000, (bucket + 1) * 10_000))
        out = summarise(pa.table({"run": ["a"] * len(e), "bucket": [bucket] * len(e), "e": e, "l": [-x * 0.4 for x in e],
                                  "low": [-(e[0] - 1) * 0.4] * len(e)}))
        sizes.append(len(out["l"][0]))
    assert max(sizes) <= 4


def test_histogram_equals_numpy(spark):
    values = [float(v) for v in (0, 1, 1, 2, 5, 10, 10)]
    for data in (values, [3.0, 3.0]):
        df = spark.createDataFrame([(v,) for v in data], "x double")
        got = stats.histogram_density(df, "x", 20).orderBy("bin").collect()
        count, edges = np.histogram(data, bins=20)
        assert [r["bin_count"] for r in got] == count.tolist()
        assert [r["left_edge"] for r in got] == pytest.approx(edges[:-1].tolist())
        assert [r["density"] for r in got] == pytest.approx(np.histogram(data, bins=20, density=True)[0].tolist())


def test_ranges_and_stats_of_unknown_width(spark):
    df = spark.createDataFrame([([1.0, 5.0], [0.0], 1.0), ([3.0, -5.0], [2.0], 4.0)],
                               "observation array<double>, action array<double>, reward double")
    assert [tuple(r) for r in stats.dim_ranges(df, "observation").first()["ranges"]] == [(1.0, 3.0), (-5.0, 5.0)]
    narrow, wide = stats.normalization_stats(df, state_dim=2, action_dim=1).first(), stats.normalization_stats(df).first()
    assert narrow.asDict() == wide.asDict()
    assert narrow["state_mean"] == [2.0, 0.0] and narrow["reward_std"] == pytest.approx(math.sqrt(4.5) + 1e-8)
    uneven = df.union(df.withColumn("observation", F.array(F.lit(1.0))))
    assert episodes.infer_dims(uneven, {"d": "observation"}).first()["d"] is None
    with pytest.raises(Exception, match="rows differ in length"):
        episodes.infer_dims(uneven, {"d": "observation"}, strict=True).collect()


def test_unset_statistics_raise(spark):
    with pytest.raises(Exception, match="statistics have not been updated"):
        spark.range(1).select(policy.normalize(F.array(F.lit(2.0)), F.array(F.lit(0.0)), F.array(F.lit(1.0)))).collect()


def test_network_scoring(spark):
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=(3, 2)), rng.normal(size=3)
    gamma, beta, mean, var = (rng.uniform(0.5, 2, 3) for _ in range(4))
    fw, fb = scoring.fold_batch_norm(w, b, gamma, beta, mean, var)
    layers = [("out", 0, fw.tolist(), fb.tolist(), "relu")]
    net = scoring.load_network(spark.createDataFrame(layers, schemas.LAYER))
    df = spark.createDataFrame([(0, [1.0, -2.0]), (1, None), (2, [0.5, 0.5])], "i int, x array<double>")
    got = [r["y"] for r in df.select("i", scoring.score_mlp_policy(spark, net, F.col("x")).alias("y")).orderBy("i").collect()]
    for x, y in (([1.0, -2.0], got[0]), ([0.5, 0.5], got[2])):
        normed = ((w @ np.array(x) + b) - mean) / np.sqrt(var + 1e-5) * gamma + beta
        assert y == pytest.approx(np.maximum(normed, 0).tolist())
    assert got[1] is None
    with pytest.raises(Exception, match="Expected input dimension 2"):
        df.select(scoring.score_mlp_policy(spark, net, F.array(F.lit(1.0)))).collect()
    with pytest.raises(ValueError, match="Unsupported activation"):
        scoring.load_network(spark.createDataFrame([("out", 0, [[1.0]], [0.0], "swish")], schemas.LAYER))


def test_gaussian_policy_passes_actions_through(spark):
    net = scoring.Network({"body": [(np.eye(2), np.zeros(2), "id")], "mean": [(np.ones((3, 2)), np.zeros(3), "id")],
                           "log_std": [(np.zeros((3, 2)), np.zeros(3), "id")]})
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [7.0, 8.0, 9.0])], "i int, x array<double>")
    states = F.when(F.size("x") == 2, F.col("x"))
    scored = rows.select("i", "x", scoring.score_gaussian_policy(spark, net, states).alias("d"))
    got = [r["a"] for r in scored.select(scoring.policy_action(net, F.col("x"), F.col("d")).alias("a"), "i").orderBy("i").collect()]
    assert got == [[3.0, 3.0, 3.0], [7.0, 8.0, 9.0]]


def test_linear_fit_recovers_weights(spark):
    from episodica.operators import fits
    df = spark.range(2000).select(
        F.col("id").alias("prompt_id"), F.array(numbers.uniform(1, F.col("id")), numbers.uniform(2, F.col("id"))).alias("observation"),
        F.array(numbers.uniform(3, F.col("id"))).alias("action"))
    df = df.withColumn("reward", 2.0 * F.col("observation")[0] - F.col("observation")[1] + 3.0 * F.col("action")[0] + 1.0)
    split = fits.split_rows(df)
    exact = fits.fit_reward_regressor(split, "linear")
    assert exact.val_loss < 1e-12 and exact.model.weights[:, 0] == pytest.approx([1.0, 2.0, -1.0, 3.0], abs=1e-8)
    variance = split.agg(F.var_samp("reward")).first()[0]
    trees = fits.fit_reward_regressor(split, "gbt", maxIter=8)
    assert trees.val_loss < variance / 4 and trees.chosen == len(trees.history) == trees.model.stages[-1].getNumTrees
    wide = split.withColumn("action_disc", (F.col("observation")[0] > 0.5).cast("int"))
    for kind in ("logistic", "mlp"):
        assert fits.fit_bc_discrete(wide, 2, 2, kind).val_loss < 0.1
    several = fits.fit_bc_discrete(wide, 2, 2, penalties=(10.0, 0.0))
    assert several.chosen == min(several.history, key=lambda h: (h[2], h[0]))[0]


def test_all_outputs_are_fitted_in_one_scan(spark, monkeypatch):
    from episodica.operators import fits
    from episodica.session import ship_package
    ship_package(spark)
    r = np.random.default_rng(5)
    x, noise = r.normal(size=(500, 4)), r.normal(size=(500, 3)) / 10
    w = r.normal(size=(5, 3))
    y = np.c_[np.ones(500), x] @ w + noise
    rows = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y))],
                                 "prompt_id bigint, observation array<double>, action array<double>")
    split = fits.split_rows(rows.unionByName(rows.limit(1).select(F.lit(999).cast("bigint").alias("prompt_id"), F.lit(None).cast("array<double>").alias("observation"), "action")))
    calls, of = [], fits.grams
    monkeypatch.setattr(fits, "grams", lambda *a: calls.append(1) or of(*a))
    model, errors = fits.fit_bc_continuous(split, 3)
    assert len(calls) == 1 and model.weights.shape == (5, 3)
    train = {row["prompt_id"] for row in split.where("split = 'train'").collect()} - {999}
    chosen = np.array([k in train for k in range(500)])
    z = np.c_[np.ones(500), x]
    wanted = np.linalg.lstsq(z[chosen], y[chosen], rcond=None)[0]
    assert model.weights == pytest.approx(wanted, abs=1e-9)
    assert errors == pytest.approx(((z[~chosen] @ wanted - y[~chosen]) ** 2).mean(axis=0), rel=1e-6)
    predicted = {row["prompt_id"]: row["p"] for row in rows.select("prompt_id", model.predict(F.col("observation")).alias("p")).collect()}
    assert np.array([predicted[k] for k in range(500)]) == pytest.approx(z @ wanted, abs=1e-9)


@pytest.mark.parametrize("patience, min_delta", [(1, 0.0), (4, 0.0), (3, 0.01), (100, 0.0)])
def test_descent_is_stopped_by_the_validation_rows(spark, patience, min_delta):
    """Every prefix of the run is scored on the rows themselves."""
    from episodica.operators import fits
    from episodica.session import ship_package
    ship_package(spark)
    r = np.random.default_rng(1)
    x, y = r.normal(size=(60, 12)), r.normal(size=60)   # nothing to learn: validation gets worse at some point
    rows = spark.createDataFrame([(k, a[:8].tolist(), a[8:].tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y))],
                                 "prompt_id bigint, observation array<double>, action array<double>, reward double")
    split = fits.split_rows(rows, val_split=0.4)
    fit = fits.fit_reward_regressor(split, "descent", rate=0.2, epochs=40, patience=patience, min_delta=min_delta)
    val = np.array([k in {row["prompt_id"] for row in split.where("split = 'val'").collect()} for k in range(60)])
    z, w, losses = np.c_[np.ones(60), x], np.zeros(13), []
    for _ in range(40):
        w = w - 0.2 * z[~val].T @ (z[~val] @ w - y[~val]) / (~val).sum()
        losses.append(((z[val] @ w - y[val]) ** 2).mean())
    best, at, stop = math.inf, 0, 40
    for e, loss in enumerate(losses, 1):
        if loss < best - min_delta:
            best, at = loss, e
        elif e - at >= patience:
            stop = e
            break
    assert (fit.chosen, len(fit.history)) == (at, stop) and [h[2] for h in fit.history] == pytest.approx(losses[:stop], rel=1e-9)
    assert fit.val_loss == pytest.approx(best, rel=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4099])
def test_permuted_numbers_are_a_bijection(spark, n):
    for seed in (0, 42):
        got = [r["p"] for r in spark.range(n).select(sampling.permuted(F.col("id"), F.lit(n), seed).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        if n > 60:
            assert len({a - k for k, a in enumerate(got)}) > n / 4 and abs(np.corrcoef(range(n), got)[0, 1]) < 0.3


def test_splits_of_numbered_rows_are_exact_without_an_exchange(spark):
    rows = spark.range(1_003).withColumnRenamed("id", "k")
    test = sampling.train_test_split(rows, "k", 1, 0.25, number="k")
    assert test.where("split = 'test'").count() == 251
    assert sampling.train_val_split_exact(rows, "k", 1, 0.5, number="k").where("split = 'val'").count() == 502  # half to even
    batches = sampling.minibatches(rows, "k", 100, 1, number="k").groupBy("batch").count().collect()
    assert {(b["batch"], b["count"]) for b in batches} == {(k, 100) for k in range(10)}
    assert sampling.minibatches(rows, "k", 100, 1, drop_last=False, number="k").count() == 1_003
    plan = sampling.minibatches(rows, "k", 100, 1, number="k")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Sort" not in plan and plan.count("SinglePartition") <= 4  # of the count
    with pytest.raises(Exception, match="does not number"):
        sampling.train_test_split(rows.where("k <> 5"), "k", 1, number="k").collect()
    assert sampling.train_test_split(rows.limit(0), "k", 1, number="k").count() == 0


def test_advantages_in_the_row_equal_those_of_groups(spark):
    rewards = [[1.0, 2.0, 4.0], [3.0], [None, 1.0, 2.0], [5.0, 5.0], []]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(rewards)], "prompt_id int, r array<double>")
    packed = rows.select("prompt_id", F.transform("r", lambda x: F.struct(x.alias("reward"))).alias("draws"))
    flat = rows.select("prompt_id", F.posexplode("r").alias("gen_id", "reward"))
    for scaled in (True, False):
        a = groups.group_advantage_in_row(packed, scaled=scaled).collect()
        b = groups.group_advantage(flat, scaled=scaled).collect()
        key = lambda r: (r["prompt_id"], r["gen_id"])
        names = ("group_mean", "group_std", "advantage", "reward")
        assert [(key(r), [r[n] for n in names]) for r in sorted(a, key=key)] == [
            (key(r), [pytest.approx(r[n]) if r[n] is not None else None for n in names]) for r in sorted(b, key=key)]
    plan = groups.group_advantage_in_row(packed)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_statistics_inside_a_network(spark):
    r = np.random.default_rng(2)
    net = scoring.Network({"out": [(r.normal(size=(4, 3)), r.normal(size=4), "tanh"), (r.normal(size=(1, 4)), r.normal(size=1), "id")]})
    from pyspark.sql import Row
    fitted = Row(state_mean=[0.5, -1.0], state_std=[2.0, 0.25], action_mean=[3.0], action_std=[1.5], reward_mean=7.0, reward_std=2.5)
    x = r.normal(size=(20, 3))
    scaled = (x - [0.5, -1.0, 3.0]) / (np.array([2.0, 0.25, 1.5]) + 1e-8)
    assert scoring.with_statistics(net, fitted).run(x, ["out"])[0] == pytest.approx(net.run(scaled, ["out"])[0] * 2.5 + 7.0)
    with pytest.raises(ValueError, match="not been updated"):
        scoring.with_statistics(net, Row(state_mean=[0.0], state_std=[1.0], action_mean=[0.0], action_std=[1.0], reward_mean=1.0, reward_std=2.0))
    with pytest.raises(ValueError, match="linear end"):
        scoring.with_statistics(scoring.Network({"out": [net.heads["out"][0]]}), fitted)


def test_merged_moments_equal_those_of_the_whole(spark):
    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, (r.normal(size=3) * [1, 1e-3, 50] + [1e4, 0, -7]).tolist(), r.normal(size=2).tolist(), float(r.normal()))
                                  for k in range(400)], "k int, observation array<double>, action array<double>, reward double")
    parts = [rows.where(c) for c in ("k < 1", "k >= 1 AND k < 90", "k >= 90", "k < 0")]  # one row, and none
    merged = stats.merged_moments(stats.moments(parts[0], 3, 2).unionByName(stats.moments(parts[1], 3, 2)).unionByName(
        stats.moments(parts[2], 3, 2)).unionByName(stats.moments(parts[3], 3, 2)))
    got, wanted = stats.stats_of_moments(merged).first(), stats.normalization_stats(rows, state_dim=3, action_dim=2).first()
    for name in ("state_mean", "state_std", "action_mean", "action_std", "reward_mean", "reward_std"):
        assert got[name] == pytest.approx(wanted[name], rel=1e-9)
    one = stats.stats_of_moments(stats.merged_moments(stats.moments(parts[0], 3, 2))).first()
    assert one["reward_std"] is None and one["state_std"] == [None] * 3


def test_guards_flag_or_stop(spark):
    losses = spark.createDataFrame([(1.0,), (-10.0,), (None,)], "loss double")
    assert [r[0] for r in losses.select(policy.checked_loss(F.col("loss"))).collect()] == [1.0, -10.0, None]
    for bad in (math.nan, math.inf, 10.5):
        with pytest.raises(Exception, match="loss out of bounds"):
            spark.createDataFrame([(bad,)], "loss double").select(policy.checked_loss(F.col("loss"))).collect()


def test_returns_of_each_policy_and_of_all(spark):
    returns = spark.createDataFrame([(0, 1, 2.0, 1), (0, 2, 4.0, 3), (1, 3, 9.0, 5)], "policy int, episode_id int, episode_return double, episode_length int")
    got = {r["policy"]: (r["mean_return"], r["mean_length"], r["n_episodes"]) for r in evaluate.evaluation_summary(returns, ["policy"], overall=True).collect()}
    assert got == {0: (3.0, 2.0, 2), 1: (9.0, 5.0, 1), None: (5.0, 3.0, 3)}


def test_powers_are_exact_or_undecided():
    from episodica.functions.equation import arithmetic_value
    assert arithmetic_value("2**20000 // 2**19999") == 2.0 and arithmetic_value("2**-20000") == 0.0
    assert arithmetic_value("3**9999999") == math.inf and math.isnan(arithmetic_value("3**9999999 - 3**9999999"))
    assert arithmetic_value("1/0") is None


def test_vectors_of_different_length_raise(spark):
    from episodica.functions import vectors
    with pytest.raises(Exception, match="vectors differ in length"):
        spark.range(1).select(vectors.mse(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()


def test_sessions_close_once(spark, tmp_path):
    schema = "episode_id bigint, step bigint, reward double, done boolean, ts timestamp"

    def feed(rows, name):
        base = spark.createDataFrame([(e, s, r, d, m) for e, s, r, d, m in rows],
                                     "episode_id bigint, step bigint, reward double, done boolean, m int")
        ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 60)
        base.withColumn("ts", ts).drop("m").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        start_session_returns(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()

    feed([(1, 0, 1.0, False, 0), (1, 1, 2.0, True, 1), (1, 1, 2.0, True, 1), (2, 0, 5.0, False, 2)], "a")
    feed([(3, 0, 1.0, False, 500)], "b")          # moves the watermark past episodes 1 and 2
    feed([(1, 2, 100.0, False, 3), (3, 1, 1.0, False, 501)], "c")  # late step of a closed episode
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 3.0, 2, True), (2, 5.0, 1, False)]


PYTHON_QUERIES = {"reward_equation", "write_success_samples", "reward_model_continuous", "reward_model_tokenized",
                  "score_reward_model", "score_mlp_policy", "score_gaussian_policy", "score_categorical_policy",
                  "compare_checkpoints", "offline_policy_eval", "fit_reward_regressor", "fit_bc_continuous",
                  "fit_bc_discrete"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON_QUERIES))
def test_plans_stay_native_without_cross_joins(spark, name):
    if name.startswith(("read_", "write_", "stream_", "save_", "load_")):
        pytest.skip("runs jobs to build its input")
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


@pytest.mark.parametrize("name, scans", [("step_index", 0), ("episode_returns", 1), ("evaluation_summary", 1), ("sample_episodes", 2),
                                         ("random_sample_n", 1), ("eval_log_pairs", 4), ("action_dim_series", 0)])
def test_events_are_read_few_times(spark, name, scans):
    """Numbered events are read from the table that numbering wrote, after one scan of the log."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("event_id#") >= 0 and plan.count("Relation [event_id") <= scans


def test_advantage_evaluates_its_input_twice(spark):
    plan = groups.group_advantage(skewed(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 600") == 2  # rows and statistics
    assert plan.count("Exchange hashpartitioning(prompt_id") == 1  # partial statistics; the join exchanges null-safe keys



def test_minibatches_query_ranks_any_ids_by_their_hashes(spark, tmp_path):
    ids = [k * 7 + 1_000_003 for k in range(700)] + [1_000_003, 1_000_010]   # neither dense nor from 0, two of them twice
    rows = [(k, datetime.datetime(2024, 1, 1), k % 9, "view", 1.0) for k in ids]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    vectors = [(k, k % 10, [float(k)] * 64) for k in range(11)]
    spark.createDataFrame(vectors, "vec_id bigint, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    order = sorted(ids, key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
    got = QUERIES["minibatches"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((k, r // 64) for r, k in enumerate(order[:640]))
