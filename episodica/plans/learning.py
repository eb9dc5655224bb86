"""Batch scoring, checkpoints, policy comparison and MLlib fits."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import align, evaluate, fits, policies, scoring
from ..sources.tables import ACT_DIMS, OBS_DIMS, Inputs
from .data import fitted_stats
from .networks import (CATEGORICAL_POLICY, GAUSSIAN_POLICY, POLICY, POLICY_OTHER, REWARD_MODEL, forward_sql,
                       network_frame, normalized_sql)
from .registry import as_text, hash_key, hash_uniform, oracle, query, rnd, rounded, txt
from .rewards import mse_sql


def _network(i: Inputs, layers: list) -> scoring.Network:
    return scoring.load_network(network_frame(i.spark, layers))


@query("score_reward_model", oracle(f"""
    SELECT prompt_id, {rnd('y[1] * (SELECT reward_std FROM norm_stats) + (SELECT reward_mean FROM norm_stats)', 4)}
           AS score
    FROM {forward_sql(REWARD_MODEL, 'inputs', 'prompt_id', 'x')}""", "transitions", "norm_stats", more={
    "inputs": f"""SELECT prompt_id, list_concat({normalized_sql('observation', 'state_mean', 'state_std')},
                                                {normalized_sql('action', 'action_mean', 'action_std')}) AS x
                  FROM transitions"""}))
def score_reward_model(i: Inputs) -> DataFrame:
    score = scoring.score_reward_model(i.spark, _network(i, REWARD_MODEL), F.col("observation"), F.col("action"),
                                       fitted_stats(i).first())
    return i.transitions().select("prompt_id", rounded(score, 4).alias("score"))


@query("score_mlp_policy", oracle(f"""
    SELECT prompt_id, {txt('y')} AS action FROM {forward_sql(POLICY, 'transitions', 'prompt_id', 'observation')}""",
    "transitions"))
def score_mlp_policy(i: Inputs) -> DataFrame:
    action = scoring.score_mlp_policy(i.spark, _network(i, POLICY), F.col("observation"))
    return i.transitions().select("prompt_id", as_text(action).alias("action"))


_BODY = forward_sql(GAUSSIAN_POLICY[:2], "transitions", "prompt_id", "observation", "body")


@query("score_gaussian_policy", oracle(f"""
    SELECT m.prompt_id, {txt('m.y')} AS mean, {txt('list_transform(s.y, lambda x: exp(x))')} AS std
    FROM {forward_sql(GAUSSIAN_POLICY[2:3], 'body', 'prompt_id', 'body')} m
    JOIN {forward_sql(GAUSSIAN_POLICY[3:], 'body', 'prompt_id', 'body')} s USING (prompt_id)""",
    "transitions", more={"body": f"SELECT * FROM {_BODY}"}))
def score_gaussian_policy(i: Inputs) -> DataFrame:
    net = _network(i, GAUSSIAN_POLICY)
    rows = i.transitions().select("prompt_id", scoring.score_gaussian_policy(
        i.spark, net, F.col("observation")).alias("d"))
    return rows.select("prompt_id", as_text("d.mean").alias("mean"), as_text("d.std").alias("std"))


_CATEGORICAL = forward_sql(
    CATEGORICAL_POLICY[1:], forward_sql(CATEGORICAL_POLICY[:1], "transitions", "prompt_id", "observation", "body"),
    "prompt_id", "body")


@query("score_categorical_policy", oracle(f"""
    SELECT prompt_id, {txt('y')} AS logits, CASE WHEN y[1] >= y[2] THEN 0 ELSE 1 END AS action
    FROM {_CATEGORICAL}""", "transitions"))
def score_categorical_policy(i: Inputs) -> DataFrame:
    logits = scoring.score_mlp_policy(i.spark, _network(i, CATEGORICAL_POLICY), F.col("observation"), "logits")
    rows = i.transitions().select("prompt_id", logits.alias("l"))
    return rows.select("prompt_id", as_text("l").alias("logits"), vectors.argmax(F.col("l")).alias("action"))


@query("compare_checkpoints", oracle(f"""
    SELECT a.prompt_id, {rnd('a.y[1]', 5)} AS early, {rnd('b.y[1]', 5)} AS late,
           {rnd('least(a.y[1], b.y[1])', 5)} AS lowest, {rnd('greatest(a.y[1], b.y[1])', 5)} AS highest
    FROM {forward_sql(POLICY, 'transitions', 'prompt_id', 'observation')} a
    JOIN {forward_sql(POLICY_OTHER, 'transitions', 'prompt_id', 'observation')} b USING (prompt_id)""", "transitions"))
def compare_checkpoints(i: Inputs) -> DataFrame:
    def score(layers: list) -> Column:
        return scoring.score_mlp_policy(i.spark, _network(i, layers), F.col("observation"))[0]
    rows = align.compare_checkpoints(i.transitions(), {"early": score(POLICY), "late": score(POLICY_OTHER)}, "prompt_id")
    return rows.select("prompt_id", *[rounded(c, 5).alias(c) for c in ("early", "late", "lowest", "highest")])


_RANDOM_SQL = "[" + ", ".join(f"-1::DOUBLE + {hash_uniform(34, 'prompt_id', str(d))} * 2" for d in range(ACT_DIMS)) + "]"


@query("offline_policy_eval", oracle(f"""
    SELECT policy, {rnd('avg(e)', 5)} AS mse, {rnd('avg(wrong)', 5)} AS zero_one_loss,
           {rnd('sum(reward)', 2)} AS total_reward, count(*) AS n_steps
    FROM (SELECT 'mlp' AS policy, {mse_sql('m.y', 'action')} AS e,
                 CASE WHEN action_disc = CASE WHEN c.y[1] >= c.y[2] THEN 0 ELSE 1 END THEN 0::DOUBLE ELSE 1::DOUBLE END AS wrong, reward
          FROM {forward_sql(POLICY, 'transitions', 'prompt_id, action, action_disc, reward', 'observation')} m
          JOIN {_CATEGORICAL} c USING (prompt_id)
          UNION ALL SELECT 'constant', {mse_sql('[' + ', '.join(['0::DOUBLE'] * ACT_DIMS) + ']', 'action')},
                 CASE WHEN action_disc = 0 THEN 0::DOUBLE ELSE 1::DOUBLE END, reward FROM transitions
          UNION ALL SELECT 'random', {mse_sql(_RANDOM_SQL, 'action')},
                 CASE WHEN action_disc = floor({hash_uniform(35, 'prompt_id')} * 2) THEN 0::DOUBLE ELSE 1::DOUBLE END, reward
          FROM transitions) GROUP BY policy""", "transitions"))
def offline_policy_eval(i: Inputs) -> DataFrame:
    def against_log(action: Column, choice: Column) -> Column:
        return F.struct(vectors.mse(action, F.col("action")).alias("squared_error"),
                        F.when(choice == F.col("action_disc"), 0.0).otherwise(1.0).alias("wrong"))
    state, zero = F.col("prompt_id"), F.lit(0)
    scored = i.transitions().withColumns({
        "y": scoring.score_mlp_policy(i.spark, _network(i, POLICY), F.col("observation")),
        "logits": scoring.score_mlp_policy(i.spark, _network(i, CATEGORICAL_POLICY), F.col("observation"), "logits")})
    report = evaluate.offline_policy_eval(scored, {
        "mlp": against_log(F.col("y"), vectors.argmax(F.col("logits"))),
        "constant": against_log(policies.constant_action(ACT_DIMS), zero),
        "random": against_log(policies.random_action(state, [(-1.0, 1.0)] * ACT_DIMS, 34),
                              policies.random_discrete_action(state, 2, 35))})
    return report.select("policy", rounded("mse", 5).alias("mse"), rounded("zero_one_loss", 5).alias("zero_one_loss"),
                         rounded("total_reward", 2).alias("total_reward"), "n_steps")


# A least-squares or logistic fit is the one whose residuals are orthogonal to every feature on the training rows.
_SPLIT = {"split": f"""
    SELECT *, CASE WHEN row_number() OVER (ORDER BY {hash_key(42, 'prompt_id')}, prompt_id)
                        <= round_even(count(*) OVER () * 0.1::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM transitions"""}


def _moments_sql(labels: list[str], features: int) -> str:
    zero = " UNION ALL ".join(f"SELECT '{label}/' || j AS name, 0::DOUBLE AS value FROM range({features + 1}) t(j)" for label in labels)
    return oracle(f"{zero} UNION ALL SELECT 'rows/' || split, count(*)::DOUBLE FROM split GROUP BY split", "transitions", more=_SPLIT)


def _moments(split: DataFrame, rows: DataFrame, residuals: dict[str, Column], features: Column, dim: int, digits: int) -> DataFrame:
    """Mean residual (feature 0) and mean residual times each feature on the training rows, and the rows of each part."""
    out = split.groupBy(F.concat(F.lit("rows/"), "split").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    x = F.concat(F.array(F.lit(1.0)), features)
    terms = rows.where("split = 'train'").select(x.alias("x"), *[r.alias(f"r_{label}") for label, r in residuals.items()])
    means = terms.agg(*[rounded(F.avg(F.col(f"r_{label}") * F.get("x", F.lit(j))), digits).alias(f"{label}/{j}")
                        for label in residuals for j in range(dim + 1)])
    return out.unionByName(means.unpivot([], means.columns, "name", "value"))


#: Steps of the reward regressor: their size, how many at most, and how many without a better validation loss end the run.
RATE, EPOCHS, PATIENCE = 1.0, 60, 5
_WIDTH = OBS_DIMS + ACT_DIMS + 1
_dot = "list_dot_product({}, {})".format
_STEPPED = f"list_transform(range(1, {_WIDTH + 1}), lambda i: w.w[i] - {RATE}::DOUBLE * (list_dot_product(t.g[i], w.w) - t.c[i]))"


def _loss_sql(part: str) -> str:
    fitted = _dot(f"list_transform(range(1, {_WIDTH + 1}), lambda i: list_dot_product({part}.g[i], x.w))", "x.w")
    return f"({part}.yy - 2 * {_dot(f'{part}.c', 'x.w')} + {fitted})"


_DESCENT = {**_SPLIT,
    "z": "SELECT split, list_concat([1::DOUBLE], observation, action, [reward]) AS z FROM split",
    "products": f"""SELECT split, i, j, sum(z[i] * z[j]) / count(*) AS v, count(*) AS n
                    FROM z, range(1, {_WIDTH + 2}) a(i), range(1, {_WIDTH + 2}) b(j) GROUP BY split, i, j""",
    "lines": "SELECT split, i, list(v ORDER BY j) AS r, any_value(n) AS n FROM products GROUP BY split, i",
    "grams": f"""SELECT split, any_value(n) AS n, list(r[1:{_WIDTH}] ORDER BY i) FILTER (i <= {_WIDTH}) AS g,
                        any_value(r[1:{_WIDTH}]) FILTER (i > {_WIDTH}) AS c, any_value(r[{_WIDTH + 1}]) FILTER (i > {_WIDTH}) AS yy
                 FROM lines GROUP BY split""",
    "walk": f"""SELECT 0 AS e, list_transform(range({_WIDTH}), lambda i: 0::DOUBLE) AS w, 'infinity'::DOUBLE AS best, 0 AS since,
                       0::DOUBLE AS train, 'infinity'::DOUBLE AS val
                UNION ALL
                SELECT e, w, least(best, val), CASE WHEN val < best THEN 0 ELSE since + 1 END, train, val
                FROM (SELECT x.e, x.w, x.best, x.since, {_loss_sql('t')} AS train, {_loss_sql('v')} AS val
                      FROM (SELECT w.e + 1 AS e, {_STEPPED} AS w, w.best, w.since FROM walk w, (SELECT * FROM grams WHERE split = 'train') t
                            WHERE w.since < {PATIENCE} AND w.e < {EPOCHS}) x,
                           (SELECT * FROM grams WHERE split = 'train') t, (SELECT * FROM grams WHERE split = 'val') v)""",
    "ran": "SELECT * FROM walk WHERE e > 0",
    "chosen": "SELECT * FROM ran ORDER BY val, e LIMIT 1"}


@query("fit_reward_regressor", oracle(f"""
    SELECT 'chosen_epoch' AS name, e::DOUBLE AS value FROM chosen
    UNION ALL SELECT 'val_loss', {rnd('val', 4)} FROM chosen UNION ALL SELECT 'train_loss', {rnd('train', 4)} FROM chosen
    UNION ALL SELECT 'epochs_run', max(e)::DOUBLE FROM ran
    UNION ALL SELECT 'val_loss/' || e, {rnd('val', 4)} FROM ran
    UNION ALL SELECT 'rows/' || split, n::DOUBLE FROM grams""", "transitions", more=_DESCENT).replace("WITH ", "WITH RECURSIVE ", 1))
def fit_reward_regressor(i: Inputs) -> DataFrame:
    """The chosen epoch, its losses, the validation loss of every epoch that was run, and the rows of each part.

    The losses of the chosen epoch are those of its predictions on the rows.
    """
    split = fits.split_rows(i.transitions())
    fit = fits.fit_reward_regressor(split, "descent", rate=RATE, epochs=EPOCHS, patience=PATIENCE)
    error = F.get(fit.model.predict(F.concat("observation", "action")), F.lit(0)) - F.col("reward")
    scored = split.groupBy("split").agg(F.avg(error * error).alias("loss"), F.count(F.lit(1)).cast("double").alias("rows"))
    by_part = scored.select(F.explode(F.create_map(F.concat("split", F.lit("_loss")), rounded("loss", 4), F.concat(F.lit("rows/"), "split"),
                                                   F.col("rows"))).alias("name", "value"))
    chosen = [("chosen_epoch", float(fit.chosen)), ("epochs_run", float(len(fit.history)))]
    losses = [(f"val_loss/{e}", round(v, 4) + 0.0) for e, _, v in fit.history]
    return by_part.unionByName(i.spark.createDataFrame(chosen + losses, "name string, value double"))


@query("fit_bc_continuous", _moments_sql([f"action_{d}" for d in range(ACT_DIMS)], OBS_DIMS))
def fit_bc_continuous(i: Inputs) -> DataFrame:
    split = fits.split_rows(i.transitions())
    model, _ = fits.fit_bc_continuous(split, ACT_DIMS)
    rows = split.withColumn("predicted", model.predict(F.col("observation")))
    residuals = {f"action_{d}": F.get("predicted", F.lit(d)) - F.get("action", F.lit(d)) for d in range(ACT_DIMS)}
    return _moments(split, rows, residuals, F.col("observation"), OBS_DIMS, 6)


@query("fit_bc_discrete", _moments_sql(["action"], OBS_DIMS))
def fit_bc_discrete(i: Inputs) -> DataFrame:
    split = fits.split_rows(i.transitions())
    model = fits.fit_bc_discrete(split, 2, OBS_DIMS).model
    rows = model.transform(split.withColumn("raw", fits.features(F.col("observation"))))
    residual = F.get(vector_to_array("probability"), F.lit(1)) - F.col("action_disc")
    return _moments(split, rows, {"action": residual}, F.col("observation"), OBS_DIMS, 4)
