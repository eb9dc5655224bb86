"""Policy mathematics, draws, gradients and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import policy, vectors
from ..operators import evaluate, gradients, groups, policies, stats
from ..sources.tables import ACT_DIMS, Inputs
from .data import with_stats
from .networks import normalized_sql
from .registry import as_text, hash_normal, hash_uniform, oracle, query, rnd, rounded, txt
from .rewards import mse_sql

_STD = "list_transform(log_std, lambda x: exp(x))"
_REF_STD = "list_transform(ref_log_std, lambda x: exp(x))"


def log_prob_sql(action: str, mean: str, std: str, reduce: str = "sum") -> str:
    return (f"list_{'sum' if reduce == 'sum' else 'avg'}(list_transform(list_zip({action}, {mean}, {std}), lambda p: "
            "-0.5::DOUBLE * ((p[1] - p[2]) / p[3]) * ((p[1] - p[2]) / p[3]) - ln(p[3]) - 0.5::DOUBLE * ln(2 * pi())))")


KL_SQL = (f"list_sum(list_transform(list_zip(mean, {_STD}, ref_mean, {_REF_STD}), lambda p: ln(p[4] / p[2]) + "
          "(p[2] * p[2] + (p[1] - p[3]) * (p[1] - p[3])) / (2 * p[4] * p[4]) - 0.5::DOUBLE))")


def _outputs(i: Inputs) -> DataFrame:
    return i.policy_outputs().withColumns({
        "std": F.transform("log_std", lambda x: F.exp(x)), "ref_std": F.transform("ref_log_std", lambda x: F.exp(x))})


@query("normalize_state_action", oracle(f"""
    SELECT prompt_id, {txt(normalized_sql('observation', 'state_mean', 'state_std'), 4)} AS state,
           {txt(normalized_sql('action', 'action_mean', 'action_std'), 4)} AS action FROM transitions""",
    "transitions", "norm_stats"))
def normalize_state_action(i: Inputs) -> DataFrame:
    rows = with_stats(i, i.transitions())
    return rows.select(
        "prompt_id",
        as_text(policy.normalize(F.col("observation"), F.col("stats.state_mean"), F.col("stats.state_std")), 4).alias("state"),
        as_text(policy.normalize(F.col("action"), F.col("stats.action_mean"), F.col("stats.action_std")), 4).alias("action"))


@query("denormalize_reward", oracle(f"""
    SELECT prompt_id, {rnd('mean[1] * (SELECT reward_std FROM norm_stats) + (SELECT reward_mean FROM norm_stats)', 4)}
           AS reward FROM policy_outputs""", "policy_outputs", "norm_stats"))
def denormalize_reward(i: Inputs) -> DataFrame:
    rows = with_stats(i, i.policy_outputs())
    scaled = policy.denormalize_reward(F.col("mean")[0], F.col("stats.reward_mean"), F.col("stats.reward_std"))
    return rows.select("prompt_id", rounded(scaled, 4).alias("reward"))


@query("gaussian_log_prob", oracle(f"""
    SELECT prompt_id, {rnd(log_prob_sql('action', 'mean', _STD))} AS log_prob_sum,
           {rnd(log_prob_sql('action', 'mean', _STD, 'mean'))} AS log_prob_mean FROM policy_outputs""",
    "policy_outputs"))
def gaussian_log_prob(i: Inputs) -> DataFrame:
    args = F.col("action"), F.col("mean"), F.col("std")
    return _outputs(i).select("prompt_id", rounded(policy.gaussian_log_prob(*args)).alias("log_prob_sum"),
                              rounded(policy.gaussian_log_prob(*args, reduce="mean")).alias("log_prob_mean"))


@query("gaussian_kl", oracle(f"SELECT prompt_id, {rnd(KL_SQL)} AS kl FROM policy_outputs", "policy_outputs"))
def gaussian_kl(i: Inputs) -> DataFrame:
    kl = policy.gaussian_kl(F.col("mean"), F.col("std"), F.col("ref_mean"), F.col("ref_std"))
    return _outputs(i).select("prompt_id", rounded(kl).alias("kl"))


@query("gaussian_nll", oracle(f"""
    SELECT {rnd('-avg(' + log_prob_sql('action', 'mean', _STD, 'mean') + ')')} AS loss FROM policy_outputs""",
    "policy_outputs"))
def gaussian_nll(i: Inputs) -> DataFrame:
    log_prob = policy.gaussian_log_prob(F.col("action"), F.col("mean"), F.col("std"), reduce="mean")
    return _outputs(i).agg(rounded(-F.avg(log_prob)).alias("loss"))


@query("categorical_nll", oracle(f"""
    SELECT {rnd('-avg(logits[action_disc + 1] - (m + ln(exp(logits[1] - m) + exp(logits[2] - m))))')} AS loss
    FROM (SELECT *, greatest(logits[1], logits[2]) AS m FROM policy_outputs)""", "policy_outputs"))
def categorical_nll(i: Inputs) -> DataFrame:
    return i.policy_outputs().agg(
        rounded(-F.avg(policy.log_softmax_at(F.col("logits"), F.col("action_disc")))).alias("loss"))


def _noise_sql(seed: int, *ids: str) -> str:
    return "[" + ", ".join(hash_normal(seed, *ids, str(d)) for d in range(ACT_DIMS)) + "]"


_SAMPLED_SQL = f"""
    SELECT prompt_id, g.i AS gen_id, mean, {_STD} AS std, action,
           list_transform(list_zip(mean, {_STD}, {_noise_sql(31, 'prompt_id', 'g.i')}),
                          lambda p: p[1] + p[2] * p[3]) AS sampled
    FROM policy_outputs, (SELECT unnest([0, 1, 2, 3]) AS i) g"""


def _sampled(i: Inputs) -> DataFrame:
    return policies.sample_gaussian_actions(_outputs(i), 4, seed=31)


@query("sample_gaussian_actions", oracle(f"""
    SELECT prompt_id, gen_id, {txt('sampled', 4)} AS action FROM ({_SAMPLED_SQL})""", "policy_outputs"))
def sample_gaussian_actions(i: Inputs) -> DataFrame:
    return _sampled(i).select("prompt_id", "gen_id", as_text("sampled", 4).alias("action"))


_DRAWN = {
    "drawn": f"""SELECT s.*, o.kl, -({mse_sql('sampled', 'action')}) AS reward,
                        {log_prob_sql('sampled', 'mean', 'std', 'mean')} AS lp
                 FROM ({_SAMPLED_SQL}) s JOIN (SELECT prompt_id, {KL_SQL} AS kl FROM policy_outputs) o USING (prompt_id)""",
    "adv": """SELECT *, stddev_samp(reward) OVER w AS group_std,
                     (reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-4) AS advantage
              FROM drawn WINDOW w AS (PARTITION BY prompt_id)"""}


def _drawn(i: Inputs) -> DataFrame:
    """Sampled actions with reward, log-probability and divergence, and their advantages, all from the prompt's row."""
    mean, std = F.col("mean"), F.col("std")
    prompts = _outputs(i).select("prompt_id", "action", "mean", "std", policies.gaussian_draws(F.col("prompt_id"), mean, std, 4, 31).alias("sampled"),
                                 policy.gaussian_kl(mean, std, F.col("ref_mean"), F.col("ref_std")).alias("kl"))
    scored = prompts.select("prompt_id", "kl", F.transform("sampled", lambda x: F.struct(
        F.size(x).alias("action_dim"), (-vectors.mse(x, F.col("action"))).alias("reward"),
        policy.gaussian_log_prob(x, mean, std, reduce="mean").alias("log_prob"))).alias("draws"))
    return groups.group_advantage_in_row(scored)


@query("reward_report", oracle(f"""
    SELECT metric, {rnd('v', 4)} AS value FROM (
      SELECT 'rewards/bc' AS metric, avg(reward) AS v FROM adv
      UNION ALL SELECT 'reward', avg(reward) FROM adv UNION ALL SELECT 'reward_std', avg(group_std) FROM adv
      UNION ALL SELECT 'advantage', avg(advantage) FROM adv UNION ALL SELECT 'ratio', avg(exp(lp)) FROM adv
      UNION ALL SELECT 'kl', avg(kl) FROM adv UNION ALL SELECT 'action_dim', avg(len(sampled)) FROM adv)""",
    "policy_outputs", more=_DRAWN))
def reward_report(i: Inputs) -> DataFrame:
    rows = _drawn(i).withColumns({"reward_bc": F.col("reward"), "ratio": F.exp("log_prob")})
    report = evaluate.reward_report(rows, ["reward_bc"], ["advantage", "ratio", "kl", "action_dim"])
    return report.select("metric", rounded("value", 4).alias("value"))


@query("clipped_surrogate", oracle(f"""
    SELECT prompt_id, gen_id, {rnd('advantage', 4)} AS advantage, {rnd('lp', 5)} AS log_prob,
           {rnd('-advantage * least(greatest(exp(lp), 0.8::DOUBLE), 1.2::DOUBLE)', 4)} AS loss,
           {rnd('kl', 5)} AS kl FROM adv""", "policy_outputs", more=_DRAWN))
def clipped_surrogate(i: Inputs) -> DataFrame:
    rows = _drawn(i)
    loss = policy.clipped_surrogate(F.col("advantage"), F.col("log_prob"))
    return rows.select("prompt_id", "gen_id", rounded("advantage", 4).alias("advantage"),
                       rounded("log_prob", 5).alias("log_prob"), rounded(loss, 4).alias("loss"),
                       rounded("kl", 5).alias("kl"))


@query("sample_categorical_actions", oracle(f"""
    SELECT prompt_id, g.i AS gen_id,
           CASE WHEN {hash_uniform(32, 'prompt_id', 'g.i')} <= exp(logits[1] - m) / (exp(logits[1] - m) + exp(logits[2] - m))
                THEN 0 ELSE 1 END AS action
    FROM (SELECT *, greatest(logits[1], logits[2]) AS m FROM policy_outputs), (SELECT unnest([0, 1, 2, 3]) AS i) g""",
    "policy_outputs"))
def sample_categorical_actions(i: Inputs) -> DataFrame:
    drawn = policies.sample_categorical_actions(i.policy_outputs(), 4, seed=32)
    return drawn.select("prompt_id", "gen_id", F.col("sampled").alias("action"))


@query("add_exploration_noise", oracle(f"""
    SELECT prompt_id, {txt("list_transform(list_zip(mean, " + _noise_sql(33, 'prompt_id')
                          + "), lambda p: p[1] + 0.1::DOUBLE * p[2])", 4)} AS action FROM policy_outputs""",
    "policy_outputs"))
def add_exploration_noise(i: Inputs) -> DataFrame:
    noisy = policies.add_exploration_noise(F.col("mean"), F.col("prompt_id"), seed=33)
    return i.policy_outputs().select("prompt_id", as_text(noisy, 4).alias("action"))


@query("baseline_policies", oracle(f"""
    SELECT prompt_id, '{','.join(['0.00000'] * ACT_DIMS)}' AS constant_action,
           {txt('[' + ', '.join(f"-1::DOUBLE + {hash_uniform(34, 'prompt_id', str(d))} * 2" for d in range(ACT_DIMS)) + ']')}
             AS random_action, floor({hash_uniform(35, 'prompt_id')} * 2)::INTEGER AS random_discrete
    FROM transitions""", "transitions"))
def baseline_policies(i: Inputs) -> DataFrame:
    state = F.col("prompt_id")
    return i.transitions().select(
        "prompt_id", as_text(policies.constant_action(ACT_DIMS)).alias("constant_action"),
        as_text(policies.random_action(state, [(-1.0, 1.0)] * ACT_DIMS, 34)).alias("random_action"),
        policies.random_discrete_action(state, 2, 35).alias("random_discrete"))


@query("gaussian_pdf_grid", oracle(f"""
    SELECT model, dim, point, {rnd('x', 5)} AS x,
           {rnd('exp(-0.5::DOUBLE * ((x - m) / s) * ((x - m) / s)) / (s * sqrt(2 * pi()))', 5)} AS pdf
    FROM (SELECT model, pos - 1 AS dim, p.point, m, s, m - 3 * s + p.point * (6 * s / 99) AS x
          FROM (SELECT action_disc AS model, pos, avg(x) AS m, stddev_samp(x) + 1e-8::DOUBLE AS s
                FROM (SELECT action_disc, unnest(action) AS x, generate_subscripts(action, 1) AS pos FROM transitions)
                GROUP BY 1, 2), (SELECT unnest(range(100)) AS point) p)""", "transitions"))
def gaussian_pdf_grid(i: Inputs) -> DataFrame:
    dims = [F.get("action", F.lit(d)) for d in range(ACT_DIMS)]
    fitted = i.transitions().groupBy(F.col("action_disc").alias("model")).agg(
        F.array(*[F.avg(x) for x in dims]).alias("mean"), F.array(*[F.stddev_samp(x) + 1e-8 for x in dims]).alias("std"))
    grid = policies.gaussian_pdf_grid(fitted, ["model"])
    return grid.select("model", F.col("dim").cast("bigint").alias("dim"), F.col("point").cast("bigint").alias("point"),
                       rounded("x", 5).alias("x"), rounded("pdf", 5).alias("pdf"))


# --- gradients ------------------------------------------------------------------------------

def _pair_sql(seed: int, n: str) -> str:
    """n noise pairs of a row as a list of 2-lists."""
    a, b = hash_normal(seed, "prompt_id", "i", fn="cos"), hash_normal(seed, "prompt_id", "i", fn="sin")
    return f"list_transform(range({n}), lambda i: [{a}, {b}])"


def _uniform_pair_sql(seed: int, n: int) -> str:
    a, b = hash_uniform(seed, "prompt_id", "i"), hash_uniform(seed, "prompt_id", "i", start=9)
    return f"list_transform(range({n}), lambda i: [{a}, {b}])"


@query("sample_cloud", oracle(f"""
    SELECT prompt_id, kind, repeat, pos - 1 AS point, {rnd('p[1] * cos(f) - p[2] * sin(f)', 5)} AS x,
           {rnd('p[1] * sin(f) + p[2] * cos(f)', 5)} AS y
    FROM (SELECT prompt_id, kind, repeat, f, unnest(points) AS p, generate_subscripts(points, 1) AS pos FROM (
      SELECT prompt_id, 'gaussian' AS kind, repeat, f, list_transform(z, lambda q: [c[1] + 0.3::DOUBLE * q[1], c[2] + 0.3::DOUBLE * q[2]]) AS points FROM base
      UNION ALL SELECT prompt_id, 'uniform', repeat, f, list_transform(u, lambda q: [c[1] + (2 * q[1] - 1) * 0.6::DOUBLE, c[2] + (2 * q[2] - 1) * 0.6::DOUBLE]) FROM base
      UNION ALL SELECT prompt_id, 'mixture', repeat, f, list_transform(z, lambda q, i: [
        c[1] + CASE WHEN i <= 2 THEN 0.2::DOUBLE ELSE -0.2::DOUBLE END + 0.3::DOUBLE * q[1],
        c[2] + CASE WHEN i <= 2 THEN 0.2::DOUBLE ELSE -0.2::DOUBLE END + 0.3::DOUBLE * q[2]]) FROM base))""",
    "transitions", more={"base": " UNION ALL ".join(f"""
    SELECT prompt_id, {k} AS repeat, observation AS c, step * 0.05::DOUBLE AS f, {_pair_sql(36 + 1000 * k, '5')} AS z,
           {_uniform_pair_sql(36 + 1000 * k, 5)} AS u
    FROM transitions""" for k in range(2))}))
def sample_cloud(i: Inputs) -> DataFrame:
    steps = i.steps().select("prompt_id", "step", "observation")
    clouds = policies.sample_clouds(steps, "observation", 5, 0.3, ("gaussian", "uniform", "mixture"), "prompt_id", 36, repeats=2, frame="step")
    rows = clouds.select("prompt_id", "kind", "repeat", F.posexplode("points").alias("point", "p"))
    return rows.select("prompt_id", "kind", "repeat", F.col("point").cast("bigint").alias("point"),
                       rounded(F.col("p")[0], 5).alias("x"), rounded(F.col("p")[1], 5).alias("y"))


def compare_sql(source: str, keep: str, scale: str, weight_eps: str, angle_eps: str) -> str:
    """Angle and magnitudes over rows with p, t (2-lists) and s (list of 2-lists)."""
    inner = "(gm1 * gg1 + gm2 * gg2)"
    cosine = f"least(greatest({inner} / (m * g + {angle_eps}), -1::DOUBLE), 1::DOUBLE)"
    angle = f"degrees(acos({cosine}))"
    if angle_eps == "0":
        angle = f"CASE WHEN m > 0 AND g > 0 THEN {angle} ELSE 0::DOUBLE END"
    return f"""
    SELECT {keep}, m AS mse_magnitude, g AS grpo_magnitude, {angle} AS angle_diff,
           CASE WHEN m > 0 THEN g / m ELSE 0::DOUBLE END AS magnitude_ratio
    FROM (SELECT *, sqrt(gm1 * gm1 + gm2 * gm2) AS m, sqrt(gg1 * gg1 + gg2 * gg2) AS g
          FROM (SELECT {keep}, t[1] - p[1] AS gm1, t[2] - p[2] AS gm2,
                       list_dot_product(w, list_transform(s, lambda q: q[1] - p[1])) / d AS gg1,
                       list_dot_product(w, list_transform(s, lambda q: q[2] - p[2])) / d AS gg2
                FROM (SELECT *, list_sum(w) + {weight_eps} AS d
                      FROM (SELECT *, list_transform(s, lambda q: exp({scale} * -((q[1] - t[1]) * (q[1] - t[1])
                                          + (q[2] - t[2]) * (q[2] - t[2])))) AS w FROM {source}))))"""


_STEP_CLOUD = {"clouds": f"""
    SELECT prompt_id, observation[1:2] AS p, action[1:2] AS t,
           list_transform({_pair_sql(37, '10')}, lambda z: [observation[1] + z[1] * 0.3::DOUBLE,
                                                            observation[2] + z[2] * 0.3::DOUBLE]) AS s
    FROM transitions"""}


def _compared(i: Inputs) -> DataFrame:
    rows = i.transitions().select(
        "prompt_id", F.slice("observation", 1, 2).alias("p"), F.slice("action", 1, 2).alias("t"),
        policies.sample_cloud(F.col("observation"), 10, 0.3, "gaussian", F.col("prompt_id"), 37).alias("s"))
    return gradients.gradient_compare(rows, "p", "t", "s", 2.0)


_COMPARED = {**_STEP_CLOUD, "compared": compare_sql("clouds", "prompt_id", "2", "0", "1e-8")}


@query("gradient_compare", oracle(f"""
    SELECT prompt_id, {rnd('mse_magnitude', 5)} AS mse_magnitude, {rnd('grpo_magnitude', 5)} AS grpo_magnitude,
           {rnd('angle_diff', 3)} AS angle_diff, {rnd('magnitude_ratio', 4)} AS magnitude_ratio FROM compared""",
    "transitions", more=_COMPARED))
def gradient_compare(i: Inputs) -> DataFrame:
    return _compared(i).select("prompt_id", rounded("mse_magnitude", 5).alias("mse_magnitude"),
                               rounded("grpo_magnitude", 5).alias("grpo_magnitude"),
                               rounded("angle_diff", 3).alias("angle_diff"),
                               rounded("magnitude_ratio", 4).alias("magnitude_ratio"))


_SERIES = ("avg_mse_magnitude", "avg_grpo_magnitude", "avg_angle_diff", "std_angle_diff", "max_angle_diff")


@query("gradient_series_stats", oracle(f"""
    SELECT {rnd('avg(mse_magnitude)', 4)} AS avg_mse_magnitude, {rnd('avg(grpo_magnitude)', 4)} AS avg_grpo_magnitude,
           {rnd('avg(angle_diff)', 4)} AS avg_angle_diff, {rnd('stddev_pop(angle_diff)', 4)} AS std_angle_diff,
           {rnd('max(angle_diff)', 4)} AS max_angle_diff FROM compared""", "transitions", more=_COMPARED))
def gradient_series_stats(i: Inputs) -> DataFrame:
    return gradients.gradient_series_stats(_compared(i)).select(*[rounded(c, 4).alias(c) for c in _SERIES])


# Every logged transition is a step of every cell of the whole grid.
GRID = {"n_samples": gradients.SWEEP_SAMPLES, "sigmas": gradients.SWEEP_SIGMAS, "reward_scales": gradients.SWEEP_REWARD_SCALES}
_CELLS = {"noise": f"SELECT observation[1:2] AS p, action[1:2] AS t, {_pair_sql(38, '20')} AS z FROM transitions",
          "expanded": f"""
    SELECT n_samples, sigma, reward_scale, p, t,
           list_transform(z[1:n_samples], lambda q: [p[1] + q[1] * sigma, p[2] + q[2] * sigma]) AS s
    FROM noise, (SELECT unnest({GRID['n_samples']}) AS n_samples), (SELECT unnest({GRID['sigmas']})::DOUBLE AS sigma),
         (SELECT unnest({GRID['reward_scales']})::DOUBLE AS reward_scale)""",
          "compared": compare_sql("expanded", "n_samples, sigma, reward_scale", "reward_scale", "1e-8", "0"),
          "cells": """
    SELECT n_samples, sigma, reward_scale, avg(angle_diff) AS avg_angle_diff, stddev_pop(angle_diff) AS std_angle_diff,
           avg(magnitude_ratio) AS avg_magnitude_ratio
    FROM compared WHERE mse_magnitude > 0 AND grpo_magnitude > 0 GROUP BY n_samples, sigma, reward_scale"""}


def _cells(i: Inputs) -> DataFrame:
    steps = i.transitions().select("prompt_id", F.slice("observation", 1, 2).alias("p"),
                                   F.slice("action", 1, 2).alias("t"))
    return gradients.sweep_cells(steps, "prompt_id", "p", "t", 38)


@query("sweep_cells", oracle(f"""
    SELECT n_samples, sigma, reward_scale, {rnd('avg_angle_diff', 3)} AS avg_angle_diff,
           {rnd('std_angle_diff', 3)} AS std_angle_diff, {rnd('avg_magnitude_ratio', 3)} AS avg_magnitude_ratio
    FROM cells""", "transitions", more=_CELLS))
def sweep_cells(i: Inputs) -> DataFrame:
    return _cells(i).select("n_samples", "sigma", "reward_scale", *[
        rounded(c, 3).alias(c) for c in ("avg_angle_diff", "std_angle_diff", "avg_magnitude_ratio")])


@query("sweep_summary", oracle(f"""
    SELECT parameter, value, {rnd('mean_metric', 3)} AS mean_metric FROM (
      SELECT 'n_samples' AS parameter, n_samples::DOUBLE AS value, avg(avg_angle_diff) AS mean_metric FROM cells GROUP BY n_samples
      UNION ALL SELECT 'sigma', sigma, avg(avg_angle_diff) FROM cells GROUP BY sigma
      UNION ALL SELECT 'reward_scale', reward_scale, avg(avg_angle_diff) FROM cells GROUP BY reward_scale)""",
    "transitions", more=_CELLS))
def sweep_summary(i: Inputs) -> DataFrame:
    summary = stats.sweep_summary(_cells(i), ["n_samples", "sigma", "reward_scale"], "avg_angle_diff")
    return summary.select("parameter", "value", rounded("mean_metric", 3).alias("mean_metric"))


@query("reinforce_gradients", oracle(f"""
    SELECT prompt_id, sample, {rnd('grpo_grad', 5)} AS grpo_grad, {rnd('mse_grad', 5)} AS mse_grad,
           {rnd('sample_reward', 5)} AS sample_reward,
           {rnd('CASE WHEN len > 0.01::DOUBLE THEN dx * (0.01::DOUBLE / len) ELSE dx END', 5)} AS capped_x
    FROM (SELECT prompt_id, sample, 0.5::DOUBLE * (yh - y) * (yh - y) * (yh - f) / 0.25::DOUBLE * x AS grpo_grad, (f - y) * x AS mse_grad,
                 -0.5::DOUBLE * (yh - y) * (yh - y) AS sample_reward, dx, sqrt(dx * dx + dy * dy) AS len
          FROM (SELECT *, (x - f) * d2 AS dx, (o2 - m2) * d2 AS dy FROM (
                SELECT prompt_id, g.i AS sample, observation[1] AS x, 0.5::DOUBLE * observation[1] AS f, action[1] AS y,
                       0.5::DOUBLE * observation[1] + {hash_normal(39, 'prompt_id', 'g.i')} * 0.5::DOUBLE AS yh,
                       observation[2] AS o2, 0.5::DOUBLE * observation[2] AS m2,
                       (observation[1] - action[1]) * (observation[1] - action[1])
                       + (observation[2] - action[2]) * (observation[2] - action[2]) AS d2
                FROM transitions, (SELECT unnest([0, 1, 2, 3, 4]) AS i) g)))""", "transitions"))
def reinforce_gradients(i: Inputs) -> DataFrame:
    x = F.col("observation")[0]
    rows = gradients.reinforce_gradients(i.transitions(), x, x * 0.5, F.col("action")[0], F.col("prompt_id"), 5, 0.5, 39)
    seen, target = F.slice("observation", 1, 2), F.slice("action", 1, 2)
    capped = gradients.capped_direction(vectors.scale(seen, 0.5), seen, target, longest=0.01)
    return rows.select("prompt_id", "sample", *[
        rounded(c, 5).alias(c) for c in ("grpo_grad", "mse_grad", "sample_reward")],
        rounded(capped[0], 5).alias("capped_x"))
