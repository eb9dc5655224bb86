"""Reward functions and the reward total."""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rewards as rw
from ..functions.equation import equation_candidate, reward_equation
from ..operators import align, scoring, stats
from ..session import scratch_dir
from ..sources import files
from ..sources.tables import ACT_DIMS, Inputs
from .data import fitted_stats
from .networks import LINEAR_REWARD, linear_reward_sql, network_frame
from .registry import hash_uniform, oracle, query, rnd, rounded
from .text import DECODED_SQL, TOKEN_LIST_SQL, TOKENS_VALID_SQL

_LIST = "regexp_extract(completion, '^([-+]?\\d*\\.\\d+(?:,\\s*[-+]?\\d*\\.\\d+)*)', 1)"
_END = "(CASE WHEN regexp_matches(completion, '</action>\\n?$') THEN 1::DOUBLE ELSE 0::DOUBLE END)"
_EXTRA = "length(array_to_string(string_split(completion, '</action>')[2:], ''))"


def _format_sql(found: str) -> str:
    return (f"CASE WHEN {found} = '' THEN -10::DOUBLE ELSE {_END} + "
            f"CASE WHEN len(string_split({found}, ',')) = {ACT_DIMS} THEN -{_EXTRA} / 10::DOUBLE ELSE -10::DOUBLE END END")


FORMAT_SQL, FORMAT_TOKEN_SQL = _format_sql(_LIST), _format_sql(TOKEN_LIST_SQL)
FORMAT_DISCRETE_SQL = (f"CASE WHEN regexp_matches(completion, '^[0-1]</action>') THEN "
                       f"-(length(completion) - 10) / 10::DOUBLE + {_END} ELSE -10::DOUBLE END")
_PARSED = f"list_transform(string_split({_LIST}, ','), lambda x: TRY_CAST(trim(x) AS DOUBLE))"
PARSED_SQL = f"CASE WHEN {_LIST} <> '' AND len(string_split({_LIST}, ',')) = {ACT_DIMS} THEN {_PARSED} END"


def mse_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len({b})"


BC_SQL = f"coalesce(-({mse_sql(PARSED_SQL, 'action')}), -10::DOUBLE)"
DECODED_OR_NULL = f"CASE WHEN {TOKENS_VALID_SQL} THEN {DECODED_SQL} END"
BC_TOKEN_SQL = f"coalesce(-({mse_sql(DECODED_OR_NULL, 'action')}), -10::DOUBLE)"
_DIGIT = "CAST(nullif(regexp_extract(completion, '^([0-1])</action>', 1), '') AS INTEGER)"
BC_DISCRETE_SQL = (f"CASE WHEN {_DIGIT} IS NULL THEN -10::DOUBLE WHEN {_DIGIT} = action_disc THEN 0::DOUBLE "
                   "ELSE -1::DOUBLE END")


def _scored(rows: DataFrame, reward: Column) -> DataFrame:
    return rows.select("prompt_id", "gen_id", rounded(reward).alias("reward"))


def _reward_oracle(expression: str, *ctes: str) -> str:
    return oracle(f"SELECT prompt_id, gen_id, {rnd(expression)} AS reward FROM {ctes[0]}", *ctes)


def _with_action_ranges(i: Inputs, rows: DataFrame) -> DataFrame:
    return stats.apply_ranges(rows, stats.dim_ranges(i.transitions(), "action", ACT_DIMS))


@query("reward_format_continuous", _reward_oracle(FORMAT_SQL, "completions_continuous"))
def reward_format_continuous(i: Inputs) -> DataFrame:
    return _scored(i.completions_continuous(), rw.reward_format_continuous(F.col("completion"), ACT_DIMS))


@query("reward_format_tokenized", _reward_oracle(FORMAT_TOKEN_SQL, "completions_tokenized"))
def reward_format_tokenized(i: Inputs) -> DataFrame:
    return _scored(i.completions_tokenized(), rw.reward_format_tokenized(F.col("completion"), ACT_DIMS))


@query("reward_format_discrete", _reward_oracle(FORMAT_DISCRETE_SQL, "completions_discrete"))
def reward_format_discrete(i: Inputs) -> DataFrame:
    return _scored(i.completions_discrete(), rw.reward_format_discrete(F.col("completion"), 2))


@query("reward_bc_continuous", _reward_oracle(BC_SQL, "completions_continuous"))
def reward_bc_continuous(i: Inputs) -> DataFrame:
    rows = i.completions_continuous("action")
    return _scored(rows, rw.reward_bc_continuous(F.col("completion"), F.col("action"), ACT_DIMS))


@query("reward_bc_tokenized", _reward_oracle(BC_TOKEN_SQL, "completions_tokenized", "action_ranges"))
def reward_bc_tokenized(i: Inputs) -> DataFrame:
    rows = _with_action_ranges(i, i.completions_tokenized("action"))
    return _scored(rows, rw.reward_bc_tokenized(F.col("completion"), F.col("action"), ACT_DIMS, F.col("ranges")))


@query("reward_bc_discrete", _reward_oracle(BC_DISCRETE_SQL, "completions_discrete"))
def reward_bc_discrete(i: Inputs) -> DataFrame:
    rows = i.completions_discrete("action_disc")
    return _scored(rows, rw.reward_bc_discrete(F.col("completion"), F.col("action_disc"), 2))


@query("reward_bc_vector", oracle(f"""
    SELECT prompt_id, {rnd('-(' + mse_sql('mean', 'action') + ')')} AS reward FROM policy_outputs""",
    "policy_outputs"))
def reward_bc_vector(i: Inputs) -> DataFrame:
    return i.policy_outputs().select(
        "prompt_id", rounded(rw.reward_bc_vector(F.col("mean"), F.col("action"))).alias("reward"))


_TAGGED = "regexp_extract('<action>' || completion, '<action>([-+]?\\d*\\.\\d+(?:,\\s*[-+]?\\d*\\.\\d+)*)</action>', 1)"


@query("reward_control_amplitude", _reward_oracle(
    f"CASE WHEN {_TAGGED} = '' THEN -10::DOUBLE WHEN len(string_split({_TAGGED}, ',')) = {ACT_DIMS} THEN "
    f"-sqrt(list_sum(list_transform(string_split({_TAGGED}, ','), lambda x: "
    "CAST(trim(x) AS DOUBLE) * CAST(trim(x) AS DOUBLE)))) ELSE 0::DOUBLE END", "completions_continuous"))
def reward_control_amplitude(i: Inputs) -> DataFrame:
    response = F.concat(F.lit("<action>"), "completion")
    return _scored(i.completions_continuous(), rw.reward_control_amplitude(response, ACT_DIMS))


@query("reward_model_continuous", _reward_oracle(
    f"coalesce({linear_reward_sql('observation', PARSED_SQL)}, -3.15::DOUBLE)", "completions_continuous", "norm_stats"))
def reward_model_continuous(i: Inputs) -> DataFrame:
    net = scoring.load_network(network_frame(i.spark, LINEAR_REWARD))
    rows, fitted = i.completions_continuous("observation"), fitted_stats(i).first()
    return _scored(rows, rw.reward_model_continuous(
        F.col("completion"), F.col("observation"), ACT_DIMS,
        lambda s, a: scoring.score_reward_model(i.spark, net, s, a, fitted)))


@query("reward_model_tokenized", _reward_oracle(
    f"coalesce({linear_reward_sql('observation', DECODED_OR_NULL)}, -3.15::DOUBLE)",
    "completions_tokenized", "norm_stats", "action_ranges"))
def reward_model_tokenized(i: Inputs) -> DataFrame:
    net = scoring.load_network(network_frame(i.spark, LINEAR_REWARD))
    rows, fitted = _with_action_ranges(i, i.completions_tokenized("observation")), fitted_stats(i).first()
    return _scored(rows, rw.reward_model_tokenized(
        F.col("completion"), F.col("observation"), ACT_DIMS, F.col("ranges"),
        lambda s, a: scoring.score_reward_model(i.spark, net, s, a, fitted)))


@query("reward_logged", oracle("SELECT prompt_id, gen_id, reward_logged AS reward FROM completions_discrete",
                               "completions_discrete"))
def reward_logged(i: Inputs) -> DataFrame:
    rows = i.completions_discrete("reward").withColumnRenamed("reward", "logged")
    return rows.select("prompt_id", "gen_id", rw.reward_logged(F.col("logged")).alias("reward"))


@query("reward_zero_log", oracle(f"""
    SELECT prompt_id, gen_id, 0::DOUBLE AS reward, {hash_uniform(11, 'prompt_id', 'gen_id')} < 0.1 AS logged
    FROM completions_discrete""", "completions_discrete"))
def reward_zero_log(i: Inputs) -> DataFrame:
    from ..functions.numbers import uniform
    return i.completions_discrete().select("prompt_id", "gen_id", rw.reward_zero_log().alias("reward"),
                                           (uniform(11, F.col("prompt_id"), F.col("gen_id")) < 0.1).alias("logged"))


@query("reward_equation", oracle("""
    SELECT item_id, CASE WHEN item_id % 6 IN (0, 1) THEN a || ' + ' || b || '*3'
                         WHEN item_id % 6 = 5 THEN '(' || a || '+' || b || ')/(3-3)' END AS candidate,
           CASE WHEN item_id % 6 IN (0, 1) AND abs(a + b * 3 - target) < 1e-5 THEN 1::DOUBLE ELSE 0::DOUBLE END AS reward
    FROM countdown""", "countdown"))
def reward_equation_query(i: Inputs) -> DataFrame:
    rows = i.countdown()
    return rows.select("item_id", equation_candidate(F.col("completion"), F.col("nums")).alias("candidate"),
                       reward_equation(F.col("completion"), F.col("target"), F.col("nums")).alias("reward"))


def discrete_registry() -> rw.RewardRegistry:
    registry = rw.RewardRegistry()
    registry.register("log", [], rw.reward_zero_log)
    registry.register("format", ["completion"], lambda c: rw.reward_format_discrete(c, 2))
    registry.register("bc", ["completion", "action_disc"], lambda c, a: rw.reward_bc_discrete(c, a, 2))
    return registry


def discrete_scores(i: Inputs, *keep: str) -> DataFrame:
    return discrete_registry().score(i.completions_discrete("action_disc", *keep))


@query("reward_total", oracle(f"""
    SELECT prompt_id, gen_id, 0::DOUBLE AS reward_log, {rnd(FORMAT_DISCRETE_SQL)} AS reward_format,
           {rnd(BC_DISCRETE_SQL)} AS reward_bc, {rnd(f'({FORMAT_DISCRETE_SQL}) + ({BC_DISCRETE_SQL})')} AS reward
    FROM completions_discrete""", "completions_discrete"))
def reward_total(i: Inputs) -> DataFrame:
    return discrete_scores(i).select("prompt_id", "gen_id", "reward_log", *[
        rounded(c).alias(c) for c in ("reward_format", "reward_bc", "reward")])


@query("join_completions_to_transitions", oracle("""
    SELECT c.prompt_id, c.gen_id, c.completion, t.episode_id, t.action_disc, t.reward
    FROM completions_discrete c JOIN transitions t ON t.prompt_id = c.prompt_id""",
    "completions_discrete", "transitions"))
def join_completions_to_transitions(i: Inputs) -> DataFrame:
    logged = i.transitions().select("prompt_id", "episode_id", "action_disc", "reward")
    return align.join_completions_to_transitions(i.completions_discrete(), logged).select(
        "prompt_id", "gen_id", "completion", "episode_id", "action_disc", "reward")


@query("repeat_prompts", oracle("""
    SELECT prompt_id, g.i AS gen_id, reward FROM transitions, (SELECT unnest([0, 1, 2, 3, 4]) AS i) g""",
    "transitions"))
def repeat_prompts(i: Inputs) -> DataFrame:
    return align.repeat_prompts(i.transitions().select("prompt_id", "reward"), 5).select(
        "prompt_id", "gen_id", "reward")


@query("join_kept_by_prompt", oracle("""
    SELECT c.prompt_id, c.gen_id, c.completion, t.episode_id, t.action_disc, t.reward
    FROM completions_discrete c JOIN transitions t ON t.prompt_id = c.prompt_id""",
    "completions_discrete", "transitions"))
def join_kept_by_prompt(i: Inputs) -> DataFrame:
    """The join of completions and transitions that an earlier job kept in buckets of their prompts: no row is exchanged."""
    folder = scratch_dir(i.spark, "kept")
    name, buckets = uuid.uuid4().hex, int(i.spark.conf.get("spark.sql.shuffle.partitions"))
    logged = i.transitions().select("prompt_id", "episode_id", "action_disc", "reward")
    files.save_by_prompt(logged, f"transitions_{name}", buckets, f"{folder}/transitions")
    files.save_by_prompt(i.completions_discrete(), f"completions_{name}", buckets, f"{folder}/completions")
    return align.join_completions_to_transitions(i.spark.table(f"completions_{name}").hint("merge"), i.spark.table(f"transitions_{name}")).select(
        "prompt_id", "gen_id", "completion", "episode_id", "action_disc", "reward")


def _originality(prompts: list, completions: list) -> list[float]:
    """A user's callable: one over the number of completions of the prompt that say the same."""
    seen = Counter(zip(prompts, completions))
    return [1.0 / seen[pair] for pair in zip(prompts, completions)]


@query("python_reward", oracle(f"""
    SELECT prompt_id, gen_id, {rnd('1::DOUBLE / count(*) OVER (PARTITION BY prompt_id, completion)')} AS reward
    FROM completions_discrete""", "completions_discrete"))
def python_reward(i: Inputs) -> DataFrame:
    scored = align.score_whole_groups(i.completions_discrete(), _originality, {"prompts": "prompt_id", "completions": "completion"})
    return scored.select("prompt_id", "gen_id", rounded("reward").alias("reward"))
