"""Advantages, splits, samples and mini-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from ..operators import groups, sampling
from ..operators.sampling import PRIME, round_keys
from ..sources.tables import Inputs
from .registry import hash_key, hash_uniform, oracle, query, rnd, rounded
from .rewards import BC_DISCRETE_SQL, FORMAT_DISCRETE_SQL, discrete_scores

TOTAL_SQL = f"(({FORMAT_DISCRETE_SQL}) + ({BC_DISCRETE_SQL}))"
SCORES = {"scores": f"SELECT prompt_id, gen_id, {FORMAT_DISCRETE_SQL} AS reward_format, "
                    f"{BC_DISCRETE_SQL} AS reward_bc, {TOTAL_SQL} AS reward FROM completions_discrete"}
ADVANTAGES = {**SCORES, "advantages": """
    SELECT *, avg(reward) OVER w AS group_mean, stddev_samp(reward) OVER w AS group_std,
           (reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-4) AS advantage
    FROM scores WINDOW w AS (PARTITION BY prompt_id)"""}


@query("group_advantage", oracle(f"""
    SELECT prompt_id, gen_id, {rnd('reward', 4)} AS reward, {rnd('group_std', 4)} AS group_std,
           {rnd('advantage', 4)} AS advantage FROM advantages""", "completions_discrete", more=ADVANTAGES))
def group_advantage(i: Inputs) -> DataFrame:
    rows = groups.group_advantage(discrete_scores(i))
    return rows.select("prompt_id", "gen_id", *[rounded(c, 4).alias(c) for c in ("reward", "group_std", "advantage")])


@query("group_advantage_unscaled", oracle(f"""
    SELECT prompt_id, gen_id, {rnd('reward - group_mean', 4)} AS advantage FROM advantages""",
    "completions_discrete", more=ADVANTAGES))
def group_advantage_unscaled(i: Inputs) -> DataFrame:
    rows = groups.group_advantage(discrete_scores(i), scaled=False)
    return rows.select("prompt_id", "gen_id", rounded("advantage", 4).alias("advantage"))


@query("minmax_scale_group", oracle(f"""
    SELECT prompt_id, gen_id, {rnd('scaled')} AS scaled, {rnd('50 + 100 * scaled', 4)} AS marker_size
    FROM (SELECT prompt_id, gen_id, (reward - min(reward) OVER w) / (max(reward) OVER w - min(reward) OVER w + 1e-8)
                 AS scaled FROM scores WINDOW w AS (PARTITION BY prompt_id))""", "completions_discrete", more=SCORES))
def minmax_scale_group(i: Inputs) -> DataFrame:
    rows = groups.minmax_scale_group(discrete_scores(i), "reward", ("prompt_id",))
    return rows.select("prompt_id", "gen_id", rounded("scaled").alias("scaled"),
                       rounded("marker_size", 4).alias("marker_size"))


@query("guard_loss", oracle(f"""
    SELECT count(*) FILTER (reward > 10 OR reward < -10) AS n_flagged, count(*) AS n_rows,
           {rnd('sum(reward) FILTER (reward BETWEEN -10 AND 10)', 4)} AS kept_sum FROM scores""",
    "completions_discrete", more=SCORES))
def guard_loss(i: Inputs) -> DataFrame:
    flagged, reward = policy.guard_loss(F.col("reward")), F.col("reward")
    checked = policy.checked_loss(F.when(flagged, 0.0).otherwise(reward))  # would stop the job at a loss that came through
    return discrete_scores(i).agg(F.sum(flagged.cast("int")).alias("n_flagged"), F.count(F.lit(1)).alias("n_rows"),
                                  rounded(F.sum(checked), 4).alias("kept_sum"))


_RANKED = {"ranked": f"""SELECT *, row_number() OVER (ORDER BY {hash_key(42, 'prompt_id')}, prompt_id) - 1 AS rank,
                                count(*) OVER () AS n FROM transitions"""}


def _turn_sql(r: int, k: int, m: int) -> str:
    x, y = ("s[2]", "s[1]") if r % 2 == 0 else ("s[1]", "s[2]")
    t = f"(({x} + {k}) % {PRIME})"
    moved = f"({y} + ({t} * {t} % {PRIME} * {t} + {m}) % {PRIME}) % {'a' if r % 2 == 0 else 'b'}"
    return f"[{moved}, s[2]]" if r % 2 == 0 else f"[s[1], {moved}]"


def _once_sql(x: str) -> str:
    """The permutation's rounds on a number, as nested list transforms."""
    state = f"[[{x} // b, {x} % b]]"
    for r, (k, m) in enumerate(round_keys(42)):
        state = f"list_transform({state}, lambda s: {_turn_sql(r, k, m)})"
    return f"list_transform({state}, lambda s: s[1] * b + s[2])[1]"


_PERMUTED = {
    "sized": """SELECT prompt_id, n, a, ceil(n::DOUBLE / a)::BIGINT AS b
                FROM (SELECT prompt_id, n, ceil(sqrt(n::DOUBLE))::BIGINT AS a FROM (SELECT prompt_id, count(*) OVER () AS n FROM transitions))""",
    "walk": f"""SELECT prompt_id, n, a, b, {_once_sql('prompt_id')} AS rank FROM sized
                UNION ALL SELECT prompt_id, n, a, b, {_once_sql('rank')} FROM walk WHERE rank >= n""",
    "permuted": "SELECT prompt_id, rank, n FROM walk WHERE rank < n"}


def _permuted_oracle(body: str) -> str:
    return oracle(body, "transitions", more=_PERMUTED).replace("WITH ", "WITH RECURSIVE ", 1)


@query("train_test_split", _permuted_oracle("""
    SELECT prompt_id, CASE WHEN rank < ceil(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM permuted"""))
def train_test_split(i: Inputs) -> DataFrame:
    return sampling.train_test_split(i.transitions(), "prompt_id", 42, number="prompt_id").select("prompt_id", "split")


@query("train_val_split_exact", _permuted_oracle("""
    SELECT prompt_id, CASE WHEN rank < round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split
    FROM permuted"""))
def train_val_split_exact(i: Inputs) -> DataFrame:
    return sampling.train_val_split_exact(i.transitions(), "prompt_id", 42, number="prompt_id").select("prompt_id", "split")


@query("random_sample_n", oracle("SELECT prompt_id, reward FROM ranked WHERE rank < 100", "transitions", more=_RANKED))
def random_sample_n(i: Inputs) -> DataFrame:
    return sampling.random_sample_n(i.transitions(), "prompt_id", 100, 42).select("prompt_id", "reward")


@query("minibatches", oracle("""
    SELECT prompt_id, rank // 64 AS batch FROM ranked WHERE rank // 64 < n // 64""", "transitions", more=_RANKED))
def minibatches(i: Inputs) -> DataFrame:
    return sampling.minibatches(i.transitions(), "prompt_id", 64, 42).select("prompt_id", "batch")


@query("bernoulli_sample", oracle(f"""
    SELECT prompt_id, reward FROM transitions WHERE {hash_uniform(5, 'prompt_id')} < 0.1""", "transitions"))
def bernoulli_sample(i: Inputs) -> DataFrame:
    return sampling.bernoulli_sample(i.transitions(), "prompt_id", 0.1, 5).select("prompt_id", "reward")


@query("rejection_sample", oracle(f"""
    SELECT class, n_drawn, n_kept, {rnd('n_kept / sum(n_kept) OVER ()')} AS share, {rnd('expected')} AS expected_share,
           {rnd('sum(n_kept) OVER () / sum(n_drawn) OVER ()')} AS acceptance_rate
    FROM (SELECT class, count(*) AS n_drawn, count(*) FILTER (u2 < [0.1, 0.6, 0.3][class + 1]) AS n_kept,
                 [0.07, 0.12, 0.03][class + 1]::DOUBLE / 0.22::DOUBLE AS expected
          FROM (SELECT CASE WHEN u1 <= 0.7 THEN 0 WHEN u1 <= 0.7 + 0.2 THEN 1 ELSE 2 END AS class, u2
                FROM (SELECT {hash_uniform(9, 'prompt_id')} AS u1, {hash_uniform(9, 'prompt_id', start=9)} AS u2
                      FROM transitions)) GROUP BY class)""", "transitions"))
def rejection_sample(i: Inputs) -> DataFrame:
    report = sampling.rejection_sample(i.transitions(), "prompt_id", [0.7, 0.2, 0.1], [0.1, 0.6, 0.3], 9)
    return report.select("class", "n_drawn", "n_kept", *[
        rounded(c).alias(c) for c in ("share", "expected_share", "acceptance_rate")])
