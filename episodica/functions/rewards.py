"""Reward functions as columns, and the registry that runs a list of them.

Each builder takes the response column and whatever logged columns it needs, so completions are
aligned to transitions by key before scoring and never by position.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parse, vectors
from .parse import ACTION_END
from .quantize import dequantize_action

# Penalties and the fallback of the learned reward.
BAD_FORMAT = -10.0
REWARD_MODEL_FALLBACK = -3.15


def _ends_with_tag(response: Column) -> Column:
    """``</action>`` at the end, a final newline allowed."""
    return response.endswith(ACTION_END) | response.endswith(ACTION_END + "\n")


def _bonus(response: Column) -> Column:
    return F.when(_ends_with_tag(response), 1.0).otherwise(0.0)


def _text_after_tag(response: Column) -> Column:
    """Length of the text behind the first closing tag, later tags not counted."""
    all_text = F.length(F.replace(response, F.lit(ACTION_END), F.lit("")))
    return all_text - F.length(F.substring_index(response, ACTION_END, 1))


def _format_list(response: Column, n: int, pattern: str) -> Column:
    numbers = parse.matched_list(response, pattern)
    shape = (F.when(parse.item_count(numbers) == n, -_text_after_tag(response) / 10.0)
             .otherwise(F.lit(BAD_FORMAT)))
    return F.when(numbers == "", F.lit(BAD_FORMAT)).otherwise(shape + _bonus(response))


def reward_format_continuous(response: Column, n: int) -> Column:
    return _format_list(response, n, parse.DECIMAL_LIST)


def reward_format_tokenized(response: Column, n: int) -> Column:
    return _format_list(response, n, parse.INTEGER_LIST)


def reward_format_discrete(response: Column, n_discrete: int) -> Column:
    matched = 1 + len(ACTION_END)
    good = -(F.length(response) - matched) / 10.0 + _bonus(response)
    return F.when(response.rlike(parse.discrete_pattern(n_discrete)), good).otherwise(F.lit(BAD_FORMAT))


def reward_bc_continuous(response: Column, action: Column, n: int) -> Column:
    parsed = parse.floats_of(response, parse.DECIMAL_LIST, n)
    return F.coalesce(-vectors.mse(parsed, action), F.lit(BAD_FORMAT))


def reward_bc_tokenized(response: Column, action: Column, n: int, ranges: Column) -> Column:
    parsed = dequantize_action(parse.tokens_of(response, parse.INTEGER_LIST, n), ranges)
    return F.coalesce(-vectors.mse(parsed, action), F.lit(BAD_FORMAT))


def reward_bc_discrete(response: Column, action: Column, n_discrete: int) -> Column:
    chosen = parse.extract_action_discrete(response, n_discrete)
    return F.when(chosen.isNull(), F.lit(BAD_FORMAT)).when(chosen == action, 0.0).otherwise(-1.0)


def reward_bc_vector(generated: Column, action: Column) -> Column:
    """No parsing: the generated action is already a vector."""
    return -vectors.mse(generated, action)


def reward_control_amplitude(response: Column, n: int) -> Column:
    """Wrong counts give 0, not a penalty. Deprecated in favour of the other rewards."""
    numbers = parse.matched_list(response, parse.TAGGED_DECIMAL_LIST)
    action = parse.floats_of(response, parse.TAGGED_DECIMAL_LIST, n)
    return F.when(numbers == "", F.lit(BAD_FORMAT)).otherwise(F.coalesce(-vectors.norm(action), F.lit(0.0)))


def reward_model_continuous(response: Column, observation: Column, n: int,
                            score: Callable[[Column, Column], Column],
                            fallback: float = REWARD_MODEL_FALLBACK) -> Column:
    """Learned reward of the parsed action; ``score`` maps (state, action) columns to a column."""
    parsed = parse.floats_of(response, parse.DECIMAL_LIST, n)
    return F.coalesce(score(observation, parsed), F.lit(fallback))


def reward_model_tokenized(response: Column, observation: Column, n: int, ranges: Column,
                           score: Callable[[Column, Column], Column],
                           fallback: float = REWARD_MODEL_FALLBACK) -> Column:
    parsed = dequantize_action(parse.tokens_of(response, parse.INTEGER_LIST, n), ranges)
    return F.coalesce(score(observation, parsed), F.lit(fallback))


def reward_logged(reward: Column) -> Column:
    return reward


def reward_zero_log() -> Column:
    """The constant that goes with the sampled log of ``write_completion_samples``."""
    return F.lit(0.0)


def reward_total(df: DataFrame, rewards: Mapping[str, Column], total: str = "reward") -> DataFrame:
    """One column per reward function, and their sum."""
    scored = df.withColumns({f"reward_{name}": column for name, column in rewards.items()})
    summed = [F.col(f"reward_{name}") for name in rewards]
    return scored.withColumn(total, sum(summed[1:], summed[0]))


def python_reward(fn: Callable[..., list[float]], columns: Mapping[str, Column]) -> Column:
    """Wrap a list-based reward callable as an Arrow-batched column.

    ``fn`` receives each named column as a list, as in ``fn(prompts=…, completions=…, **columns)``.
    Rows of a batch are aligned; a callable must not depend on which rows share a batch.
    """
    names = list(columns)

    def run(*series: pd.Series) -> pd.Series:
        lists = {name: s.tolist() for name, s in zip(names, series)}
        return pd.Series(fn(**lists), dtype="float64")

    run.__signature__ = inspect.Signature(
        [inspect.Parameter(f"c{i}", inspect.Parameter.POSITIONAL_ONLY, annotation=pd.Series)
         for i in range(len(names))], return_annotation=pd.Series)
    run.__annotations__ = {**{f"c{i}": pd.Series for i in range(len(names))}, "return": pd.Series}
    return F.pandas_udf(run, "double")(*columns.values())


class RewardRegistry:
    """Named rewards; an entry declares the columns it reads and how to build its own column."""

    def __init__(self) -> None:
        self._entries: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {}

    def register(self, name: str, columns: Sequence[str], build: Callable[..., Column]) -> None:
        if name in self._entries:
            raise ValueError(f"reward {name!r} is registered already")
        self._entries[name] = (tuple(columns), build)

    def names(self) -> list[str]:
        return list(self._entries)

    def score(self, df: DataFrame, names: Sequence[str] | None = None, total: str = "reward") -> DataFrame:
        chosen = list(names) if names is not None else self.names()
        built = {}
        for name in chosen:
            columns, build = self._entries[name]
            missing = [c for c in columns if c not in df.columns]
            if missing:
                raise ValueError(f"reward {name!r} needs columns {missing}")
            built[name] = build(*[F.col(c) for c in columns])
        return reward_total(df, built, total)
