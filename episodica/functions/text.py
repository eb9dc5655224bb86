"""Prompt and training text built from vectors and templates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import fixed, fixed_list
from .parse import ACTION_END, ACTION_START, OBS_END, OBS_START
from .quantize import quantize_obs

# The skeleton of the prompt formats.
PROMPT_FORMAT = "### Instructions: %s\n ### User: %s\n ### Controller: <action>"
RESPONSE_TEMPLATE = "### Controller:"
PLACEHOLDER = "[OBSERVATION_PLACEHOLDER]"

# Example answers by environment.
CARTPOLE_EXAMPLE = "0</action>"
HALFCHEETAH_TOKEN_EXAMPLE = "100,101,102,103,104,105</action>"
HALFCHEETAH_EXAMPLE = "-0.39555,-0.66661,-0.36855,0.91655,-0.81651,1.16655</action>"

# Our own wording; callers may pass other texts.
HALFCHEETAH_PROMPT = (
    "Drive the planar cheetah forward. Each message holds the body state between <observation> and "
    "</observation>. Reply with six comma-separated joint torques between <action> and </action>.")
HALFCHEETAH_TOKEN_PROMPT = (
    "### Instructions: Drive the planar cheetah forward. The state between <observation> and </observation> "
    "is 17 integers from 0 to 999. Reply with six integers from 0 to 999 between <action> and </action>.")
CARTPOLE_PROMPT = (
    "### Instructions: Keep the pole upright. The state between <observation> and </observation> is 4 "
    "integers from 0 to 999: cart position, cart speed, pole angle, pole speed. Reply with 0 (left) or "
    "1 (right) between <action> and </action>.")


def _tagged(start: str, inner: Column, end: str) -> Column:
    return F.concat(F.lit(start), inner, F.lit(end))


def obs_to_prompt(obs: Column) -> Column:
    return _tagged(OBS_START, fixed_list(obs), OBS_END)


def obs_to_prompt_spaced(obs: Column, ranges: Column | None = None) -> Column:
    """Evaluation form with blanks; tokens instead of numbers when ``ranges`` are given."""
    if ranges is None:
        inner = fixed_list(obs, ", ")
    else:
        inner = F.array_join(quantize_obs(obs, ranges).cast("array<string>"), ", ")
    return _tagged(OBS_START + " ", inner, " " + OBS_END)


def action_to_prompt(vector: Column | None = None, scalar: Column | None = None) -> Column:
    """A vector as ``%.5f`` list, a scalar action as plain text."""
    inner = F.coalesce(*([fixed_list(vector)] if vector is not None else []),
                       *([scalar.cast("string")] if scalar is not None else []))
    return _tagged(ACTION_START, inner, ACTION_END)


def build_chat_messages(system: Column, observation: Column, action: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", system), message("user", observation), message("assistant", action))


def chat_query(messages: Column) -> Column:
    """Concatenated contents of the system and user messages."""
    asked = F.filter(messages, lambda m: m["role"].isin("system", "user"))
    return F.array_join(F.transform(asked, lambda m: m["content"]), "")


def build_grpo_prompt(system: Column, user: Column) -> Column:
    return F.format_string(PROMPT_FORMAT, system, user)


def build_grpo_prompt_tokenized(system: Column, obs: Column, ranges: Column) -> Column:
    tokens = F.array_join(quantize_obs(obs, ranges).cast("array<string>"), " ")
    return F.format_string(PROMPT_FORMAT, system, tokens)


def build_completion_only_text(system: Column, observation: Column, action: Column, spaced: bool = False) -> Column:
    """``### User: …`` / ``### Controller: …``; the spaced variant has a blank before the second."""
    joint = "\n " if spaced else "\n"
    return F.concat(F.lit("### User: "), system, observation, F.lit(f"{joint}{RESPONSE_TEMPLATE} "), action)


def split_completion_span(text: Column, response_template: str = RESPONSE_TEMPLATE) -> Column:
    """STRUCT<prompt_part, completion_part, completion_len>: only the second part is trained on.

    The first response template starts the span; without one nothing is trained on.
    """
    at = F.locate(response_template, text)
    cut = F.when(at > 0, at + len(response_template) - 1).otherwise(F.length(text))
    prompt = F.substring(text, F.lit(1), cut)
    completion = F.substring(text, cut + 1, F.length(text))
    return F.struct(prompt.alias("prompt_part"), completion.alias("completion_part"),
                    F.length(completion).cast("bigint").alias("completion_len"))


def completion_spans(text: Column, instruction_template: str,
                     response_template: str = RESPONSE_TEMPLATE) -> Column:
    """Trained spans of a text with several turns: from each response template to the next instruction."""
    parts = F.split(text, _quoted(response_template))
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.substring_index(p, instruction_template, 1))


def _quoted(template: str) -> str:
    return "\\Q" + template + "\\E"


def select_system_prompt(env: Column, discretized: Column | bool = False,
                         prompts: Mapping[str, str] | None = None, strict: bool = False) -> Column:
    """STRUCT<prompt, example_action> by case-insensitive environment name.

    Unknown names give NULL fields (rejects), or raise with ``strict=True``.
    """
    texts = {"cartpole": CARTPOLE_PROMPT, "halfcheetah": HALFCHEETAH_PROMPT,
             "halfcheetah_tokens": HALFCHEETAH_TOKEN_PROMPT, **(prompts or {})}
    flag = F.lit(discretized) if isinstance(discretized, bool) else discretized
    name = F.lower(env)
    cart, cheetah = name.contains("cartpole"), name.contains("halfcheetah")

    def pick(cartpole: str, tokens: str, numbers: str) -> Column:
        known = F.when(cart, F.lit(cartpole)).when(cheetah & flag, F.lit(tokens)).when(cheetah, F.lit(numbers))
        if not strict:
            return known
        return known.otherwise(F.raise_error(F.concat(F.lit("environment not supported: "), env)).cast("string"))

    return F.struct(
        pick(texts["cartpole"], texts["halfcheetah_tokens"], texts["halfcheetah"]).alias("prompt"),
        pick(CARTPOLE_EXAMPLE, HALFCHEETAH_TOKEN_EXAMPLE, HALFCHEETAH_EXAMPLE).alias("example_action"))


def render_prompt_template(template: Column, values: Mapping[str, Column]) -> Column:
    """Fill plain ``{{ name }}`` variables."""
    text = template
    for name, value in values.items():
        for spelling in ("{{%s}}" % name, "{{ %s }}" % name):
            text = F.replace(text, F.lit(spelling), value)
    return text


def build_env_prompt(spec: Mapping[str, Column]) -> Column:
    """A long system prompt from the columns of an environment specification row."""
    states = F.array_join(F.transform(
        spec["obs_desc"], lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d)), ", ")
    return F.concat(
        F.lit("Control task: "), spec["env"],
        F.lit("\nEnvironment: "), spec["description"],
        F.lit("\nState ("), spec["obs_dim"].cast("string"), F.lit(" values): "), states,
        F.lit("\nAction ("), spec["action_dim"].cast("string"), F.lit(" values): "), spec["action_desc"],
        F.lit("\nGoal: "), spec["task"],
        F.lit("\nReward: "), spec["reward"],
        F.lit("\nFrequency: "), spec["frequency"],
        F.lit(f"\nAnswer with numbers only, separated by commas.\nObservation: {PLACEHOLDER}"))


def vector_to_list_text(v: Column, decimals: int = 5) -> Column:
    return F.concat(F.lit("["), fixed_list(v, ", ", decimals), F.lit("]"))


def fill_observation(prompt: Column, obs: Column, decimals: int = 5) -> Column:
    return F.replace(prompt, F.lit(PLACEHOLDER), vector_to_list_text(obs, decimals))


def truncate_text(text: Column, limit: int, keep: str = "last") -> Column:
    """The last (prompt limit) or first (sequence limit) ``limit`` whitespace tokens."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    if keep == "last":
        start = F.greatest(F.size(words) - limit + 1, F.lit(1))
        return F.array_join(F.slice(words, start, F.lit(limit)), " ")
    if keep == "first":
        return F.array_join(F.slice(words, 1, limit), " ")
    raise ValueError("keep must be 'first' or 'last'")


def model_short_name(path: Column) -> Column:
    """Run label of a model path."""
    return F.substring_index(F.substring_index(F.substring_index(path, "/final_model", 1), "/", 1), "--", -1)


def log_line(v: Column) -> Column:
    return F.transform(v, lambda x: fixed(x, 4))
