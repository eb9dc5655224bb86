"""Prompts, training text, quantisation and action extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import parse, quantize, text
from ..operators import align, episodes, evaluate, stats
from ..sources.tables import ACT_DIMS, OBS_DIMS, Inputs
from .registry import as_text, hash_key, literal, oracle, query, rnd, rounded, txt

OBS_SQL = f"'<observation>' || {txt('observation')} || '</observation>'"
ACT_SQL = f"'<action>' || {txt('action')} || '</action>'"
TOKENS_SQL = ("list_transform(list_zip(observation, (SELECT ranges FROM obs_ranges)), lambda p: "
              "CASE WHEN p[2].max = p[2].min THEN 0 ELSE CAST(trunc((least(greatest(p[1], p[2].min), p[2].max) "
              "- p[2].min) / (p[2].max - p[2].min) * 999::DOUBLE) AS INTEGER) END)")
_CHEETAH, _CART = literal(text.HALFCHEETAH_PROMPT), literal(text.CARTPOLE_PROMPT)


@query("obs_to_prompt", oracle(f"SELECT prompt_id, {OBS_SQL} AS prompt FROM transitions", "transitions"))
def obs_to_prompt(i: Inputs) -> DataFrame:
    return i.transitions().select("prompt_id", text.obs_to_prompt(F.col("observation")).alias("prompt"))


@query("obs_to_prompt_spaced", oracle(f"""
    SELECT prompt_id, '<observation> ' || {txt('observation', 5, ', ')} || ' </observation>' AS raw,
           '<observation> ' || array_to_string({TOKENS_SQL}, ', ') || ' </observation>' AS tokens
    FROM transitions""", "transitions", "obs_ranges"))
def obs_to_prompt_spaced(i: Inputs) -> DataFrame:
    rows = _with_obs_ranges(i, i.transitions())
    return rows.select("prompt_id", text.obs_to_prompt_spaced(F.col("observation")).alias("raw"),
                       text.obs_to_prompt_spaced(F.col("observation"), F.col("ranges")).alias("tokens"))


@query("action_to_prompt", oracle(f"""
    SELECT prompt_id, {ACT_SQL} AS vector_prompt, '<action>' || action_disc || '</action>' AS scalar_prompt
    FROM transitions""", "transitions"))
def action_to_prompt(i: Inputs) -> DataFrame:
    return i.transitions().select(
        "prompt_id", text.action_to_prompt(vector=F.col("action")).alias("vector_prompt"),
        text.action_to_prompt(scalar=F.col("action_disc")).alias("scalar_prompt"))


@query("parse_tagged_vector", oracle(f"""
    SELECT prompt_id, {txt('list_transform(observation, lambda x: round(x, 5))')} AS observation,
           {txt('list_transform(action, lambda x: round(x, 5))')} AS action
    FROM transitions""", "transitions"))
def parse_tagged_vector(i: Inputs) -> DataFrame:
    sft = episodes.build_sft_examples(i.transitions())
    return sft.select(
        "prompt_id",
        as_text(parse.parse_tagged_vector(F.col("observation"), parse.OBS_START, parse.OBS_END)).alias("observation"),
        as_text(parse.parse_tagged_vector(F.col("action"), parse.ACTION_START, parse.ACTION_END)).alias("action"))


@query("vector_to_list_text", oracle(f"""
    SELECT prompt_id, '[' || {txt('observation', 5, ', ')} || ']' AS prompt FROM transitions""", "transitions"))
def vector_to_list_text(i: Inputs) -> DataFrame:
    return i.transitions().select("prompt_id", text.vector_to_list_text(F.col("observation")).alias("prompt"))


@query("parse_bracket_vector", oracle(f"""
    SELECT prompt_id, {txt('list_transform(observation, lambda x: round(x, 5))')} AS observation
    FROM transitions""", "transitions"))
def parse_bracket_vector(i: Inputs) -> DataFrame:
    prompts = i.transitions().select("prompt_id", text.vector_to_list_text(F.col("observation")).alias("prompt"))
    return prompts.select("prompt_id", as_text(parse.parse_bracket_vector(F.col("prompt"), OBS_DIMS)).alias("observation"))


@query("build_chat_messages", oracle(f"""
    SELECT prompt_id, m.role AS role, m.content AS content
    FROM (SELECT prompt_id, unnest([{{'role': 'system', 'content': {_CHEETAH}}},
                                    {{'role': 'user', 'content': {OBS_SQL}}},
                                    {{'role': 'assistant', 'content': {ACT_SQL}}}]) AS m FROM transitions)""",
    "transitions"))
def build_chat_messages(i: Inputs) -> DataFrame:
    messages = text.build_chat_messages(F.lit(text.HALFCHEETAH_PROMPT), F.col("observation"), F.col("action"))
    rows = episodes.build_sft_examples(i.transitions()).select("prompt_id", F.explode(messages).alias("m"))
    return rows.select("prompt_id", "m.role", "m.content")


@query("build_grpo_prompt", oracle(f"""
    SELECT prompt_id, '### Instructions: ' || {_CHEETAH} || chr(10) || ' ### User: ' || {OBS_SQL} || chr(10)
           || ' ### Controller: <action>' AS prompt FROM transitions""", "transitions"))
def build_grpo_prompt(i: Inputs) -> DataFrame:
    sft = episodes.build_sft_examples(i.transitions())
    return sft.select("prompt_id", text.build_grpo_prompt(
        F.lit(text.HALFCHEETAH_PROMPT), F.col("observation")).alias("prompt"))


def _with_obs_ranges(i: Inputs, rows: DataFrame) -> DataFrame:
    return stats.apply_ranges(rows, stats.dim_ranges(i.transitions(), "observation", OBS_DIMS))


@query("build_grpo_prompt_tokenized", oracle(f"""
    SELECT prompt_id, '### Instructions: ' || {_CART} || chr(10) || ' ### User: '
           || array_to_string({TOKENS_SQL}, ' ') || chr(10) || ' ### Controller: <action>' AS prompt
    FROM transitions""", "transitions", "obs_ranges"))
def build_grpo_prompt_tokenized(i: Inputs) -> DataFrame:
    rows = _with_obs_ranges(i, i.transitions())
    return rows.select("prompt_id", text.build_grpo_prompt_tokenized(
        F.lit(text.CARTPOLE_PROMPT), F.col("observation"), F.col("ranges")).alias("prompt"))


_TEXT_SQL = f"'### User: ' || {_CHEETAH} || {OBS_SQL} || chr(10) || '### Controller: ' || {ACT_SQL}"


@query("build_completion_only_text", oracle(f"""
    SELECT prompt_id, {_TEXT_SQL} AS text,
           '### User: ' || {_CHEETAH} || {OBS_SQL} || chr(10) || ' ### Controller: ' || {ACT_SQL} AS spaced_text
    FROM transitions""", "transitions"))
def build_completion_only_text(i: Inputs) -> DataFrame:
    sft = episodes.build_sft_examples(i.transitions())
    args = F.lit(text.HALFCHEETAH_PROMPT), F.col("observation"), F.col("action")
    return sft.select("prompt_id", text.build_completion_only_text(*args).alias("text"),
                      text.build_completion_only_text(*args, spaced=True).alias("spaced_text"))


@query("split_completion_span", oracle(f"""
    SELECT prompt_id, '### User: ' || {_CHEETAH} || {OBS_SQL} || chr(10) || '### Controller:' AS prompt_part,
           ' ' || {ACT_SQL} AS completion_part, length(' ' || {ACT_SQL})::BIGINT AS completion_len,
           ' ' || {ACT_SQL} || chr(10) || '| ' || {ACT_SQL} AS spans
    FROM transitions""", "transitions"))
def split_completion_span(i: Inputs) -> DataFrame:
    sft = episodes.build_sft_examples(i.transitions())
    one = text.build_completion_only_text(F.lit(text.HALFCHEETAH_PROMPT), F.col("observation"), F.col("action"))
    rows = sft.select("prompt_id", one.alias("text"))
    turns = F.concat("text", F.lit("\n"), "text")
    return rows.select("prompt_id", text.split_completion_span(F.col("text")).alias("s"),
                       F.array_join(text.completion_spans(turns, "### User:"), "|").alias("spans")
                       ).select("prompt_id", "s.*", "spans")


_ENV_SQL = ("CASE event_type WHEN 'click' THEN 'CartPole-v1' WHEN 'view' THEN 'HalfCheetah-v4' "
            "WHEN 'error' THEN 'mujoco/halfcheetah/medium-v0' ELSE 'Hopper-v4' END")


@query("select_system_prompt", oracle(f"""
    SELECT prompt_id, CASE event_type WHEN 'click' THEN {_CART}
             WHEN 'view' THEN {literal(text.HALFCHEETAH_PROMPT)}
             WHEN 'error' THEN {literal(text.HALFCHEETAH_TOKEN_PROMPT)} END AS prompt,
           CASE event_type WHEN 'click' THEN {literal(text.CARTPOLE_EXAMPLE)}
             WHEN 'view' THEN {literal(text.HALFCHEETAH_EXAMPLE)}
             WHEN 'error' THEN {literal(text.HALFCHEETAH_TOKEN_EXAMPLE)} END AS example_action
    FROM transitions""", "transitions"))
def select_system_prompt(i: Inputs) -> DataFrame:
    rows = i.environments(i.transitions())
    chosen = text.select_system_prompt(F.col("env"), F.col("event_type") == "error")
    return rows.select("prompt_id", chosen.alias("s")).select("prompt_id", "s.*")


@query("render_prompt_template", oracle("""
    SELECT p_partkey, 'Part ' || p_name || ' of brand ' || p_brand || ', size ' || p_size || '.' AS prompt
    FROM part"""))
def render_prompt_template(i: Inputs) -> DataFrame:
    filled = text.render_prompt_template(
        F.lit("Part {{ name }} of brand {{brand}}, size {{ size }}."),
        {"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size").cast("string")})
    return i.table("part").select("p_partkey", filled.alias("prompt"))


# Environment descriptions, our own wording.
ENV_SPECS = [
    ("CartPole-v1", "A cart with a pole on a rail.", 4, ["cart position", "cart speed", "pole angle", "pole speed"],
     1, "push left or right", "keep the pole upright", "one point per step", "50 Hz"),
    ("HalfCheetah-v4", "A planar runner with two legs.", 17, ["body height", "body angle", "joint angles (6)",
     "body speeds (3)", "joint speeds (6)"], 6, "torque at each joint", "run forward",
     "forward speed minus effort", "20 Hz"),
    ("mujoco/halfcheetah/medium-v0", "Logged runs of the planar runner.", 17, ["body pose (8)", "speeds (9)"], 6,
     "torque at each joint", "run forward", "forward speed minus effort", "20 Hz"),
]


def env_specs(i: Inputs) -> DataFrame:
    return i.spark.createDataFrame(ENV_SPECS, schemas.ENV_SPEC)


def _env_prompt_sql() -> str:
    cases = []
    for env, desc, obs_dim, states, action_dim, action, task, reward, hz in ENV_SPECS:
        listed = ", ".join(f"{n + 1}. {s}" for n, s in enumerate(states))
        prompt = (f"Control task: {env}\nEnvironment: {desc}\nState ({obs_dim} values): {listed}\n"
                  f"Action ({action_dim} values): {action}\nGoal: {task}\nReward: {reward}\nFrequency: {hz}\n"
                  "Answer with numbers only, separated by commas.\nObservation: [OBSERVATION_PLACEHOLDER]")
        cases.append(f"WHEN {literal(env)} THEN {literal(prompt)}")
    return f"CASE {_ENV_SQL} {' '.join(cases)} END"


_REJECT_SQL = f"CASE WHEN {_env_prompt_sql()} IS NULL THEN 'unknown environment: ' || {_ENV_SQL} END"


@query("build_env_prompt", oracle(f"""
    SELECT prompt_id, {_env_prompt_sql()} AS prompt, {_REJECT_SQL} AS reject FROM transitions""", "transitions"))
def build_env_prompt(i: Inputs) -> DataFrame:
    specs = env_specs(i)
    prompts = specs.select("env", text.build_env_prompt({c: F.col(c) for c in specs.columns}).alias("prompt"))
    return align.attach_prompt_config(i.environments(i.transitions()), prompts).select("prompt_id", "prompt", "reject")


@query("fill_observation", oracle(f"""
    SELECT prompt_id, replace({_env_prompt_sql()}, '[OBSERVATION_PLACEHOLDER]',
                              '[' || {txt('observation', 5, ', ')} || ']') AS prompt, {_REJECT_SQL} AS reject
    FROM transitions""", "transitions"))
def fill_observation(i: Inputs) -> DataFrame:
    specs = env_specs(i)
    prompts = specs.select("env", text.build_env_prompt({c: F.col(c) for c in specs.columns}).alias("p"))
    rows = align.attach_prompt_config(i.environments(i.transitions()), prompts)
    return rows.select("prompt_id", text.fill_observation(F.col("p"), F.col("observation")).alias("prompt"), "reject")


@query("attach_prompt_config", oracle(f"""
    SELECT env, count(*) AS n_rows, CASE env WHEN 'CartPole-v1' THEN 4 WHEN 'Hopper-v4' THEN NULL ELSE 17 END AS obs_dim
    FROM (SELECT {_ENV_SQL} AS env FROM transitions) GROUP BY env""", "transitions"))
def attach_prompt_config(i: Inputs) -> DataFrame:
    rows = i.environments(i.transitions()).select("env")
    config = env_specs(i).select("env", "obs_dim")
    return align.attach_prompt_config(rows, config).groupBy("env").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("obs_dim").alias("obs_dim"))


@query("truncate_text", oracle("""
    SELECT doc_id, array_to_string(w[-12:], ' ') AS last_words, array_to_string(w[:12], ' ') AS first_words
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)"""))
def truncate_text(i: Inputs) -> DataFrame:
    return i.table("documents").select(
        "doc_id", text.truncate_text(F.col("text"), 12).alias("last_words"),
        text.truncate_text(F.col("text"), 12, keep="first").alias("first_words"))


_SHOTS = f"""
    SELECT env, string_agg('Example ' || r || ':' || chr(10) || '<observation> ' || obs || ' </observation>' || chr(10)
           || '<action> ' || act || ' </action>' || chr(10) || chr(10), '' ORDER BY r) AS blocks
    FROM (SELECT {_ENV_SQL} AS env, {txt('observation')} AS obs, {txt('action')} AS act,
                 row_number() OVER (PARTITION BY {_ENV_SQL} ORDER BY {hash_key(21, 'prompt_id')}, prompt_id) AS r
          FROM transitions) WHERE r <= 3 GROUP BY env"""


@query("append_few_shot_examples", oracle(f"""
    SELECT env, 'Control ' || env || '.' || chr(10) || blocks AS prompt FROM ({_SHOTS})""", "transitions"))
def append_few_shot_examples(i: Inputs) -> DataFrame:
    rows = i.environments(i.transitions()).select(
        "env", F.col("prompt_id").alias("id"), as_text("observation").alias("obs"), as_text("action").alias("action"))
    prompts = rows.select("env").distinct().select("env", F.format_string("Control %s.\n", "env").alias("prompt"))
    return episodes.append_few_shot_examples(prompts, rows, 3, seed=21)


@query("completion_text", oracle("""
    SELECT prompt_id, gen_id, completion AS from_text, '<action>' || completion AS from_chat
    FROM completions_discrete""", "completions_discrete"))
def completion_text(i: Inputs) -> DataFrame:
    rows = i.completions_discrete().withColumn("messages", F.array(F.struct(
        F.lit("assistant").alias("role"), F.col("completion").alias("content"))))
    return rows.select("prompt_id", "gen_id", parse.completion_text(F.col("completion")).alias("from_text"),
                       parse.completion_text(messages=F.col("messages"), add_action_tag=True).alias("from_chat"))


@query("model_short_name", oracle("SELECT url, split_part(split_part(url, '/final_model', 1), '/', 1) AS whole_label, "
       "'run' || page_id AS label FROM pages"))
def model_short_name(i: Inputs) -> DataFrame:
    pages = i.table("pages")
    path = F.concat(F.lit("models--org--run"), F.col("page_id").cast("string"), F.lit("/snapshots/final_model/"), "url")
    return pages.select("url", text.model_short_name(F.col("url")).alias("whole_label"),
                        text.model_short_name(path).alias("label"))


# --- quantisation and extraction -------------------------------------------------------------

@query("dim_ranges", oracle(f"""
    SELECT CASE WHEN pos <= {OBS_DIMS} THEN 'observation' WHEN pos <= {OBS_DIMS + ACT_DIMS} THEN 'action' ELSE 'output' END AS side,
           pos - 1 - CASE WHEN pos <= {OBS_DIMS} THEN 0 WHEN pos <= {OBS_DIMS + ACT_DIMS} THEN {OBS_DIMS} ELSE {OBS_DIMS + ACT_DIMS} END AS dim,
           min(x) AS lo, max(x) AS hi
    FROM (SELECT unnest(emb) AS x, generate_subscripts(emb, 1) AS pos FROM logged) GROUP BY pos""", "logged"))
def dim_ranges(i: Inputs) -> DataFrame:
    """Every component of the logged vectors: observation, action and what policies put out, in one pass."""
    width = i.table("embeddings").select(F.size("embedding").alias("n")).first()
    vectors = i.logged().select(F.col("embedding").cast("array<double>").alias("v"))
    found = stats.dim_ranges(vectors, "v", width["n"] if width else 0).select(F.posexplode("ranges").alias("at", "r"))
    at, first = F.col("at"), OBS_DIMS + ACT_DIMS
    return found.select(F.when(at < OBS_DIMS, "observation").when(at < first, "action").otherwise("output").alias("side"),
                        (at - F.when(at < OBS_DIMS, 0).when(at < first, OBS_DIMS).otherwise(first)).cast("bigint").alias("dim"),
                        F.col("r.min").alias("lo"), F.col("r.max").alias("hi"))


@query("apply_ranges", oracle("""
    SELECT prompt_id, pos - 1 AS dim, o.min AS lo, o.max AS hi FROM (
      SELECT prompt_id, unnest((SELECT ranges FROM obs_ranges)) AS o,
             generate_subscripts((SELECT ranges FROM obs_ranges), 1) AS pos FROM transitions)""",
    "transitions", "obs_ranges"))
def apply_ranges(i: Inputs) -> DataFrame:
    rows = _with_obs_ranges(i, i.transitions()).select("prompt_id", F.posexplode("ranges").alias("dim", "r"))
    return rows.select("prompt_id", F.col("dim").cast("bigint").alias("dim"), F.col("r.min").alias("lo"),
                       F.col("r.max").alias("hi"))


_TABLE_RANGES = "[" + ", ".join(f"{{'min': {lo}::DOUBLE, 'max': {hi}::DOUBLE}}"
                                for lo, hi in quantize.HALFCHEETAH_OBS_RANGES) + "]"


@query("quantize_obs", oracle(f"""
    SELECT prompt_id, array_to_string({TOKENS_SQL}, ' ') AS tokens,
           array_to_string({TOKENS_SQL.replace('(SELECT ranges FROM obs_ranges)', _TABLE_RANGES)}, ' ') AS table_tokens
    FROM transitions""", "transitions", "obs_ranges"))
def quantize_obs(i: Inputs) -> DataFrame:
    rows = _with_obs_ranges(i, i.transitions())
    fixed = quantize.ranges_literal(quantize.HALFCHEETAH_OBS_RANGES)

    def joined(ranges):
        return F.array_join(quantize.quantize_obs(F.col("observation"), ranges).cast("array<string>"), " ")
    return rows.select("prompt_id", joined(F.col("ranges")).alias("tokens"), joined(fixed).alias("table_tokens"))


TOKEN_LIST_SQL = "regexp_extract(completion, '^(\\d+(?:,\\s*\\d+)*)', 1)"
TOKENS_PARSED_SQL = f"list_transform(string_split({TOKEN_LIST_SQL}, ','), lambda x: TRY_CAST(trim(x) AS BIGINT))"
TOKENS_VALID_SQL = (f"({TOKEN_LIST_SQL} <> '' AND len(string_split({TOKEN_LIST_SQL}, ',')) = {ACT_DIMS} AND "
                    f"len(list_filter({TOKENS_PARSED_SQL}, lambda t: t > 999)) = 0)")
DECODED_SQL = (f"list_transform(list_zip({TOKENS_PARSED_SQL}, (SELECT ranges FROM action_ranges)), lambda p: "
               "p[2].min + (p[1] / 999::DOUBLE) * (p[2].max - p[2].min))")


@query("dequantize_action", oracle(f"""
    SELECT prompt_id, gen_id, CASE WHEN {TOKENS_VALID_SQL} THEN {txt(DECODED_SQL)} END AS action
    FROM completions_tokenized""", "completions_tokenized", "action_ranges"))
def dequantize_action(i: Inputs) -> DataFrame:
    rows = stats.apply_ranges(i.completions_tokenized(), stats.dim_ranges(i.transitions(), "action", ACT_DIMS))
    tokens = parse.tokens_of(F.col("completion"), parse.INTEGER_LIST, ACT_DIMS)
    return rows.select("prompt_id", "gen_id",
                       as_text(quantize.dequantize_action(tokens, F.col("ranges"))).alias("action"))


_LOOSE = "regexp_extract(completion, '^\\s*([-+]?\\d*\\.?\\d+(?:,\\s*[-+]?\\d*\\.?\\d+)*)', 1)"
_LOOSE_INT = "regexp_extract(completion, '^\\s*(\\d+(?:,\\s*\\d+)*)', 1)"
_CONTINUOUS_SQL = (f"CASE WHEN {_LOOSE} <> '' AND len(string_split({_LOOSE}, ',')) = {ACT_DIMS} THEN "
                   f"list_transform(string_split({_LOOSE}, ','), lambda x: CAST(trim(x) AS DOUBLE)) END")


@query("extract_action_continuous", oracle(f"""
    SELECT prompt_id, gen_id, {txt(_CONTINUOUS_SQL)} AS action FROM completions_continuous""",
    "completions_continuous"))
def extract_action_continuous(i: Inputs) -> DataFrame:
    return i.completions_continuous().select(
        "prompt_id", "gen_id", as_text(parse.extract_action_continuous(F.col("completion"), ACT_DIMS)).alias("action"))


@query("extract_action_tokenized", oracle(f"""
    SELECT prompt_id, gen_id,
           CASE WHEN {_LOOSE_INT} <> '' AND len(ts) = {ACT_DIMS} AND len(list_filter(ts, lambda t: t > 999)) = 0
                THEN {txt('list_transform(ts, lambda t: -1::DOUBLE + (t / 999::DOUBLE) * 2)')} END AS action
    FROM (SELECT *, list_transform(string_split({_LOOSE_INT}, ','), lambda x: TRY_CAST(trim(x) AS BIGINT)) AS ts
          FROM completions_tokenized)""", "completions_tokenized"))
def extract_action_tokenized(i: Inputs) -> DataFrame:
    return i.completions_tokenized().select(
        "prompt_id", "gen_id", as_text(parse.extract_action_tokenized(F.col("completion"), ACT_DIMS)).alias("action"))


@query("extract_action_discrete", oracle("""
    SELECT prompt_id, gen_id, CAST(nullif(regexp_extract(completion, '^([0-1])</action>', 1), '') AS INTEGER) AS action
    FROM completions_discrete""", "completions_discrete"))
def extract_action_discrete(i: Inputs) -> DataFrame:
    return i.completions_discrete().select(
        "prompt_id", "gen_id", parse.extract_action_discrete(F.col("completion"), 2).alias("action"))


_RAW_SQL = "'noise <action>' || completion || ', ' || completion"
_INNER_SQL = f"'<action> 0.5,' || split_part(split_part({_RAW_SQL}, '<action>', 2), '</action>', 1)"
_ITEMS_SQL = (f"list_transform(string_split({_INNER_SQL}, ',')[1:6], "
              "lambda x: regexp_replace(x, '[^0-9\\-.]', '', 'g'))")


@query("extract_action_lenient", oracle(f"""
    SELECT prompt_id, gen_id,
           CASE WHEN len(xs) <> 6 OR bad > 0 THEN NULL
                ELSE {txt('list_transform(xs, lambda x: TRY_CAST(x AS DOUBLE))')} END AS action,
           CASE WHEN len(xs) <> 6 THEN 'expected 6 values, got ' || len(xs)
                WHEN bad > 0 THEN 'not a number' END AS error
    FROM (SELECT *, len(list_filter(xs, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) AS bad
          FROM (SELECT prompt_id, gen_id, {_ITEMS_SQL} AS xs FROM (
                SELECT prompt_id, gen_id, replace(completion, '</action>', '') || ', 4' AS completion
                FROM completions_continuous)))""", "completions_continuous"))
def extract_action_lenient(i: Inputs) -> DataFrame:
    rows = i.completions_continuous().withColumn(
        "completion", F.concat(F.replace("completion", F.lit("</action>"), F.lit("")), F.lit(", 4")))
    raw = F.concat(F.lit("noise <action>"), "completion", F.lit(", "), "completion")
    found = rows.select("prompt_id", "gen_id", parse.extract_action_lenient(raw, "0.5,").alias("f"))
    return found.select("prompt_id", "gen_id", as_text("f.action").alias("action"), F.col("f.error").alias("error"))


@query("first_valid_attempt", oracle(f"""
    SELECT prompt_id, {txt('min_by(a, gen_id + 1) FILTER (a IS NOT NULL)')} AS action,
           (min(gen_id + 1) FILTER (a IS NOT NULL))::INTEGER AS tries, count(*) FILTER (a IS NOT NULL) = 0 AS failed
    FROM (SELECT prompt_id, gen_id, {_CONTINUOUS_SQL} AS a FROM completions_continuous WHERE gen_id + 1 <= 3)
    GROUP BY prompt_id""", "completions_continuous"))
def first_valid_attempt(i: Inputs) -> DataFrame:
    first = _first_valid(i)
    return first.select("prompt_id", as_text("action").alias("action"), "tries", "failed")


def _first_valid(i: Inputs) -> DataFrame:
    attempts = i.completions_continuous().withColumn("attempt", F.col("gen_id") + 1)
    return evaluate.first_valid_attempt(attempts, parse.extract_action_continuous(F.col("completion"), ACT_DIMS), tol=2)


@query("retry_stats", oracle(f"""
    SELECT {rnd('avg(tries)')} AS mean_tries, {rnd('stddev_pop(tries)')} AS std_tries,
           min(tries)::INTEGER AS min_tries, max(tries)::INTEGER AS max_tries
    FROM (SELECT prompt_id, min(gen_id + 1) FILTER (a IS NOT NULL) AS tries
          FROM (SELECT prompt_id, gen_id, {_CONTINUOUS_SQL} AS a FROM completions_continuous WHERE gen_id + 1 <= 3)
          GROUP BY prompt_id)""", "completions_continuous"))
def retry_stats(i: Inputs) -> DataFrame:
    return evaluate.retry_stats(_first_valid(i)).select(
        rounded("mean_tries").alias("mean_tries"), rounded("std_tries").alias("std_tries"), "min_tries", "max_tries")
