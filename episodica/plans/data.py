"""Sources, sinks, episodes and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.equation import reward_equation
from ..operators import align, episodes, evaluate, sampling, stats
from ..session import scratch_dir
from ..sources import files
from ..sources.tables import ACT_DIMS, OBS_DIMS, Inputs
from .registry import as_text, hash_key, hash_uniform, literal, oracle, query, rnd, rounded, txt

_SFT = f"""SELECT '<observation>' || {txt('observation')} || '</observation>' AS observation,
                  '<action>' || {txt('action')} || '</action>' AS action FROM transitions"""
_EPISODES = f"""
    SELECT episode_id, CAST(0 AS BIGINT) AS segment, count(*) + 1 AS n_obs, count(*) AS n_actions,
           {rnd('sum(reward)', 4)} AS reward_sum,
           {txt('max_by(observation, step)')} AS last_observation, {txt('min_by(action, step)')} AS first_action
    FROM transitions GROUP BY episode_id"""


def _episode_digest(packed: DataFrame) -> DataFrame:
    return packed.select(
        "episode_id", "segment", F.size("observations").cast("bigint").alias("n_obs"),
        F.size("actions").cast("bigint").alias("n_actions"),
        rounded(F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x), 4).alias("reward_sum"),
        as_text(F.element_at("observations", -1)).alias("last_observation"),
        as_text(F.element_at("actions", 1)).alias("first_action"))


@query("assemble_episodes", oracle(_EPISODES, "transitions"))
def assemble_episodes(i: Inputs) -> DataFrame:
    return _episode_digest(episodes.assemble_episodes(i.steps()))


@query("read_episodes", oracle(_EPISODES, "transitions"))
def read_episodes(i: Inputs) -> DataFrame:
    path = scratch_dir(i.spark, "episodes")
    files.write_episodes(episodes.assemble_episodes(i.steps()), path)
    return _episode_digest(files.read_episodes(i.spark, path))


@query("flatten_episodes", oracle(f"""
    SELECT episode_id, step, {txt('observation')} AS observation, {txt('action')} AS action, reward
    FROM transitions""", "transitions"))
def flatten_episodes(i: Inputs) -> DataFrame:
    flat = episodes.flatten_episodes(episodes.assemble_episodes(i.steps()))
    return flat.select("episode_id", "step", as_text("observation").alias("observation"),
                       as_text("action").alias("action"), "reward")


@query("read_sft_jsonl", oracle(_SFT, "transitions"))
def read_sft_jsonl(i: Inputs) -> DataFrame:
    path = files.write_sft_jsonl(episodes.build_sft_examples(i.transitions()), scratch_dir(i.spark, "sft"),
                                 "mujoco/halfcheetah/medium-v0", 5)
    return files.read_sft_jsonl(i.spark, path)


@query("write_sft_jsonl", oracle(
    f"SELECT observation, action, count(*) AS n FROM ({_SFT}) GROUP BY observation, action", "transitions"))
def write_sft_jsonl(i: Inputs) -> DataFrame:
    path = files.write_sft_jsonl(episodes.build_sft_examples(i.transitions()), scratch_dir(i.spark, "sft"),
                                 "cartpole/expert-v0", 112)
    return files.read_sft_jsonl(i.spark, path).groupBy("observation", "action").agg(F.count(F.lit(1)).alias("n"))


@query("write_completion_samples", oracle(f"""
    SELECT '<action>' || completion AS line, count(*) AS n FROM completions_discrete
    WHERE {hash_uniform(11, 'prompt_id', 'gen_id')} < 0.1 GROUP BY line""", "completions_discrete"))
def write_completion_samples(i: Inputs) -> DataFrame:
    path = scratch_dir(i.spark, "completion-samples")
    files.write_completion_samples(i.completions_discrete(), path, seed=11, add_action_tag=True)
    lines = i.spark.read.text(path).select(F.col("value").alias("line"))
    return lines.where(~F.col("line").isin("", files.SEPARATOR)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("write_success_samples", oracle(f"""
    SELECT '<think>' || completion AS line, count(*) AS n FROM countdown
    WHERE item_id % 6 IN (0, 1) AND abs(a + b * 3 - target) < 1e-5 AND {hash_uniform(12, 'item_id')} < 0.1 GROUP BY line""", "countdown"))
def write_success_samples(i: Inputs) -> DataFrame:
    scored = i.countdown().withColumn("reward", reward_equation(
        F.col("completion"), F.col("target"), F.col("nums")))
    path = scratch_dir(i.spark, "success-samples")
    files.write_success_samples(scored, path, seed=12)
    lines = i.spark.read.text(path).select(F.col("value").alias("line"))
    return lines.where(~F.col("line").isin("", files.SEPARATOR)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("eval_log_pairs", oracle(f"""
    SELECT t.prompt_id, {literal(text.HALFCHEETAH_PROMPT)} || '<observation>' || {txt('t.observation')}
           || '</observation>' AS query, c.completion AS response
    FROM (SELECT * FROM transitions ORDER BY {hash_key(13, 'prompt_id')} LIMIT 50) t
    LEFT JOIN completions_continuous c ON c.prompt_id = t.prompt_id AND c.gen_id = 0""",
    "transitions", "completions_continuous"))
def eval_log_pairs(i: Inputs) -> DataFrame:
    examples = episodes.build_sft_examples(i.transitions())
    evaluated = examples.select("prompt_id", text.build_chat_messages(
        F.lit(text.HALFCHEETAH_PROMPT), F.col("observation"), F.col("action")).alias("messages"))
    responses = i.completions_continuous().where("gen_id = 0").withColumnRenamed("completion", "response")
    return files.eval_log_pairs(evaluated, responses, 50, seed=13)


@query("write_metrics", oracle(f"""
    SELECT CAST(run AS VARCHAR) AS run, tag, epoch AS step, {rnd('value', 4)} AS value
    FROM (SELECT run, epoch, 'Loss/Val' AS tag, val_loss AS value FROM metrics
          UNION ALL SELECT run, epoch, 'Loss/Train', val_loss / 2 FROM metrics)""", "metrics"))
def write_metrics(i: Inputs) -> DataFrame:
    wide = i.metrics().withColumns({"Loss/Val": F.col("val_loss"), "Loss/Train": F.col("val_loss") / 2})
    path = scratch_dir(i.spark, "metrics")
    files.write_metrics(evaluate.to_metric_rows(wide, "run", "epoch", ["Loss/Val", "Loss/Train"]), path)
    return files.read_metrics(i.spark, path).select("run", "tag", "step", rounded("value", 4).alias("value"))


_STATS = f"""SELECT {txt('state_mean', 4)} AS state_mean, {txt('state_std', 4)} AS state_std,
                    {txt('action_mean', 4)} AS action_mean, {txt('action_std', 4)} AS action_std,
                    {rnd('reward_mean', 4)} AS reward_mean, {rnd('reward_std', 4)} AS reward_std FROM norm_stats"""


def stats_digest(one_row: DataFrame) -> DataFrame:
    vectors = [as_text(c, 4).alias(c) for c in ("state_mean", "state_std", "action_mean", "action_std")]
    return one_row.select(*vectors, rounded("reward_mean", 4).alias("reward_mean"),
                          rounded("reward_std", 4).alias("reward_std"))


def fitted_stats(i: Inputs) -> DataFrame:
    return stats.normalization_stats(i.transitions(), state_dim=OBS_DIMS, action_dim=ACT_DIMS)


def with_stats(i: Inputs, rows: DataFrame) -> DataFrame:
    """Rows with the statistics of all transitions as the struct column ``stats``."""
    return align.attach_scalar(rows, fitted_stats(i).select(F.struct("*")), "stats")


@query("normalization_stats", oracle(_STATS, "norm_stats"))
def normalization_stats(i: Inputs) -> DataFrame:
    return stats_digest(fitted_stats(i))


@query("save_stats", oracle(_STATS, "norm_stats"))
def save_stats(i: Inputs) -> DataFrame:
    """Statistics kept as moments, refreshed as three parts of the log come in, and saved as the row that models load."""
    path = scratch_dir(i.spark, "stats")
    log = i.transitions()
    for part in range(3):
        files.add_moments(stats.moments(log.where(F.col("prompt_id") % 3 == part), OBS_DIMS, ACT_DIMS), f"{path}/moments")
    files.save_stats(files.refreshed_stats(i.spark, f"{path}/moments"), f"{path}/stats")
    return stats_digest(files.load_stats(i.spark, f"{path}/stats"))


@query("load_stats", oracle(f"""
    SELECT prompt_id, {rnd('(reward - n.reward_mean) / (n.reward_std + 1e-8::DOUBLE)', 5)} AS reward_z
    FROM transitions, norm_stats n""", "transitions", "norm_stats"))
def load_stats(i: Inputs) -> DataFrame:
    path = scratch_dir(i.spark, "stats")
    files.save_stats(fitted_stats(i), path)
    one_row = files.load_stats(i.spark, path)
    rows = i.transitions().withColumn("s", one_row.select(F.struct("reward_mean", "reward_std")).scalar())
    z = (F.col("reward") - F.col("s.reward_mean")) / (F.col("s.reward_std") + 1e-8)
    return rows.select("prompt_id", rounded(z, 5).alias("reward_z"))


@query("build_sft_examples", oracle(_SFT.replace("SELECT", "SELECT prompt_id,", 1), "transitions"))
def build_sft_examples(i: Inputs) -> DataFrame:
    return episodes.build_sft_examples(i.transitions()).select("prompt_id", "observation", "action")


@query("infer_dims", oracle("""
    SELECT CASE WHEN min(len(embedding)) = max(len(embedding)) THEN max(len(embedding))::INTEGER END AS obs_dim,
           (SELECT CASE WHEN min(n) = max(n) THEN max(n)::INTEGER END
            FROM (SELECT len(string_split(text, ' ')) AS n FROM conversations)) AS words
    FROM embeddings"""))
def infer_dims(i: Inputs) -> DataFrame:
    """The width of the vectors as they are in the table, and that of the turns' words, which differ: no width."""
    vectors = episodes.infer_dims(i.table("embeddings"), {"obs_dim": "embedding"})
    turns = i.table("conversations").select(F.split("text", " ").alias("words"))
    return vectors.withColumn("words", episodes.infer_dims(turns, {"words": "words"}).scalar())


@query("step_index", oracle(f"""
    SELECT prompt_id, step, {rnd('sum(reward) OVER (PARTITION BY episode_id ORDER BY step)', 4)} AS running_return
    FROM transitions""", "transitions"))
def step_index(i: Inputs) -> DataFrame:
    return episodes.running_return(i.step_log()).select("prompt_id", "step",
                                                     rounded("running_return", 4).alias("running_return"))


@query("log_every_k", oracle(f"""
    SELECT episode_id, step, {txt('observation', 4, ', ')} AS obs_text, {txt('action', 4, ', ')} AS action_text
    FROM transitions WHERE step % 25 = 0""", "transitions"))
def log_every_k(i: Inputs) -> DataFrame:
    return episodes.log_every_k(i.steps(), 25).select("episode_id", "step", "obs_text", "action_text")


@query("action_dim_series", oracle(f"""
    SELECT 'action/ep_' || (episode_id + 1) || '/dim_' || (pos - 1) AS tag, step + 1 AS step, {rnd('x')} AS value
    FROM (SELECT episode_id, step, unnest(action) AS x, generate_subscripts(action, 1) AS pos FROM transitions)
    UNION ALL
    SELECT 'action/ep_' || (episode_id + 1) || '/value', step + 1, action_disc::DOUBLE FROM transitions""",
    "transitions"))
def action_dim_series(i: Inputs) -> DataFrame:
    both = episodes.action_dim_series(i.steps(), "action", "action_disc")
    return both.select("tag", "step", rounded("value").alias("value"))


@query("sample_episodes", oracle(f"""
    SELECT prompt_id, episode_id, reward FROM transitions WHERE episode_id IN
      (SELECT episode_id FROM (SELECT DISTINCT episode_id FROM transitions)
       ORDER BY {hash_key(42, 'episode_id')} LIMIT 20)""", "transitions"))
def sample_episodes(i: Inputs) -> DataFrame:
    return episodes.sample_episodes(i.transitions(), 20, seed=42).select("prompt_id", "episode_id", "reward")


@query("take_episodes", oracle("""
    SELECT prompt_id, episode_id, reward FROM transitions WHERE episode_id IN
      (SELECT episode_id FROM (SELECT DISTINCT episode_id FROM transitions) ORDER BY episode_id LIMIT 6)""",
    "transitions"))
def take_episodes(i: Inputs) -> DataFrame:
    return episodes.take_episodes(i.transitions(), 5).select("prompt_id", "episode_id", "reward")


@query("head_rows", oracle("""
    SELECT prompt_id, episode_id, reward FROM transitions ORDER BY prompt_id LIMIT 200""", "transitions"))
def head_rows(i: Inputs) -> DataFrame:
    return sampling.head_rows(i.transitions(), 200, "prompt_id").select("prompt_id", "episode_id", "reward")


@query("dataset_size", oracle("""
    SELECT count(*) AS n_rows, least(count(*), 20000)::BIGINT AS effective_size FROM transitions""", "transitions"))
def dataset_size(i: Inputs) -> DataFrame:
    return stats.dataset_size(i.transitions(), 20_000)


@query("concat_episodes", oracle("""
    SELECT source, count(*) AS n_steps, round(sum(reward), 3) AS reward_sum
    FROM (SELECT 'events' AS source, reward FROM transitions
          UNION ALL SELECT 'lineitem', l_quantity FROM lineitem) GROUP BY source""", "transitions"))
def concat_episodes(i: Inputs) -> DataFrame:
    first = i.transitions().select(F.lit("events").alias("source"), "reward")
    second = i.table("lineitem").select(F.lit("lineitem").alias("source"), F.col("l_quantity").alias("reward"))
    return episodes.concat_episodes(first, second).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_steps"), F.round(F.sum("reward"), 3).alias("reward_sum"))


@query("distinct_actions", oracle("SELECT DISTINCT action_disc FROM transitions ORDER BY 1", "transitions"))
def distinct_actions(i: Inputs) -> DataFrame:
    return stats.distinct_actions(i.transitions(), "action_disc")


@query("count_distinct_actions", oracle("SELECT count(DISTINCT action_disc) AS n_actions FROM transitions",
                                        "transitions"))
def count_distinct_actions(i: Inputs) -> DataFrame:
    return stats.count_distinct_actions(i.transitions(), "action_disc")


@query("min_reward", oracle("SELECT min(reward) AS min_reward FROM transitions", "transitions"))
def min_reward(i: Inputs) -> DataFrame:
    return stats.min_reward(i.transitions())
