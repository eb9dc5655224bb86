"""Episodes and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import order_key
from .sampling import head_rows, random_sample_n
from .skew import number_rows

SEGMENT_STEPS = 10_000


def flatten_episodes(episodes: DataFrame) -> DataFrame:
    """One row per step; the terminal observation is dropped. ``first_step`` numbers the steps of a continued episode."""
    steps = F.arrays_zip(
        F.expr("slice(observations, 1, size(observations) - 1)").alias("observation"),
        F.col("actions").alias("action"), F.col("rewards").alias("reward"))
    base = F.coalesce(F.col("first_step"), F.lit(0)) if "first_step" in episodes.columns else F.lit(0)
    return (episodes.select("episode_id", base.alias("__base"), F.posexplode(steps).alias("__pos", "__s"))
            .select("episode_id", (F.col("__base") + F.col("__pos")).cast("bigint").alias("step"),
                    F.col("__s.observation").alias("observation"), F.col("__s.action").alias("action"),
                    F.col("__s.reward").alias("reward")))


def assemble_episodes(transitions: DataFrame, segment_steps: int = SEGMENT_STEPS) -> DataFrame:
    """Ordered transitions to episode arrays with T+1 observations.

    A row holds at most ``segment_steps`` steps; an episode continues in further rows, numbered by ``segment``, with the
    number of its ``first_step``. The last observation of a row is the first one of the row that follows, and at the end
    of the episode the last one again, as the log has no later one.
    """
    row = F.struct("step", "observation", "action", "reward")
    segment = F.floor(F.col("step") / segment_steps)
    packed = (transitions.groupBy("episode_id", segment.alias("segment")).agg(F.array_sort(F.collect_list(row)).alias("s")))
    following = transitions.where((F.col("step") % segment_steps == 0) & (F.col("step") > 0)).select(
        "episode_id", (segment - 1).alias("segment"), F.col("observation").alias("__next"))
    packed = packed.join(following, ["episode_id", "segment"], "left")
    observations = F.transform("s", lambda x: x["observation"])
    return packed.select(
        "episode_id", "segment", F.col("s")[0]["step"].alias("first_step"),
        F.array_append(observations, F.coalesce("__next", F.element_at(observations, -1))).alias("observations"),
        F.transform("s", lambda x: x["action"]).alias("actions"),
        F.transform("s", lambda x: x["reward"]).alias("rewards"))


def concat_episodes(*frames: DataFrame) -> DataFrame:
    """Bag union of the transitions of several data sets."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def step_index(log: DataFrame, order: list[str]) -> DataFrame:
    """Number the steps of each episode from 0."""
    return number_rows(log, ["episode_id"], order, "step")


def running_return(steps: DataFrame, bucket_steps: int = SEGMENT_STEPS) -> DataFrame:
    """Return so far at each step: a running sum inside step buckets plus the sum of earlier buckets."""
    from pyspark.sql import Window

    bucketed = steps.withColumn("__b", F.floor(F.col("step") / bucket_steps))
    before = Window.partitionBy("episode_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (bucketed.groupBy("episode_id", "__b").agg(F.sum("reward").alias("__r"))
               .select("episode_id", "__b", F.coalesce(F.sum("__r").over(before), F.lit(0.0)).alias("__before")))
    inside = (Window.partitionBy("episode_id", "__b").orderBy("step")
              .rowsBetween(Window.unboundedPreceding, 0))
    return (bucketed.join(offsets, ["episode_id", "__b"])
            .withColumn("running_return", F.sum("reward").over(inside) + F.col("__before"))
            .drop("__b", "__before"))


def build_sft_examples(transitions: DataFrame) -> DataFrame:
    """Tagged observation and action text of each transition; other columns are kept."""
    return transitions.withColumns({"observation": text.obs_to_prompt(F.col("observation")),
                                    "action": text.action_to_prompt(F.col("action"))})


def log_every_k(steps: DataFrame, k: int = 250) -> DataFrame:
    """Steps whose number is a multiple of k, the first step included, with ``%.4f`` text."""
    shown = steps.where(F.col("step") % k == 0)
    return shown.withColumns({"obs_text": F.array_join(text.log_line(F.col("observation")), ", "),
                              "action_text": F.array_join(text.log_line(F.col("action")), ", ")})


def action_dim_series(steps: DataFrame, action: str | None = "action", value: str | None = None) -> DataFrame:
    """One (tag, step, value) row per step and action dimension, and one for the scalar ``value``, from one pass.

    Episodes are shown from 1 and steps are counted after the environment moved, so step + 1.
    """
    ep = F.concat(F.lit("action/ep_"), (F.col("episode_id") + 1).cast("string"))

    def point(tag: Column, x: Column) -> Column:
        return F.struct(tag.alias("tag"), x.cast("double").alias("value"))

    series = []
    if action is not None:
        series.append(F.transform(action, lambda x, dim: point(F.concat(F.lit("/dim_"), dim.cast("string")), x)))
    if value is not None:
        series.append(F.array(point(F.lit("/value"), F.col(value))))
    return (steps.select(ep.alias("__ep"), (F.col("step") + 1).cast("bigint").alias("step"), F.explode(F.concat(*series)).alias("__p"))
            .select(F.concat("__ep", "__p.tag").alias("tag"), "step", F.col("__p.value").alias("value")))


def sample_episodes(transitions: DataFrame, n: int, seed: int) -> DataFrame:
    """All rows of n episodes drawn without replacement."""
    ids = transitions.select("episode_id").distinct()
    chosen = random_sample_n(ids, "episode_id", n, seed)
    return transitions.join(chosen, "episode_id", "left_semi")


def take_episodes(transitions: DataFrame, k: int) -> DataFrame:
    """Episodes in order up to index k: the check comes after use, so k + 1 episodes."""
    ids = transitions.select("episode_id").distinct()
    chosen = head_rows(ids, k + 1, "episode_id")
    return transitions.join(chosen, "episode_id", "left_semi")


def infer_dims(df: DataFrame, columns: dict[str, str], strict: bool = False) -> DataFrame:
    """Width of each vector column by output name; NULL (or an error) when rows differ."""
    def width(column: str) -> Column:
        lo, hi = F.min(F.size(column)), F.max(F.size(column))
        uneven = F.raise_error(F.lit(f"{column}: rows differ in length")).cast("int") if strict else F.lit(None)
        return F.when(lo == hi, hi).otherwise(uneven)
    return df.agg(*[width(column).alias(name) for name, column in columns.items()])


def append_few_shot_examples(prompts: DataFrame, examples: DataFrame, n: int, seed: int) -> DataFrame:
    """Append n numbered example blocks per environment to its prompt.

    ``prompts``: env, prompt. ``examples``: env, id, obs, action (text). The n examples of an
    environment are its smallest order keys, kept by a bounded aggregate.
    """
    keyed = examples.select("env", F.struct(order_key(seed, F.col("id")).alias("key"), "id", "obs", "action").alias("e"))
    # Salting first: each salt keeps n, then the salts of an environment are merged.
    salted = keyed.withColumn("__salt", F.substring("e.key", 1, 2))
    from pyspark.sql import Window

    def keep(frame: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("e.key", "e.id"))
        return frame.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")

    best = keep(keep(salted, "env", "__salt"), "env")
    blocks = best.groupBy("env").agg(F.array_sort(F.collect_list("e")).alias("es"))  # n rows per env
    lines = F.array_join(F.transform("es", lambda e, i: F.concat(
        F.lit("Example "), (i + 1).cast("string"), F.lit(":\n<observation> "), e["obs"],
        F.lit(" </observation>\n<action> "), e["action"], F.lit(" </action>\n\n"))), "")
    joined = prompts.join(blocks, "env", "left")
    return joined.select("env", F.concat("prompt", F.coalesce(lines, F.lit(""))).alias("prompt"))
