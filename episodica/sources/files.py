"""Readers and writers."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..functions.parse import completion_text
from ..operators import stats as statistics
from ..operators.sampling import bernoulli_sample, random_sample_n

SEPARATOR = "=============="  # fixed value: line between logged samples


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EPISODE).parquet(path)


def write_episodes(episodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    episodes.select(*schemas.EPISODE.fieldNames()).write.mode(mode).parquet(path)


def read_sft_jsonl(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """JSON lines when the path ends in .json, else a Parquet data set with a ``split`` column."""
    if path.endswith(".json"):
        return spark.read.schema(schemas.SFT).json(path)
    return spark.read.parquet(path).where(F.col("split") == split).select("observation", "action")


def sft_file_name(dataset_id: str, n_episodes: int) -> str:
    return f"{dataset_id.replace('/', '_')}_{n_episodes}.json"


def write_sft_jsonl(examples: DataFrame, root: str, dataset_id: str, n_episodes: int, mode: str = "append") -> str:
    """One JSON object per transition. Appending again repeats the rows; ``overwrite`` replaces them."""
    path = os.path.join(root, sft_file_name(dataset_id, n_episodes))
    examples.select("observation", "action").write.mode(mode).json(path)
    return path


def _sample_text(response: Column) -> Column:
    return F.concat(F.lit(f"\n{SEPARATOR}\n"), response)


def completion_samples(completions: DataFrame, fraction: float = 0.1, seed: int = 0, add_action_tag: bool = False,
                       row_id: tuple[str, ...] = ("prompt_id", "gen_id"), column: str = "completion") -> DataFrame:
    """The sampled responses that ``write_completion_samples`` logs."""
    kept = bernoulli_sample(completions, row_id, fraction, seed)
    return kept.withColumn("response", completion_text(F.col(column), add_action_tag=add_action_tag))


def write_completion_samples(completions: DataFrame, path: str, **options) -> None:
    """Append a random share of responses to a text log, each under a separator line."""
    samples = completion_samples(completions, **options)
    samples.select(_sample_text(F.col("response")).alias("value")).write.mode("append").text(path)


def success_samples(scored: DataFrame, fraction: float = 0.1, seed: int = 0, row_id: str = "item_id") -> DataFrame:
    """A random share of the fully correct equation completions, as they are logged."""
    kept = bernoulli_sample(scored.where(F.col("reward") == 1.0), row_id, fraction, seed)
    return kept.withColumn("response", F.concat(F.lit("<think>"), "completion"))


def write_success_samples(scored: DataFrame, path: str, **options) -> None:
    samples = success_samples(scored, **options)
    samples.select(_sample_text(F.col("response")).alias("value")).write.mode("append").text(path)


def eval_log_pairs(evaluated: DataFrame, responses: DataFrame, n: int, seed: int, row_id: str = "prompt_id") -> DataFrame:
    """n random evaluation rows as (id, query, response); responses are joined by id."""
    picked = random_sample_n(evaluated, row_id, n, seed)
    queries = picked.select(row_id, text.chat_query(F.col("messages")).alias("query"))
    wanted = responses.select(row_id, "response").join(F.broadcast(queries.select(row_id)), row_id, "left_semi")  # n ids
    return queries.join(wanted, row_id, "left")


def write_eval_log(pairs: DataFrame, path: str) -> None:
    line = F.concat(F.lit("Query: "), "query", F.lit("\nResponse: "), F.coalesce("response", F.lit("")), F.lit("\n"))
    pairs.select(line.alias("value")).write.mode("append").text(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "append") -> None:
    """(run, tag, step, value) rows, one folder per tag. ``path`` takes few distinct tags."""
    metrics.write.mode(mode).partitionBy("tag").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRIC).parquet(path).select(*schemas.METRIC.fieldNames())


def save_by_prompt(rows: DataFrame, table: str, buckets: int, path: str | None = None, key: str = "prompt_id") -> None:
    """Keep a table in ``buckets`` buckets of its prompts, sorted: tables kept with one number of buckets join, and group by
    prompt, without an exchange in every later job. ``path`` puts the files elsewhere than the warehouse.

    Each bucket is dealt to one task before it is written, so it is one file. Choose buckets for the larger table: about a
    file of 256 MB each.
    """
    writer = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").mode("overwrite")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def save_stats(stats: DataFrame, path: str) -> None:
    """The one-row statistics frame."""
    stats.coalesce(1).write.mode("overwrite").parquet(path)


def add_moments(moments: DataFrame, path: str) -> None:
    """Append the moments of further rows to a statistics file; ``refreshed_stats`` reads them all."""
    moments.coalesce(1).write.mode("append").parquet(path)


def refreshed_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of all rows whose moments were ever added; no earlier row is read again."""
    return statistics.stats_of_moments(statistics.merged_moments(spark.read.parquet(path)))


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    stats = spark.read.parquet(path)
    missing = {"state_mean", "state_std", "action_mean", "action_std", "reward_mean", "reward_std"} - set(stats.columns)
    if missing:
        raise ValueError(f"statistics lack {sorted(missing)}")
    return stats
