"""Logged transitions, completions and policy outputs derived from the input tables.

``events`` are steps (user = episode), ``embeddings`` give the vectors. An event uses the vector
whose number is event_id modulo the size of the embeddings table, so all of both tables is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import number_rows

GENERATIONS = 4
#: Widths of the vectors: where they start in an embedding follows from them.
OBS_DIMS, ACT_DIMS = 17, 6


@dataclass(frozen=True)
class Inputs:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _spread(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """Spread a table over all cores when its files have fewer parts than the cluster has cores.

        Large tables have parts enough and are not shuffled.
        """
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores, key) if self.table(name).rdd.getNumPartitions() < cores else df

    def logged(self, events: DataFrame | None = None) -> DataFrame:
        """Events (all of them, or rows made from them) with the embedding they refer to."""
        vectors = self.table("embeddings").withColumn("__there", F.lit(True))
        size = vectors.agg(F.count(F.lit(1)).alias("n"))
        events = self.table("events") if events is None else events
        events = events.withColumn("vec_id", F.pmod(F.col("event_id"), size.scalar()))
        joined = self._spread("events", events, "vec_id").join(self._spread("embeddings", vectors, "vec_id"), "vec_id", "left")
        missing = F.raise_error(F.concat(F.lit("no vector has vec_id "), F.col("vec_id").cast("string")))
        return joined.withColumn("embedding", F.when(F.col("__there"), F.col("embedding")).otherwise(missing)).drop("__there")

    def transitions(self) -> DataFrame:
        """Transitions without step numbers: no exchange beyond the vector join."""
        return _transition_columns(self.logged()).drop("ts")

    def numbered(self) -> DataFrame:
        """Events with their ``step`` inside the episode and the ``length`` of it; no vectors."""
        events = self.table("events").select("event_id", "ts", "user_id", "event_type", "value")
        return number_rows(events, ["user_id"], ["ts", "event_id"], "step", "length")

    def steps(self) -> DataFrame:
        """Transitions with their step number inside the episode: events are numbered before vectors are joined."""
        return _transition_columns(self.logged(self.numbered()), F.col("step")).drop("ts")

    def step_log(self) -> DataFrame:
        """Rewards of the steps of an episode, without vectors; ``done`` marks the last one."""
        return self.numbered().select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("prompt_id"), "step",
                                      F.col("value").alias("reward"), (F.col("step") == F.col("length") - 1).alias("done"))

    def rollouts(self) -> DataFrame:
        """Rewards of each episode, in no order; the episode's policy is one of four."""
        return self.table("events").select(
            F.pmod("user_id", F.lit(4)).alias("policy"), F.col("user_id").alias("episode_id"), F.col("value").alias("reward"))

    def metrics(self) -> DataFrame:
        """Validation curves: every hundred events form a run."""
        e = self.table("events")
        return e.select(F.floor(F.col("event_id") / 100).alias("run"), F.pmod("event_id", F.lit(100)).alias("epoch"),
                        F.col("value").alias("val_loss"))

    def policy_outputs(self) -> DataFrame:
        """Transitions with the outputs of a policy and a reference policy."""
        start = OBS_DIMS + ACT_DIMS + 1
        parts = [F.slice(F.col("embedding"), start + k * ACT_DIMS, size).cast("array<double>").alias(name)
                 for k, (name, size) in enumerate((("mean", ACT_DIMS), ("log_std", ACT_DIMS), ("ref_mean", ACT_DIMS),
                                                   ("ref_log_std", ACT_DIMS), ("logits", 2)))]
        return _transition_columns(self.logged(), *parts).drop("ts")

    def completions_discrete(self, *keep: str) -> DataFrame:
        """Four completions per prompt in ten text shapes, with the named transition columns."""
        a, k = F.col("action_disc").cast("string"), F.col("k")
        wrong = (1 - F.col("action_disc")).cast("string")
        end = F.lit("</action>")
        shape = (F.when(k == 0, F.concat(a, end)).when(k == 1, F.concat(wrong, end))
                 .when(k == 2, F.concat(a, F.lit("</action> ok"))).when(k == 3, F.lit("7</action>"))
                 .when(k == 4, F.lit("")).when(k == 5, a).when(k == 6, F.concat(a, end, end))
                 .when(k == 7, F.concat(F.lit(" "), a, end)).when(k == 8, F.concat(a, end))
                 .otherwise(F.lit("go left</action>")))
        return _generated(self.transitions()).select("prompt_id", "gen_id", *keep, shape.alias("completion"))

    def completions_continuous(self, *keep: str) -> DataFrame:
        from ..functions.numbers import fixed
        rows = _generated(self.transitions()).withColumn(
            "v", F.transform("action", lambda x: fixed(x + F.col("gen_id") * F.lit(0.125))))
        v, k, end = F.col("v"), F.col("k"), F.lit("</action>")
        joined = F.array_join(v, ",")
        shape = (F.when(k == 1, F.concat(v[0], F.lit(","), v[1], end))
                 .when(k == 2, F.concat(joined, F.lit("</action> done")))
                 .when(k == 3, F.lit("1,2,3</action>")).when(k == 4, F.lit("")).when(k == 5, joined)
                 .when(k == 6, F.concat(joined, end, end))
                 .when(k == 7, F.concat(F.lit(" "), F.array_join(v, ", "), end)).when(k == 9, F.lit("nan</action>"))
                 .otherwise(F.concat(joined, end)))
        return rows.select("prompt_id", "gen_id", *keep, shape.alias("completion"))

    def completions_tokenized(self, *keep: str) -> DataFrame:
        rows = _generated(self.transitions()).withColumn("v", F.transform(
            F.array(*[F.lit(d) for d in range(ACT_DIMS)]),
            lambda j: ((F.col("prompt_id") * 31 + F.col("gen_id") * 17 + j * 101) % 1000).cast("string")))
        v, k, end = F.col("v"), F.col("k"), F.lit("</action>")
        joined = F.array_join(v, ",")
        shape = (F.when(k == 1, F.concat(v[0], F.lit(","), v[1], end))
                 .when(k == 2, F.concat(joined, F.lit("</action> done")))
                 .when(k == 3, F.lit("1500,1,2</action>")).when(k == 4, F.lit("")).when(k == 5, joined)
                 .when(k == 6, F.concat(F.array_join(v, ", "), end, end))
                 .when(k == 7, F.concat(F.lit(" "), joined, end)).when(k == 9, F.lit("-5,1,2</action>"))
                 .otherwise(F.concat(joined, end)))
        return rows.select("prompt_id", "gen_id", *keep, shape.alias("completion"))

    def countdown(self) -> DataFrame:
        """Arithmetic answers: right, wrong target, number missing, bad character, no tag, zero division."""
        p = self.table("part").select(F.col("p_partkey").alias("item_id"),
                                      (F.col("p_partkey") % 9 + 1).cast("int").alias("a"),
                                      (F.col("p_size") % 9 + 1).cast("int").alias("b"))
        a, b = F.col("a").cast("string"), F.col("b").cast("string")
        k = (F.col("item_id") % 6).cast("int")
        text = (F.when(k == 2, F.concat(F.lit("<answer>"), a, F.lit("+"), b, F.lit("</answer>")))
                .when(k == 3, F.concat(F.lit("<answer>"), a, F.lit("+"), b, F.lit("*3=x</answer>")))
                .when(k == 4, F.concat(a, F.lit("+"), b, F.lit("*3")))
                .when(k == 5, F.concat(F.lit("<answer>("), a, F.lit("+"), b, F.lit(")/(3-3)</answer>")))
                .otherwise(F.concat(F.lit("go</think> <answer> "), a, F.lit(" + "), b, F.lit("*3 </answer>"))))
        target = (F.col("a") + F.col("b") * 3 + F.when(k == 1, 1).otherwise(0)).cast("double")
        three = F.lit(3)
        nums = F.when(k == 5, F.array("a", "b", three, three)).otherwise(F.array("a", "b", three))
        return p.select("item_id", text.alias("completion"), target.alias("target"), nums.alias("nums"))

    def environments(self, rows: DataFrame) -> DataFrame:
        """Name the environment of each transition by its event type."""
        kind = F.col("event_type")
        return rows.withColumn("env", F.when(kind == "click", "CartPole-v1").when(kind == "view", "HalfCheetah-v4")
                               .when(kind == "error", "mujoco/halfcheetah/medium-v0").otherwise("Hopper-v4"))


def _transition_columns(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(
        F.col("user_id").alias("episode_id"), F.col("event_id").alias("prompt_id"), "ts", "event_type",
        F.slice("embedding", 1, OBS_DIMS).cast("array<double>").alias("observation"),
        F.slice("embedding", OBS_DIMS + 1, ACT_DIMS).cast("array<double>").alias("action"),
        (F.col("label") % 2).cast("int").alias("action_disc"), F.col("value").alias("reward"), *more)


def _generated(transitions: DataFrame) -> DataFrame:
    return transitions.withColumn("gen_id", F.explode(F.sequence(F.lit(0), F.lit(GENERATIONS - 1)))).withColumn(
        "k", (F.col("prompt_id") * 7 + F.col("gen_id") * 3) % 10)
