"""Readers, writers and streaming jobs on small files."""

import pytest
from pyspark.sql import functions as F

from episodica.functions import rewards
from episodica.operators import align, evaluate, stats
from episodica.sources import files
from episodica.streaming import completions


def test_jsonl_append_repeats_and_overwrite_replaces(spark, tmp_path):
    rows = spark.createDataFrame([("<observation>1</observation>", "<action>2</action>")], "observation string, action string")
    path = files.write_sft_jsonl(rows, str(tmp_path), "mujoco/halfcheetah/expert-v0", 5)
    assert path.endswith("mujoco_halfcheetah_expert-v0_5.json")
    files.write_sft_jsonl(rows, str(tmp_path), "mujoco/halfcheetah/expert-v0", 5)
    assert files.read_sft_jsonl(spark, path).count() == 2
    files.write_sft_jsonl(rows, str(tmp_path), "mujoco/halfcheetah/expert-v0", 5, mode="overwrite")
    assert files.read_sft_jsonl(spark, path).collect() == rows.collect()


def test_named_data_set_reads_one_split(spark, tmp_path):
    path = str(tmp_path / "set")
    spark.createDataFrame([("a", "b", "train"), ("c", "d", "test")],
                          "observation string, action string, split string").write.parquet(path)
    assert [tuple(r) for r in files.read_sft_jsonl(spark, path, "test").collect()] == [("c", "d")]


def test_statistics_file_needs_all_fields(spark, tmp_path):
    path = str(tmp_path / "stats")
    spark.range(1).write.parquet(path)
    with pytest.raises(ValueError, match="statistics lack"):
        files.load_stats(spark, path)


def test_metrics_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([(1, 0, 0.5, 0.25)], "run int, epoch int, `Loss/Val` double, `Loss/Train` double")
    path = str(tmp_path / "metrics")
    files.write_metrics(evaluate.to_metric_rows(wide, "run", "epoch", ["Loss/Val", "Loss/Train"]), path)
    got = {r["tag"]: (r["run"], r["step"], r["value"]) for r in files.read_metrics(spark, path).collect()}
    assert got == {"Loss/Val": ("1", 0, 0.5), "Loss/Train": ("1", 0, 0.25)}


def test_effective_size(spark):
    df = spark.range(10)
    assert tuple(stats.dataset_size(df, 4).first()) == (10, 4)
    assert tuple(stats.dataset_size(df, 40).first()) == (10, 10)
    assert tuple(stats.dataset_size(df).first()) == (10, 10)


def test_scoring_stream_writes_rows_and_samples(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("prompt_id"), F.lit(0).alias("gen_id"), F.lit("1</action>").alias("completion"))
    rows.write.parquet(str(tmp_path / "in"))
    registry = rewards.RewardRegistry()
    registry.register("format", ["completion"], lambda c: rewards.reward_format_discrete(c, 2))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    completions.start_scoring(stream, registry, str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "log"),
                              fraction=0.5).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("reward")).first()[0] == 200.0
    assert 60 < spark.read.text(str(tmp_path / "log")).where("value = '<action>1</action>'").count() < 140


def test_tables_kept_by_prompt_join_without_an_exchange(spark, tmp_path):
    left = spark.range(3_000).select((F.col("id") % 500).alias("prompt_id"), F.col("id").alias("gen_id"), F.lit("x").alias("completion"))
    right = spark.range(500).select(F.col("id").alias("prompt_id"), (F.col("id") * 2).alias("reward"))
    files.save_by_prompt(left, "kept_left", 8, str(tmp_path / "left"))
    files.save_by_prompt(right, "kept_right", 8, str(tmp_path / "right"))
    joined = align.join_completions_to_transitions(spark.table("kept_left").hint("merge"), spark.table("kept_right"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 3_000 and joined.where("reward <> prompt_id * 2").count() == 0
    by_prompt = joined.groupBy("prompt_id").agg(F.avg("reward"))
    assert "Exchange" not in by_prompt._jdf.queryExecution().executedPlan().toString() and by_prompt.count() == 500
    for table in ("kept_left", "kept_right"):
        spark.sql(f"DROP TABLE {table}")


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_callables_see_whole_groups(spark, batch):
    from episodica.session import ship_package
    ship_package(spark)
    rows = [(p, g, f"t{g % 3}", "clash") for p in (1, 2, None, 7) for g in range(8)] + [(9, 0, None, "clash")]
    frame = spark.createDataFrame(rows, "prompt_id long, gen_id int, `a.b` string, reward string").repartition(5)

    def place(prompts, texts):  # depends on all rows of the prompt
        return [float(prompts[:k].count(p)) + 100 * prompts.count(p) for k, p in enumerate(prompts)]

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = align.score_whole_groups(frame, place, {"prompts": "prompt_id", "texts": "a.b"})
        got = {(r["prompt_id"], r["gen_id"]): r["reward"] for r in out.collect()}
        assert out.columns == ["prompt_id", "gen_id", "a.b", "reward"]
        assert got == {**{(p, g): 800.0 + g for p in (1, 2, None, 7) for g in range(8)}, (9, 0): 100.0}
        assert align.score_whole_groups(frame.limit(0), place, {"prompts": "prompt_id", "texts": "a.b"}).count() == 0
        for wrong, columns in ((lambda prompts: [1.0], {"prompts": "prompt_id"}),):
            with pytest.raises(Exception, match="numbers for"):
                align.score_whole_groups(frame, wrong, columns).collect()
        with pytest.raises(Exception, match="more than 5 rows"):
            align.score_whole_groups(frame, place, {"prompts": "prompt_id", "texts": "a.b"}, max_rows=5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
