"""Scoring completions as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.rewards import RewardRegistry
from ..sources.files import completion_samples


def score_completions(stream: DataFrame, registry: RewardRegistry) -> DataFrame:
    """Rewards of each arriving completion: the batch columns, no state."""
    return registry.score(stream)


def start_scoring(stream: DataFrame, registry: RewardRegistry, out: str, checkpoint: str, log: str | None = None,
                  fraction: float = 0.1, seed: int = 0, **trigger) -> StreamingQuery:
    """Write scored rows under ``out`` and a sampled text log under ``log``.

    Each micro-batch overwrites its own folder, so a batch that runs again after a failure leaves
    no duplicate. ``processors.group_advantages`` gives the advantages of full groups.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        if log is None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            return
        folder = f"{out}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        samples = completion_samples(batch.sparkSession.read.schema(batch.schema).parquet(folder), fraction, seed, add_action_tag=True)
        samples.select("response").write.mode("overwrite").text(f"{log}/batch={batch_id}")

    return (score_completions(stream, registry).writeStream.foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
