"""Joins that replace alignment by list position."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def join_completions_to_transitions(completions: DataFrame, transitions: DataFrame) -> DataFrame:
    """Each completion with the logged columns of its prompt. The join strategy is left to Spark."""
    return completions.join(transitions, "prompt_id")


def score_whole_groups(rows: DataFrame, fn: Callable[..., list[float]], columns: Mapping[str, str], key: str = "prompt_id",
                       order: Sequence[str] = ("gen_id",), output: str = "reward", max_rows: int = 100_000) -> DataFrame:
    """``rows`` with the rewards of a list-based callable that must see all completions of a prompt together.

    ``fn`` gets each named column as a list, as in ``fn(prompts=…, completions=…, **columns)``; a call holds whole groups
    only, one after the other, each in the stated order, and returns a number for every row. Arrow batches cut groups
    anywhere: the rows of the last key of a batch wait for the next one. Rows with a null key are a group. A group above
    ``max_rows`` rows, which no list should hold, is an error. A column named ``output`` is replaced.
    """
    kept = [c for c in rows.columns if c != output]
    plain = [f"c{k}" for k in range(len(kept) + 1)]   # names with dots do not reach mapInArrow
    packed = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, plain)])
    place = {c: plain[k] for k, c in enumerate(kept)}
    sources = {name: place[c] for name, c in columns.items()}
    by = place[key]

    def scored(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            values = fn(**{name: table.column(c).to_pylist() for name, c in sources.items()})
            if len(values) != table.num_rows:
                raise ValueError(f"the reward gave {len(values)} numbers for {table.num_rows} rows")
            yield from table.append_column(plain[-1], pa.array(values, pa.float64())).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            codes = table.column(by).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            cut = int(np.argmax(codes == codes[-1])) if len(codes) else 0
            if len(codes) and np.bincount(codes).max() > max_rows:
                raise ValueError(f"a group has more than {max_rows} rows")
            yield from scored(table.slice(0, cut))
            waiting = table.slice(cut).combine_chunks()
        if waiting is not None:
            yield from scored(waiting)

    dealt = packed.repartition(by).sortWithinPartitions(by, *[place[c] for c in order])
    return dealt.mapInArrow(run, T.StructType([*packed.schema.fields, T.StructField(plain[-1], T.DoubleType())])).toDF(*kept, output)


def repeat_prompts(prompts: DataFrame, num_generations: int) -> DataFrame:
    """Each prompt ``num_generations`` times, numbered by ``gen_id``."""
    return prompts.withColumn("gen_id", F.explode(F.sequence(F.lit(0), F.lit(num_generations - 1))))


def attach_prompt_config(rows: DataFrame, config: DataFrame, key: str = "env") -> DataFrame:
    """Rows with the configuration of their environment. A row of an unknown environment stays, with null columns and
    the reason in ``reject``. Spark broadcasts the configuration if its size allows."""
    known = config.withColumn("__known", F.lit(True))
    reason = F.concat(F.lit("unknown environment: "), F.coalesce(F.col(key), F.lit("null")))
    return rows.join(known, key, "left").withColumn("reject", F.when(F.col("__known").isNull(), reason)).drop("__known")


def unmatched_config(rows: DataFrame, config: DataFrame, key: str = "env") -> DataFrame:
    """Error report: environments without configuration, with row counts."""
    missing = rows.join(config.select(key), key, "left_anti")
    return missing.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def compare_checkpoints(states: DataFrame, scores: dict[str, Column], state_id: str) -> DataFrame:
    """The same states under several model versions, one column per tag, and their extent: one projection."""
    rows = states.select(state_id, *[score.alias(tag) for tag, score in scores.items()])
    return rows.withColumns({"lowest": F.least(*scores), "highest": F.greatest(*scores)})


def attach_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach a one-row, one-column frame to every row."""
    return df.withColumn(name, one_row.scalar())
