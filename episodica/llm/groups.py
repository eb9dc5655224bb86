"""Whole groups in Arrow streams, and connected components of distributed edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir


def kept(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written to the shared folder and read again, so that lost executors repeat nothing before it."""
    path = scratch_dir(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def per_group(rows: DataFrame, key: str, schema: str,
              fn: Callable[[pa.Table], pa.Table | None]) -> DataFrame:
    """``fn`` over the rows of each value of the integer column ``key``; groups must be small, partitions need not be."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            out = fn(pa.Table.from_batches(held)) if held else None
            if out is not None and out.num_rows:
                yield from out.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
                yield from done()
                held = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a:
                    yield from done()
                    held = []
                held.append(batch.slice(a, b - a))
        yield from done()

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on (a, b) with b < a."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return kept(out.filter("a <> b").distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected links (a, b); the component is its smallest node.

    Alternating large and small stars; minima are aggregated before the shuffle and joined from a written table, so
    Spark can split the join of a node with very many links.
    """
    edges = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        edges = _star(_star(edges, True), False)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
