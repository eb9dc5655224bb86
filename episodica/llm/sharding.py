"""Shards of exact sizes from a hypergeometric communication matrix.

Rows fall into PARTS partitions by a hash of their key. A matrix says how many rows of each partition go to each shard; it
is drawn exactly, one multivariate hypergeometric row after the other, so that its columns add up to the shard sizes, which
differ by one at most. Each partition is put into a random order and cut by its matrix row, rows are exchanged, and each
shard is put into a random order again: the result is a uniform shuffle. Random orders are hashes of seed and key, so a
lost task gives the same rows again.

Only the partitions' counts reach the driver, PARTS numbers whatever the data; matrix rows and slot offsets are broadcast,
PARTS and shards * SLOT_BUCKETS rows. A shard's order is built in SLOT_BUCKETS pieces, so no task holds a shard.

Null keys are one key, and rows with equal keys follow each other in no stated order; their number in each shard is as
exact as any other. An empty table gives no rows. Other columns come along; ``shard`` and ``slot`` replace such columns.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import kept

PARTS, SLOT_BUCKETS = 1_024, 64


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many good ones are among ``draws`` without replacement: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    peak = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - peak
    down, up, below, above = mode, mode, peak, peak
    while u > 0 and (down > low or up < high):
        if up < high:
            above *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= above
            if u <= 0:
                return up
        if down > low:
            below *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= below
            if u <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each partition for each shard; rows add up to ``counts``, columns to shard sizes at most one apart."""
    rng, total = random.Random(seed), sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for count in counts:
        row, left, rest = [], count, sum(room)
        for s in range(shards):
            rest -= room[s]
            row.append(hypergeometric(rng, room[s], rest, left))
            left -= row[-1]
        room = [a - b for a, b in zip(room, row)]
        matrix.append(row)
    return matrix


def shuffled_shards(rows: DataFrame, key: Column | str, shards: int, seed: int = 17) -> DataFrame:
    """``rows`` with ``shard`` (0..shards-1) and ``slot``, gapless from 0 within each shard."""
    spark = rows.sparkSession
    key = F.col(key) if isinstance(key, str) else key
    rows = rows.drop("shard", "slot")
    kept_columns = [F.col(f"`{c}`") for c in rows.columns]
    row = F.struct(*kept_columns).alias("_row")
    keyed = rows.select(row, F.pmod(F.xxhash64(F.lit(seed), key), F.lit(PARTS)).cast("int").alias("_part"),
                        F.xxhash64(F.lit(seed + 1), key).alias("_first"), F.xxhash64(F.lit(seed + 2), key).alias("_second"))
    counts = {r["_part"]: r["count"] for r in keyed.groupBy("_part").count().collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(PARTS)], shards, seed)
    ends = [[sum(line[:s + 1]) for s in range(shards)] for line in matrix]
    table = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")).alias("_part", "_ends"))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_first")))
    dealt = ranked.join(F.broadcast(table), "_part").select(
        "_row", "_second", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).alias("_shard"),
        F.pmod(F.xxhash64("_second"), F.lit(SLOT_BUCKETS)).cast("int").alias("_bucket"))
    dealt = kept(dealt, "dealt")
    sizes = dealt.groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_shard", "_bucket").orderBy("_second")
    return (dealt.withColumn("_rank", F.row_number().over(within)).join(F.broadcast(offsets), ["_shard", "_bucket"])
            .select("_row.*", F.col("_shard").alias("shard"), (F.col("_offset") + F.col("_rank") - 1).alias("slot")))
