"""Exact global ranks and exact top-k cuts without a global sort.

Order keys are md5 digests of seed and row id, so ranks do not depend on partitioning. Row ids must
be unique.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import order_key
from ..session import scratch_dir

PREFIX = 4          # hex digits of the digest that name a bucket: 65,536 buckets
BUCKETS = 16 ** PREFIX
SPLITTERS = 64      # parts a quantile sketch cuts the keys into


def global_rank(df: DataFrame, row_id: str, seed: int, name: str = "rank") -> DataFrame:
    """0-based rank of every row in seeded random order.

    Rows are sorted inside digest buckets, one exchange; the sizes of at most BUCKETS buckets,
    counted before the shuffle, give the offsets.
    """
    key = order_key(seed, F.col(row_id))
    keyed = df.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, PREFIX))
    sizes = (df.select(F.substring(key, 1, PREFIX).alias("__bucket")).groupBy("__bucket")
             .agg(F.count(F.lit(1)).alias("__n")))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__bucket").orderBy("__key", row_id)
    position = F.row_number().over(inside) - 1 + F.col("__before")
    return (keyed.join(F.broadcast(offsets), "__bucket")
            .select(*df.columns, position.cast("bigint").alias(name)))


def _cut(df: DataFrame, bucket: Column, key: Column, k: Column | int) -> DataFrame:
    """One row ``cut``: STRUCT<n, k, key> with the k-th smallest key.

    Bucket sizes point at the bucket that holds it, and only that bucket is ranked.
    """
    keyed = df.select(bucket.alias("__bucket"), key.alias("__key"))
    sizes = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))
    upto = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most BUCKETS + 1 rows
    everything = Window.partitionBy()
    wanted = k(F.col("__total")) if callable(k) else F.lit(k)
    running = (sizes.select("__bucket", "__size", F.sum("__size").over(upto).alias("__upto"),
                            F.sum("__size").over(everything).alias("__total"))
               .withColumn("__k", F.least(wanted, F.col("__total"))))
    holds = (F.col("__upto") >= F.col("__k")) & (F.col("__upto") - F.col("__size") < F.col("__k"))
    where = running.agg(F.struct(
        F.max("__total").alias("n"), F.max("__k").alias("k"),
        F.max(F.when(holds, F.col("__bucket"))).alias("bucket"),
        F.max(F.when(holds, F.col("__k") - F.col("__upto") + F.col("__size"))).alias("nth")).alias("w"))
    inside = keyed.withColumn("w", where.scalar()).where(F.col("__bucket") == F.col("w.bucket"))
    ranked = inside.withColumn("__rank", F.row_number().over(Window.partitionBy("__bucket").orderBy("__key")))
    picked = ranked.agg(F.max(F.when(F.col("__rank") == F.col("w.nth"), F.col("__key"))).alias("key"))
    return (picked.withColumn("w", where.scalar())
            .select(F.struct(F.col("w.n"), F.col("w.k"), F.col("key")).alias("cut")))


def hash_cut(df: DataFrame, row_id: str, seed: int, k: Callable[[Column], Column] | int) -> DataFrame:
    """The cut after the first ``k`` rows in seeded random order; ``k`` may depend on the row count."""
    key = order_key(seed, F.col(row_id))
    return _cut(df, F.substring(key, 1, PREFIX), key, k)


def first_k_by_hash(df: DataFrame, row_id: str, seed: int, k: Callable[[Column], Column] | int) -> DataFrame:
    """Add ``chosen``: is the row among the first k in seeded random order? Rows are not shuffled."""
    key = order_key(seed, F.col(row_id))
    return (df.withColumn("__cut", hash_cut(df.select(row_id), row_id, seed, k).scalar())
            .withColumn("chosen", F.coalesce(key <= F.col("__cut.key"), F.lit(False)))
            .drop("__cut"))


def cut_number(df: DataFrame, key: str, k: int, in_one_task: int = 100_000) -> int | None:
    """The k-th smallest value of a unique integer key, or the largest if there are fewer.

    A quantile sketch of the keys gives splitters, the keys between them are counted, and the search goes on between the two
    that hold the k-th, until so few are left that one task can sort them. Only a sketch, a few kilobytes, and counts reach
    the driver. The sketch splits by how many keys there are, so a far-off key or a crowded stretch slows nothing.
    """
    keys = df.select(F.col(key).cast("bigint").alias("k")).where("k IS NOT NULL")
    while True:
        found = keys.agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint("k").alias("sketch")).first()
        k = min(k, found["n"])
        if not k:
            return None
        if found["n"] <= in_one_task:
            return keys.orderBy("k").limit(k).agg(F.max("k")).first()[0]
        splitters = sorted(set(df.sparkSession.range(1).select(F.kll_sketch_get_quantile_bigint(
            F.lit(bytes(found["sketch"])), F.array(*[F.lit(i / SPLITTERS) for i in range(1, SPLITTERS)]))).first()[0]))
        part = F.size(F.filter(F.array(*[F.lit(s) for s in splitters]), lambda s: s < F.col("k")))
        counts = dict(keys.groupBy(part.alias("part")).count().collect())  # SPLITTERS rows at most
        at = 0
        while counts.get(at, 0) < k:
            k -= counts.get(at, 0)
            at += 1
        if at > 0:
            keys = keys.where(F.col("k") > splitters[at - 1])
        if at < len(splitters):
            keys = keys.where(F.col("k") <= splitters[at])


def first_k_by_number(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows with the k smallest values of a unique integer key, found without sorting the rows."""
    cut = cut_number(df, key, k)
    return df.where(F.col(key) <= cut) if cut is not None else df.limit(0)


def _written(rows: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def range_number(rows: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """``rows`` with their 0-based position in the order of ``order``, without one task that sees them all.

    Rows are dealt into ranges of near equal size between sampled keys, sorted inside their range, and offset by the sizes
    of the ranges before. Equal keys may hold any share of the rows: a row id, fixed by writing the rows first, follows the
    keys, so ranges cut through them. Equal keys get consecutive numbers in no stated order. Two tables are written; rows
    should be narrow.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    fixed = _written(rows.select(row, *[c.alias(f"key{i}") for i, c in enumerate(order)],
                                 F.monotonically_increasing_id().alias("tie")), "fixed")
    keys = [F.col(f"key{i}").asc_nulls_last() for i in range(len(order))] + [F.col("tie")]
    place = F.monotonically_increasing_id()   # range above, position in the sorted range in the 33 bits below
    placed = _written(fixed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(
        "row", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "placed")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return (placed.join(F.broadcast(offsets), "part")
            .select("row.*", (F.col("before") + F.col("at")).cast("bigint").alias(name)))
