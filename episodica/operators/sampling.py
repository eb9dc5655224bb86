"""Samples, splits and mini-batches that do not depend on partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.vectors import let
from .ranking import first_k_by_hash, first_k_by_number, global_rank


def bernoulli_sample(df: DataFrame, row_id: str | Sequence[str], p: float, seed: int) -> DataFrame:
    """Keep each row with probability p."""
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    return df.where(numbers.uniform(seed, *[F.col(i) for i in ids]) < p)


def random_sample_n(df: DataFrame, row_id: str, n: int, seed: int, in_one_task: int = 10_000) -> DataFrame:
    """n rows drawn without replacement.

    Up to ``in_one_task`` rows each task keeps its first n in random order and one task merges them, in one pass; above it
    the cut is found first. Both give the same rows.
    """
    if n <= in_one_task:
        return df.orderBy(numbers.order_key(seed, F.col(row_id))).limit(n)
    return first_k_by_hash(df, row_id, seed, n).where("chosen").drop("chosen")


def head_rows(df: DataFrame, k: int, key: str, in_one_task: int = 10_000) -> DataFrame:
    """The first k rows by a unique integer key; k <= 0 keeps all.

    Up to ``in_one_task`` rows each task keeps its first k and one task merges them, in one pass; above it the cut key is
    found first. Both give the same rows.
    """
    if k <= 0:
        return df
    return df.orderBy(key).limit(k) if k <= in_one_task else first_k_by_number(df, key, k)


#: The prime of the round function, and the number of rounds of the permutation.
PRIME, ROUNDS = 2**31 - 1, 6
#: A number is sent on at most so often; a domain of a x b has fewer than a numbers too many.
WALKS = 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Two keys for each round of the permutation."""
    digests = [hashlib.md5(f"{seed}:{r}".encode()).hexdigest() for r in range(ROUNDS)]
    return [(int(d[:8], 16) % PRIME, int(d[8:16], 16) % PRIME) for d in digests]


def permuted(number: Column, n: Column, seed: int) -> Column:
    """Where ``number`` of the numbers 0..n-1 stands in a seeded random order: a permutation, without a sort or an exchange.

    A Feistel network over pairs below (a, b) with a = ceil(sqrt(n)), b = ceil(n / a): each round adds a cubic hash of one
    half to the other, modulo the other's size. Results from n on are sent through again.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    b = F.ceil(n.cast("double") / a).cast("bigint")
    keys = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(m).cast("bigint").alias("m"), F.lit(r % 2 == 0).alias("left"))
                     for r, (k, m) in enumerate(round_keys(seed))])

    def hashed(x: Column, key: Column) -> Column:
        return let((x + key["k"]) % PRIME, lambda y: ((y * y) % PRIME * y + key["m"]) % PRIME)

    def turn(s: Column, key: Column) -> Column:
        return F.struct(F.when(key["left"], (s["l"] + hashed(s["r"], key)) % s["a"]).otherwise(s["l"]).alias("l"),
                        F.when(key["left"], s["r"]).otherwise((s["r"] + hashed(s["l"], key)) % s["b"]).alias("r"), s["a"].alias("a"), s["b"].alias("b"))

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("bigint").alias("l"), (x % b).alias("r"), a.alias("a"), b.alias("b"))
        return F.aggregate(keys, start, turn, lambda s: s["l"] * s["b"] + s["r"])

    lost = F.raise_error(F.lit("the permutation did not return below n")).cast("bigint")
    walked = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), x, lambda v, _: F.when(v < n, v).otherwise(once(v)),
                                   lambda v: F.when(v < n, v).otherwise(lost))
    return let(once(number.cast("bigint")), lambda x: F.when(x < n, x).otherwise(walked(x)))


def _with_rank(df: DataFrame, number: str, seed: int) -> DataFrame:
    """Rows with ``__s``: their number and the rank of each; the numbers must be 0..n-1, which is checked."""
    x = F.col(number)
    dense = (F.min(x) == 0) & (F.max(x) == F.count(F.lit(1)) - 1)
    n = df.agg(F.when(F.count(F.lit(1)) == 0, 0).when(dense, F.count(F.lit(1))).otherwise(
        F.raise_error(F.lit(f"{number} does not number the rows from 0")).cast("bigint")).alias("n"))
    return df.withColumn("__k", n.scalar()).withColumn(
        "__s", let(F.col("__k"), lambda k: F.struct(k.alias("n"), permuted(x, k, seed).alias("rank")))).drop("__k")


def train_test_split(df: DataFrame, row_id: str, seed: int, test_size: float = 0.1, number: str | None = None) -> DataFrame:
    """Add ``split``: the first ceil(n * test_size) rows in random order are the test part.

    If a column ``number`` numbers the rows from 0, their order is a permutation of the numbers and no row is exchanged;
    else rows are compared with a cut in the order of their hashes.
    """
    if number is not None:
        test = F.col("__s.rank") < F.ceil(F.col("__s.n") * test_size)
        return _with_rank(df, number, seed).withColumn("split", F.when(test, "test").otherwise("train")).drop("__s")
    cut = first_k_by_hash(df, row_id, seed, lambda n: F.ceil(n * test_size))
    return cut.withColumn("split", F.when(F.col("chosen"), "test").otherwise("train")).drop("chosen")


def train_val_split_exact(df: DataFrame, row_id: str, seed: int, val_split: float = 0.1, number: str | None = None) -> DataFrame:
    """Add ``split``: exactly round(n * val_split) validation rows (half to even), the rest train; ``number`` as above."""
    if number is not None:
        val = F.col("__s.rank") < F.bround(F.col("__s.n") * val_split, 0)
        return _with_rank(df, number, seed).withColumn("split", F.when(val, "val").otherwise("train")).drop("__s")
    cut = first_k_by_hash(df, row_id, seed, lambda n: F.bround(n * val_split, 0).cast("bigint"))
    return cut.withColumn("split", F.when(F.col("chosen"), "val").otherwise("train")).drop("chosen")


def minibatches(df: DataFrame, row_id: str, batch_size: int, seed: int, drop_last: bool = True, number: str | None = None) -> DataFrame:
    """Add ``batch`` in seeded random order; an incomplete last batch is dropped for training. ``number`` as above."""
    if number is not None:
        out = _with_rank(df, number, seed).withColumn("batch", F.floor(F.col("__s.rank") / batch_size).cast("bigint"))
        out = out.where(F.col("batch") < F.floor(F.col("__s.n") / batch_size)) if drop_last else out
        return out.drop("__s")
    ranked = global_rank(df, row_id, seed)
    batch = F.floor(F.col("rank") / batch_size).cast("bigint")
    out = ranked.withColumn("batch", batch)
    if drop_last:
        full = df.agg(F.floor(F.count(F.lit(1)) / batch_size).alias("full")).scalar()
        out = out.withColumn("__full", full).where(F.col("batch") < F.col("__full")).drop("__full")
    return out


def categorical_draw(probabilities: Column, u: Column) -> Column:
    """First index whose cumulative probability reaches u; the last index closes rounding gaps."""
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("i"), F.lit(-1).alias("hit"))

    def step(s: Column, p: Column) -> Column:
        c = s["c"] + p
        return F.struct(c.alias("c"), (s["i"] + 1).alias("i"),
                        F.when((s["hit"] < 0) & (c >= u), s["i"]).otherwise(s["hit"]).alias("hit"))

    return F.aggregate(probabilities, start, step,
                       lambda s: F.when(s["hit"] < 0, s["i"] - 1).otherwise(s["hit"]))


def rejection_sample(df: DataFrame, row_id: str, p: Sequence[float], q: Sequence[float], seed: int) -> DataFrame:
    """One draw from p per row, kept with probability q[class]: shares beside the normalised p * q."""
    if len(p) != len(q):
        raise ValueError("p and q need the same length")
    product = [a * b for a, b in zip(p, q)]
    expected = [x / sum(product) for x in product]

    def lookup(values: Sequence[float], index: Column) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), index)

    u = numbers.uniform_pair(seed, F.col(row_id))
    drawn = (df.select(u.alias("u"))
             .select("u", categorical_draw(F.array(*[F.lit(float(v)) for v in p]), F.col("u.a")).alias("class"))
             .select("class", (F.col("u.b") < lookup(q, F.col("class"))).cast("int").alias("kept")))
    by_class = drawn.groupBy("class").agg(F.count(F.lit(1)).alias("n_drawn"), F.sum("kept").alias("n_kept"))
    totals = by_class.agg(F.struct(F.sum("n_drawn").alias("drawn"), F.sum("n_kept").alias("kept")).alias("t"))
    return by_class.withColumn("t", totals.scalar()).select(
        "class", "n_drawn", "n_kept",
        F.try_divide(F.col("n_kept"), F.col("t.kept")).alias("share"),
        lookup(expected, F.col("class")).alias("expected_share"),
        F.try_divide(F.col("t.kept"), F.col("t.drawn")).alias("acceptance_rate"))
