"""Importance resampling: documents that read like a target corpus are drawn more often (hashed n-gram features).

Features are all runs of 1..n consecutive words, hashed to ``buckets`` by CRC32. Arrow kernels lower, split and flatten the
texts of a step and encode their words as dictionary indices; shifted indices form the longer runs, and the CRC of each
distinct (run, next word) pair continues the CRC of the run, so no text is put together. Bucket counts of the corpus and of
the target are summed in each task and then by bucket. The gain of a bucket is its smoothed log ratio in thousandths; a
document's weight is the floored mean gain of its features, taken and segment-reduced in NumPy. Gumbel noise from a seed and
the document's key turns the top k scores into a draw without replacement.

Only the ``buckets`` counts, a parameter, pass the driver. Ranks come from ranges of near equal size.

Null and empty texts have no features and weight 0. Long texts are taken whole, in a step of their own. Rows with equal keys
get equal noise, and their order is fixed but not stated; a null key is an empty one. An empty corpus or target counts as
zeros. Other columns come along; an output column replaces one of its name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import range_number
from .batches import struct, with_struct
from .groups import kept

#: Everything but words of [0-9a-z] and letters beyond ASCII, on lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STEP_BYTES = 8_000_000
WEIGHT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")])


def steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``limit`` bytes, or of one longer text, copied: casting a slice leaves offsets that start inside the
    buffer, where lower-casing reads other bytes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(texts):
        done = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield texts.take(pa.array(np.arange(row, end)))
        row = end


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row and dictionary index of every word, and the dictionary."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
    words, rows = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
    filled = pc.greater(pc.binary_length(words), 0)
    coded = pc.dictionary_encode(words.filter(filled))
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return (rows.filter(filled).to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            coded.dictionary.cast(pa.large_binary()).to_pylist())


def features(texts: pa.Array, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2 .. n words: the row and the bucket of every run."""
    rows, codes, dictionary = word_codes(texts)
    crcs = np.fromiter((zlib.crc32(w) for w in dictionary), np.int64, len(dictionary))
    runs = codes
    yield rows, (crcs % buckets)[runs]
    for size in range(2, n + 1):
        here = np.flatnonzero(rows[size - 1:] == rows[:len(rows) - size + 1])  # runs that stay in one text
        pairs = runs[here] * len(dictionary) + codes[here + size - 1]
        distinct, index = np.unique(pairs, return_inverse=True)
        crcs = np.fromiter((zlib.crc32(b" " + dictionary[p % len(dictionary)], int(crcs[p // len(dictionary)]))
                            for p in distinct.tolist()), np.int64, len(distinct))
        runs = np.zeros(len(rows), np.int64)
        runs[here] = index
        yield rows[here], (crcs % buckets)[index]


def bucket_counts(docs: DataFrame, text: str = "text", n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in steps(batch.column(0)):
                for _, hashed in features(part, n, buckets):
                    total += np.bincount(hashed, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    counted = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln(smoothed share in the target / smoothed share in the corpus))."""
    both = (corpus.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t"))
            .unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
            .unionByName(corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t"))))
    counts = kept(both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")), "buckets")
    sums = counts.agg(F.struct(F.sum("s").alias("s"), F.sum("t").alias("t")).alias("x")).scalar()
    ratio = ((F.col("t") + 1.0) * (F.col("x.s") + float(buckets))) / ((F.col("s") + 1.0) * (F.col("x.t") + float(buckets)))
    return counts.withColumn("x", sums).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weighted(docs: DataFrame, target: DataFrame, text: str = "text", n: int = 1, buckets: int = 10_000,
             output: str = "importance") -> DataFrame:
    """``docs`` with a struct of word count, feature count and weight by the texts of ``target``."""
    table = bucket_gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, "text", n, buckets), buckets)
    gains = np.zeros(buckets, np.int64)
    for row in table.collect():  # ``buckets`` rows, whatever the corpus
        gains[row["bucket"]] = row["gain"]
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def scan(column: pa.Array) -> pa.StructArray:
        out = []
        for part in steps(column):
            counts, sums, words = (np.zeros(len(part), np.int64) for _ in range(3))
            for size, (rows, hashed) in enumerate(features(part, n, buckets)):
                if not len(rows):
                    break
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                sums[rows[first]] += np.add.reduceat(shared.value.take(hashed), first)
                counts += np.bincount(rows, minlength=len(part))
                words = counts.copy() if size == 0 else words
            out.append((words, counts, np.floor_divide(sums, np.maximum(counts, 1))))
        return struct(WEIGHT, [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in zip(*out)] or [pa.array([], pa.int64())] * 3)

    return with_struct(docs, text, output, WEIGHT, scan)


def drawn(rows: DataFrame, key: str, weight: str, eligible: str, percent: int, seed: int) -> DataFrame:
    """``rows`` with ``score`` and ``rank``: of the N rows with ``eligible``, floor(percent * N / 100) highest scores are drawn.

    Ties go to the smaller key; rank counts from 1 and is null for rows not drawn.
    """
    rows = rows.drop("score", "rank")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    packed = rows.select(F.struct(*columns).alias("_row"), F.col(f"`{key}`").alias("_key"),
                         F.coalesce(F.col(f"`{eligible}`"), F.lit(False)).alias("_in"),
                         (F.col(f"`{weight}`") + noise).alias("_score"))
    ordered = range_number(packed, [~F.col("_in"), -F.col("_score"), F.col("_key")], "_number")
    draws = ordered.agg(F.floor(F.count_if("_in") * percent / 100).alias("k")).scalar()
    rank = F.when(F.col("_in") & (F.col("_number") < F.col("_k")), F.col("_number") + 1)
    return ordered.withColumn("_k", draws).select("_row.*", F.col("_score").alias("score"), rank.alias("rank"))
