"""Threshold-scaled sketches: every shingle hash below a fixed fraction of all hashes is kept (native columns only).

A shingle is five consecutive lower-cased words, or the whole sequence of a shorter text. Whether a hash is kept depends on
the hash alone, so the sketch of a union is the union of sketches, and the share of a small text's hashes found in a large
one estimates its containment however unequal they are. A sketch is a sorted array of 48-bit numbers. If no hash lies below
the threshold, the smallest hash stands for the set, so that different short texts differ; ``merged`` keeps that rule, so
merging stays exact.

Null and empty texts have an empty sketch, which is like another empty one (1) and unlike all others (0). Long texts are
sketched whole. Repeated and tied rows are fingerprinted alike: equal texts have equal sketches. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import kept

#: One in SCALE hashes is kept; words of a shingle.
SCALE, WORDS = 8, 5
_BITS = 48
#: Steps of the search for a range: 2**20 ranges at most.
_SEARCH = 20


def words(text: Column) -> Column:
    r"""The lower-cased words [^\x20\x09-\x0D]+ of a text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1), "")


def _least(hashes: Column, scale: int) -> Column:
    below = F.filter(hashes, lambda h: h < (1 << _BITS) // scale)
    return F.when(F.size(below) > 0, F.array_sort(F.array_distinct(below))).when(
        F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<bigint>"))


def _hashes(words_column: Column, width: int) -> Column:
    at = F.sequence(F.lit(0), F.greatest(F.size(words_column) - width, F.lit(0)))
    hashed = F.transform(at, lambda i: F.shiftrightunsigned(
        F.xxhash64(*[F.get(words_column, i + k) for k in range(width)]), 64 - _BITS))
    return F.when(F.size(words_column) > 0, hashed).otherwise(F.array().cast("array<bigint>"))


def with_sketch(rows: DataFrame, text: str = "text", output: str = "sketch", scale: int = SCALE, width: int = WORDS) -> DataFrame:
    """``rows`` with the sketch of a text column; a column of the output's name is replaced."""
    columns = [F.col(f"`{c}`") for c in rows.columns if c != output]
    worded = rows.select(F.struct(*columns).alias("_row"), words(F.col(f"`{text}`")).alias("_words"))
    hashed = worded.select("_row", _hashes(F.col("_words"), width).alias("_hashes"))
    return hashed.select("_row.*", _least(F.col("_hashes"), scale).alias(output))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of both shingle sets together."""
    return _least(F.array_union(a, b), scale)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of both."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first set's shingles that the second holds."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: Column) -> Column:
    """Twelve hex digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), _BITS // 4, "0"))), "")


def _first_keys(keys: DataFrame, parts: int) -> Column:
    """The first keys of ``parts`` ranges, sorted; only they pass the driver."""
    dealt = keys.select("key").repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key"))
    found = dealt.agg(F.to_json(F.array_sort(F.collect_list("key"))).alias("keys")).first()["keys"]
    return F.from_json(F.lit(found), f"array<{keys.schema['key'].dataType.simpleString()}>")


def _range_of(key: Column, firsts: Column) -> Column:
    """How many of the sorted first keys are not above the key, by halving."""
    def step(low: Column, jump: Column) -> Column:
        at = low + jump
        return F.when((at <= F.size(firsts)) & (F.get(firsts, at - 1) <= key), at).otherwise(low)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(_SEARCH))]), F.lit(0), step)


def with_next(rows: DataFrame, key: str, text: str, also: list[str]) -> DataFrame:
    """(key, text, also.., next_text, next_also..): each row beside the next in ascending order of the key.

    After the last row comes the first; null keys come last, and rows with equal keys are in order of their texts' digests,
    so a repeated row is followed by its repetition. Rows are dealt once into ranges of near equal size; a range also gets
    the first row of the range after it. Rows repeated more often than an average range are dealt as one row and their count.
    """
    rows = rows.select(F.struct(F.col(key).isNull().alias("null"), F.col(key).alias("id"), F.sha2(F.col(text), 256).alias("digest")).alias("key"),
                       F.struct(F.col(key), F.col(text), *[F.col(c) for c in also]).alias("row"))
    keys = kept(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = keys.withColumn("all", keys.agg(F.sum("n")).scalar()).filter(f"n > 1 AND n * {parts} > all").select("key")  # fewer than parts
    single = rows.withColumn("n", F.lit(1).cast("bigint"))
    if not hot.isEmpty():
        repeated = rows.join(F.broadcast(hot), "key", "left_semi").groupBy("key").agg(F.any_value("row").alias("row"), F.count(F.lit(1)).alias("n"))
        single = single.join(F.broadcast(hot), "key", "left_anti").unionByName(repeated)
    firsts = _first_keys(keys, parts)
    found = single.withColumn("at", _range_of(F.col("key"), firsts) - 1)
    first = F.get(firsts, F.col("at")) == F.col("key")
    own = F.struct(F.col("at").alias("part"), F.lit(False).alias("after"))
    before = F.struct(F.pmod(F.col("at") - 1, F.size(firsts)).alias("part"), F.lit(True).alias("after"))
    dealt = found.select("key", "row", "n", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))).alias("to"))
    window = Window.partitionBy("to.part").orderBy("to.after", "key")
    paired = dealt.repartition(parts, "to.part").withColumn("next", F.lead("row").over(window)).filter("NOT to.after")
    copies = F.when(F.col("n") > 1, F.concat(F.array("next"), F.array_repeat("row", (F.col("n") - 1).cast("int")))).otherwise(F.array("next"))
    return paired.select("row", F.explode(copies).alias("next")).select(
        "row.*", F.col(f"next.{text}").alias(f"next_{text}"), *[F.col(f"next.{c}").alias(f"next_{c}") for c in also])


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
