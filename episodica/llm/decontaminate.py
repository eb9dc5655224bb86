"""Benchmark decontamination with one Aho-Corasick automaton.

Items and texts are normalised alike: A-Z lower-cased, words joined by one space. Every 13-word window of an item, or the
whole of a shorter item, is a pattern between spaces. The automaton is built once, broadcast, and runs over each text
once; only texts with a hit are mapped back to word numbers and to character offsets of the original.

What is compiled and broadcast at a time has a bound. A larger benchmark is cut into passages that share 12 words, which
are dealt into parts below the bound; the texts are written once with a row id, each part's automaton scans them, and the
hits of all parts are united by row. Both ways give the same rows.

Nulls and texts without words have no words and no hits. Items without words never occur. Equal windows of several items
count for each of them; equal item ids count once; an item without id is listed as ``null``. An empty benchmark leaves
every document clean. Very long texts are scanned whole. Other columns come along; a column of the output's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .batches import STEP_ROWS, struct, with_struct
from .groups import kept

#: Bytes of benchmark text that are compiled into one broadcast automaton.
MAX_BENCHMARK_BYTES = 600_000
WINDOW_WORDS = 13
#: A document is contaminated if this share of its words is hit: 20 * hit >= words.
SHARE = 20
_BLANKED = bytes(int(tokens.LOWER[b]) if tokens.ALNUM_WORDS[tokens.LOWER[b]] else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("contaminated", T.BooleanType())])
_FOUND = "id bigint, hits array<struct<start:int,n:int,items:array<string>>>"
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("items", pa.list_(pa.string()))]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def normalised(text: bytes) -> list[bytes]:
    return text.translate(_BLANKED).split()


def automaton(items: list[tuple[str, str]], window: int = WINDOW_WORDS) -> ahocorasick.Automaton | None:
    """Patterns with (words, ids of the items); None if no item has a word."""
    patterns: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        found = normalised(text.encode())
        for k in range(max(len(found) - window + 1, min(len(found), 1))):
            part = found[k:k + window]
            patterns.setdefault(f" {b' '.join(part).decode()} ", (len(part), set()))[1].add(item)
    if not patterns:
        return None
    machine = ahocorasick.Automaton()
    for pattern, (size, ids) in patterns.items():
        machine.add_word(pattern, (len(pattern), size, tuple(sorted(ids))))
    machine.make_automaton()
    return machine


def _hits(machine: ahocorasick.Automaton | None, found: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
    """First word, number of words and item ids of each pattern in normalised words."""
    if machine is None or not found:
        return []
    line = f" {b' '.join(found).decode()} "
    hits = list(machine.iter(line))
    if not hits:
        return []
    spaces = np.array([m.start() for m in re.finditer(" ", line)])
    starts = np.searchsorted(spaces, np.array([end - size + 1 for end, (size, _, _) in hits])).tolist()
    return [(a, words, ids) for a, (_, (_, words, ids)) in zip(starts, hits)]


def _judged(raws: list[bytes], hits_of: Callable[[int, list[bytes]], list]) -> pa.StructArray:
    n_words, n_hit, items, spans, bad = [], [], [], [], []
    for k, raw in enumerate(raws):
        found = normalised(raw)
        n_words.append(len(found))
        hits = hits_of(k, found)
        if not hits:
            n_hit.append(0), items.append([]), spans.append([]), bad.append(False)
            continue
        starts = np.array([a for a, _, _ in hits])
        flags = tokens.covered(starts, starts + np.array([n for _, n, _ in hits]), len(found))
        edges = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
        places = [m.span() for m in _WORD.finditer(raw.decode())]
        spans.append([{"start": places[a][0], "end": places[b - 1][1]}
                      for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))])
        n_hit.append(int(flags.sum()))
        items.append(sorted({i for _, _, ids in hits for i in ids}))
        bad.append(SHARE * n_hit[-1] >= len(found))
    return struct(FIELDS, [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                           pa.array(spans, _SPANS), pa.array(bad, pa.bool_())])


def _raws(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def _passages(items: DataFrame, limit: int) -> DataFrame:
    """(item, text): items cut into passages of fewer than ``limit`` bytes, or 13 words, that together hold all windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), _raws(batch.column(1))):
                found, start = normalised(raw), 0
                while start == 0 or start + WINDOW_WORDS <= len(found):
                    end, size = start + WINDOW_WORDS, sum(map(len, found[start:start + WINDOW_WORDS])) + WINDOW_WORDS
                    while end < len(found) and size + len(found[end]) + 1 < limit:
                        size += len(found[end]) + 1
                        end += 1
                    yield pa.RecordBatch.from_pydict({"item": [item], "text": [b" ".join(found[start:end]).decode()]})
                    start = end - WINDOW_WORDS + 1
                    if end >= len(found):
                        break

    return items.toDF("item", "text").mapInArrow(run, "item string, text string").filter("text <> ''")


def _in_parts(docs: DataFrame, items: DataFrame, text: str, output: str, limit: int) -> DataFrame:
    """Texts scanned with the automaton of one part after the other; the driver holds one part at a time."""
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != output]).alias("row")
    fixed = kept(docs.select(F.monotonically_increasing_id().alias("id"), F.col(f"`{text}`").cast("string").alias("text"), row), "texts")
    passages = kept(_passages(items, limit // 4), "passages")
    size = passages.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-2 * size // limit))
    found = spark.createDataFrame([], _FOUND)
    for part in range(parts):
        mine = passages.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).distinct()
        machine = spark.sparkContext.broadcast(automaton([tuple(r) for r in mine.collect()]))

        def run(batches: Iterator[pa.RecordBatch], machine=machine) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, STEP_ROWS):
                    some = batch.slice(start, STEP_ROWS)
                    hits = [[{"start": a, "n": n, "items": list(ids)} for a, n, ids in _hits(machine.value, normalised(raw))] for raw in _raws(some.column(1))]
                    rows = [k for k, h in enumerate(hits) if h]
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows, pa.int64())), pa.array([hits[k] for k in rows], _HITS)], names=["id", "hits"])

        found = found.unionByName(kept(fixed.select("id", "text").mapInArrow(run, _FOUND), "hits"))
        machine.destroy()
    united = found.groupBy("id").agg(F.flatten(F.collect_list("hits")).alias("hits"))  # of one document
    joined = fixed.join(united, "id", "left").select("row", F.struct("text", "hits").alias("pair"))

    def judge(pair: pa.StructArray) -> pa.StructArray:
        hits = pair.field("hits").to_pylist()
        return _judged(_raws(pair.field("text")), lambda k, _: [(h["start"], h["n"], h["items"]) for h in hits[k] or []])

    return with_struct(joined, "pair", "found", FIELDS, judge).select("row.*", F.col("found").alias(output))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", output: str = "contamination",
                  max_benchmark_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """``docs`` with a struct of hit words, item ids, hit spans (characters of the original) and the verdict."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    size = items.agg(F.coalesce(F.sum(F.octet_length(items[1])), F.lit(0))).first()[0]
    if size > max_benchmark_bytes:
        return _in_parts(docs, items, text, output, max_benchmark_bytes)
    machine = spark.sparkContext.broadcast(automaton([tuple(r) for r in items.collect()]))
    return with_struct(docs, text, output, FIELDS, lambda column: _judged(_raws(column), lambda _, found: _hits(machine.value, found)))
