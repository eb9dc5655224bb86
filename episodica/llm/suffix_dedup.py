"""Repeated 200-byte strings, found on Burrows-Wheeler transforms of shards and cut out of every document.

Documents are UTF-8 bytes. Runs of 200-byte windows meet at their anchors (see winnow). Equal contexts (the bytes that a
run's windows cover) under one anchor repeat as a whole; contexts that differ are compared: one copy of each goes, by
anchor, into a shard of about SHARD_BYTES. A shard sorts its suffixes, and on its transform the intervals of common
prefixes are extended backwards, breadth first and eight bytes at a time: a boundary between neighbours with a common prefix
below v gives, one step back, boundaries below v + 8. The expansion stops at the minimum length, and what has no boundary
by then shares at least that many bytes. Covered bytes are then cut out of each text at once, judged on the input.

The windows of an anchor with more than HOT_CONTEXTS different contexts are counted by their 64-bit hashes instead, before
the shuffle first, and the repeated ones are joined back, where Spark splits a hot one; none of their bytes are shipped.
Copies that meet in one batch are shipped once. Shards hold whole anchor groups, so a shard is bounded by SHARD_BYTES and
one group of at most HOT_CONTEXTS contexts.

Nulls are empty texts; texts under 200 bytes lose nothing. Rows are named by doc_id (null included) and their text's hash:
rows that share both are copies of each other, rows that share a doc_id alone are documents of their own. Extra columns are ignored; an empty table gives no
rows. What is left may not be valid UTF-8 and is returned as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .groups import kept
from .winnow import runs, spread

MIN_BYTES, GRAM = 200, 64
SHARD_BYTES, HOT_CONTEXTS = 1_000_000, 20_000
STEP_ROWS = 500  # documents cut at a time
_OPEN, _REPEATED, _DONE = 0, 1, 2
_RUNS = "anchor bigint, context bigint, doc bigint, key bigint, start int, n int, state int"
#: A span of repeated windows of a document, or (asked) a context to compare: first start, number of windows.
_FOUND = "anchor bigint, doc bigint, key bigint, start int, n int, state int, asked boolean, hot boolean"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows. Of equal ones in a chunk the first stays, as repeated; the others are done."""
    for batch in batches:
        docs, keys = batch.column(0), batch.column(1).to_numpy()
        for chunk in tokens.chunks(batch.column(2)):
            windows = tokens.ByteWindows(chunk.data, MIN_BYTES)
            grams = windows.everywhere(GRAM)
            r = runs(grams, tokens.windows_in_rows(chunk.offsets, MIN_BYTES), MIN_BYTES - GRAM + 1)
            if not len(r.first):
                continue
            row = np.searchsorted(chunk.offsets, r.first, "right") - 1
            # a run's first and last window lie side by side or overlap: together they are its context
            context = tokens.joined(windows.at(r.first, MIN_BYTES), windows.at(r.last, MIN_BYTES) + (r.last - r.first).astype(np.uint64))
            anchor = grams[r.anchor]
            _, first, group, times = np.unique(tokens.mix(context ^ tokens.mix(anchor)), return_index=True, return_inverse=True,
                                               return_counts=True)
            state = np.full(len(context), _DONE, np.int32)
            state[first] = np.where(times > 1, _REPEATED, _OPEN)
            done = state == _DONE  # these meet nothing more: spread over the partitions
            anchor[done] = tokens.mix(tokens.mix(keys[row[done] + chunk.first_row].view(np.uint64)) + r.first[done].astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), docs.take(pa.array(row + chunk.first_row)),
                 pa.array(keys[row + chunk.first_row]), pa.array((r.first - chunk.offsets[row]).astype(np.int32)), pa.array((r.last - r.first + 1).astype(np.int32)),
                 pa.array(state)], names=["anchor", "context", "doc", "key", "start", "n", "state"])


def _whole_anchors(batches: Iterator[pa.RecordBatch], least_rows: int = 0) -> Iterator[pa.Table]:
    """Sorted batches, cut where the anchor changes; each table has at least ``least_rows`` rows but for the last."""
    held: list[pa.RecordBatch] = []  # joined once, when a later anchor shows that the first are whole
    for batch in batches:
        for start in range(0, batch.num_rows, least_rows or batch.num_rows):
            held.append(batch.slice(start, least_rows or batch.num_rows))
            first, last = held[0].column("anchor")[0], held[-1].column("anchor")[-1]
            if sum(x.num_rows for x in held) < least_rows or first == last:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            anchor = table.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            yield table.slice(0, cut).combine_chunks()
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _meet(batches: Iterator[pa.RecordBatch], hot_contexts: int) -> Iterator[pa.RecordBatch]:
    """Spans of contexts that repeat as a whole, and the contexts that must be compared."""
    for table in _whole_anchors(batches):
        done = table.column("state").to_numpy() == _DONE
        live = table.filter(pa.array(~done))
        anchor, context = live.column("anchor").to_numpy(), live.column("context").to_numpy()
        state = live.column("state").to_numpy().copy()
        order = np.lexsort((context, anchor))
        a, c = anchor[order], context[order]
        new_anchor, new_context = np.ones(len(a), bool), np.ones(len(a), bool)
        new_anchor[1:] = a[1:] != a[:-1]
        new_context[1:] = new_anchor[1:] | (c[1:] != c[:-1])
        context_of = np.cumsum(new_context) - 1
        anchor_of = np.cumsum(new_anchor) - 1
        many = np.bincount(context_of)[context_of] > 1
        contexts = np.bincount(anchor_of[new_context], minlength=anchor_of[-1] + 1 if len(a) else 0)[anchor_of]
        repeated = many | (np.add.reduceat(state[order] == _REPEATED, np.flatnonzero(new_context))[context_of] > 0) \
            if len(a) else many
        state[order] = np.where(repeated, _REPEATED, _OPEN)
        ask, hot = np.zeros(len(a), bool), np.zeros(len(a), bool)
        ask[order] = new_context & (contexts > 1)
        hot[order] = contexts > hot_contexts
        names = ["anchor", "doc", "key", "start", "n", "state"]
        asked, spans = live.filter(pa.array(ask)), live.filter(pa.array(state == _REPEATED))
        parts = ((asked, state[ask], True, hot[ask]), (spans, state[state == _REPEATED], False, np.zeros(spans.num_rows, bool)),
                 (table.filter(pa.array(done)), np.full(int(done.sum()), _DONE, np.int32), False, np.zeros(int(done.sum()), bool)))
        for part, states, is_asked, is_hot in parts:
            if part.num_rows:
                columns = [part.column(x).combine_chunks() for x in names[:5]]
                yield from pa.table([*columns, pa.array(states), pa.array(np.full(part.num_rows, is_asked)), pa.array(is_hot)],
                                    names=[*names, "asked", "hot"]).to_batches()


def _asked(batches: Iterator[pa.RecordBatch], hot: bool) -> Iterator[tuple[int, int, bytes, list[dict]]]:
    """Documents with those of their asks that are hot, or are not."""
    for batch in (whole.slice(k, STEP_ROWS) for whole in batches for k in range(0, whole.num_rows, STEP_ROWS)):
        texts = batch.column(2).cast(pa.large_binary())
        for doc, key, text, asks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist()):
            asks = [ask for ask in asks if ask["hot"] == hot]
            if asks:
                yield doc, key, text.as_py() or b"", asks


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of asked contexts, but for those of hot anchors."""
    for doc, key, raw, asks in _asked(batches, False):
        for part in range(0, len(asks), 10_000):
            some = asks[part:part + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["anchor"] for x in some], pa.int64()), pa.array([doc] * len(some), pa.int64()), pa.array([key] * len(some), pa.int64()),
                 pa.array([x["start"] for x in some], pa.int32()), pa.array([x["state"] == _REPEATED for x in some], pa.bool_()),
                 pa.array([raw[x["start"]:x["start"] + x["n"] + MIN_BYTES - 1] for x in some], pa.binary())],
                names=["anchor", "doc", "key", "start", "known", "content"])


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the asked contexts of hot anchors, by its hash under the anchor."""
    for doc, key, raw, asks in _asked(batches, True):
        windows = tokens.ByteWindows(np.frombuffer(raw, np.uint8), MIN_BYTES)
        ask, number = spread(np.array([x["n"] for x in asks]))
        at = np.array([x["start"] for x in asks])[ask] + number
        anchor = np.array([x["anchor"] for x in asks], np.int64).view(np.uint64)[ask]
        known = np.array([x["state"] == _REPEATED for x in asks])[ask]
        window = tokens.mix(windows.at(at, MIN_BYTES) ^ anchor).view(np.int64)
        yield from pa.table({"window": window, "doc": pa.array([doc] * len(at), pa.int64()), "key": np.full(len(at), key, np.int64), "start": at.astype(np.int32),
                             "known": known}).to_batches(max_chunksize=10_000)


def hot_repeats(windows: DataFrame) -> DataFrame:
    """Spans of the windows (window, doc, key, start, known) that occur again or are known to repeat."""
    counts = windows.groupBy("window").agg(F.count(F.lit(1)).alias("times"), F.max("known").alias("repeats"))
    repeated = kept(counts.filter("times > 1 OR repeats").select("window"), "windows")
    return windows.filter("NOT known").join(repeated.hint("merge"), "window").select("doc", "key", "start", F.lit(1).alias("n"))


def _first_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as a number that orders like them."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k:k + n]
    return key


def suffix_ranks(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by the first ``depth`` or more bytes, and the place of each suffix; later ties are in no order.

    Three ranks are joined in each round while they fit a 64-bit key, else two.
    """
    n = len(data)
    key, width = _first_bytes(data), 8
    bits, joined = (21, 3) if n < 2**21 - 1 else (32, 2)
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])).astype(np.uint64) + np.uint64(1)
        if width >= depth or int(rank[order[-1]]) == n:
            break
        key = rank.copy()
        for k in range(1, joined):
            key <<= np.uint64(bits)
            key[:max(n - k * width, 0)] |= rank[k * width:]
        width *= joined
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order, place


def unbounded_prefixes(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and flags of the entries that share at least ``least`` bytes with the entry before.

    Boundaries are found by increasing value. An interval's extension backwards by ``stride`` bytes is read off the places
    of the suffixes ``stride`` further on: neighbours with equal first bytes get a boundary when one lies between those.
    """
    n = len(data)
    stride = next(s for s in (8, 4, 2, 1) if least % s == 0)
    order, place = suffix_ranks(data, least)
    first = (_first_bytes(data) >> np.uint64(64 - 8 * stride))[order]
    boundary = np.ones(n, bool)
    boundary[1:] = first[1:] != first[:-1]
    short = order > n - stride
    boundary |= short
    boundary[1:] |= short[:-1]
    high = place[np.minimum(order + stride, n - 1)]
    low = np.zeros(n, np.int32)
    low[1:] = high[:-1]
    waiting = np.flatnonzero(~boundary)
    low, high = np.minimum(low, high)[waiting], np.maximum(low, high)[waiting]
    for _ in range(least // stride - 1):
        seen = np.cumsum(boundary, dtype=np.int32)
        reached = seen[high] > seen[low]
        if not reached.any():
            break
        boundary[waiting[reached]] = True
        still = ~reached
        waiting, low, high = waiting[still], low[still], high[still]
    return order, ~boundary


def _shard(table: pa.Table) -> pa.RecordBatch | None:
    """Repeated windows of the contexts in a shard that are not known to repeat."""
    content = table.column("content").combine_chunks()
    lengths = np.array([len(x) for x in content.to_pylist()])
    lines = [x + b"\xff" for x in content.to_pylist()]  # 0xFF is no byte of UTF-8
    data = np.frombuffer(b"".join(lines), np.uint8)
    order, shared = unbounded_prefixes(data, MIN_BYTES)
    group = np.cumsum(~shared) - 1
    again = np.bincount(group)[group] > 1
    repeated = np.zeros(len(data), bool)
    repeated[order[again]] = True
    context, number = spread(lengths + 1)
    asked = ~table.column("known").to_numpy(zero_copy_only=False)
    fits = number + MIN_BYTES <= lengths[context]
    wanted = repeated & fits & asked[context]
    edges = np.diff(np.concatenate([[False], wanted, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(begin):
        return None
    at = context[begin]
    return pa.RecordBatch.from_arrays(
        [table.column("doc").combine_chunks().take(pa.array(at)), pa.array(table.column("key").to_numpy()[at]),
         pa.array((table.column("start").to_numpy()[at] + number[begin]).astype(np.int32)), pa.array((end - begin).astype(np.int32))],
        names=["doc", "key", "start", "n"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_anchors(batches, SHARD_BYTES // (MIN_BYTES + 69)):
        found = _shard(table)
        if found is not None:
            yield found


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(k, STEP_ROWS) for whole in batches for k in range(0, whole.num_rows, STEP_ROWS)):
        rows = []
        for doc, text, spans in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), batch.column(2)):
            raw = text.as_py() or b""
            if not spans.is_valid:
                rows.append((doc.as_py(), len(raw), 0, [], raw))
                continue
            starts = spans.values.field(0).to_numpy().astype(np.int64)
            ends = np.minimum(starts + spans.values.field(1).to_numpy() + MIN_BYTES - 1, len(raw))
            flags = tokens.covered(np.minimum(starts, len(raw)), ends, len(raw))
            edges = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
            removed = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]
            rows.append((doc.as_py(), len(raw), int(flags.sum()), removed, np.frombuffer(raw, np.uint8)[~flags].tobytes()))
        columns = list(zip(*rows))
        if rows:
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                 pa.array(columns[3], span), pa.array(columns[4], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (byte spans) and kept (bytes) of each row; needs doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.col("doc_id").alias("doc"), F.xxhash64("text").alias("key"), "text")
    hot_contexts, name = HOT_CONTEXTS, ["doc", "key"]

    def of_row(rows: DataFrame, values: str, label: str) -> DataFrame:
        found = rows.groupBy(*name).agg(F.collect_list(values).alias(label))
        return found.withColumnsRenamed({c: f"_{c}" for c in name})

    def joined(values: DataFrame, how: str) -> DataFrame:
        return docs.join(values, docs["doc"].eqNullSafe(values["_doc"]) & (docs["key"] == values["_key"]), how)

    found = docs.select("doc", "key", "text").mapInArrow(_scan, _RUNS)
    found = kept(found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        lambda batches: _meet(batches, hot_contexts), _FOUND), "runs")
    asks = of_row(found.filter("asked").withColumn("ask", F.struct("anchor", "start", "n", "state", "hot")), "ask", "asks")
    texts = joined(asks, "inner").select("doc", "key", "text", "asks")
    contexts = texts.mapInArrow(_cut, "anchor bigint, doc bigint, key bigint, start int, known boolean, content binary")
    compared = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "doc bigint, key bigint, start int, n int")
    spans = found.filter("NOT asked").select("doc", "key", "start", "n").unionByName(compared)
    if not found.filter("hot").isEmpty():
        windows = texts.mapInArrow(_hot_windows, "window bigint, doc bigint, key bigint, start int, known boolean")
        spans = spans.unionByName(hot_repeats(windows))
    spans = of_row(spans.withColumn("span", F.struct("start", "n")), "span", "spans")
    rows = joined(spans, "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_strip, "doc_id bigint, n_bytes bigint, n_removed bigint, "
                                   "removed array<struct<start: bigint, end: bigint>>, kept binary")
