"""Word passages that occurred before, removed with sharded Aho-Corasick automata.

Windows are 20 consecutive words of one document. Documents are dealt into buckets of about BUCKET_BYTES. Runs of windows
meet at their anchors (see winnow), where recurring windows are confirmed and their first occurrence (smallest doc_id,
then smallest key and start) is found; consecutive confirmed windows with one source are a passage, and each bucket that holds a
passage gets it once. Each bucket compiles its passages, as word sequences, into one automaton and streams all its
documents through it: every occurrence of a passage that is not its source is removed. An automaton is bounded by its
bucket's text, and every text is streamed once.

An anchor with more than HOT_RUNS runs, counted where a chunk has BUSY_RUNS of it or more, is hot: its windows are grouped
by their own 64-bit hashes, with the first place taken before the shuffle, and first places are joined back, where Spark
splits a hot window. A colder anchor's windows meet in one task; they are compared by 40 bits of their hash and the 64 bits
of the anchor. Runs that repeat within a batch and bucket are
shipped once. Null and empty texts have no words. Rows are named by doc_id and a key, a hash of both doc_id and text. A row without
doc_id comes after all others; rows that share a doc_id, or have none, come in the order of their keys. Rows that share
doc_id (or have none) and text are one place: neither is earlier, and they are in one bucket. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .groups import kept
from .winnow import runs, spread

WINDOW, GRAM = 20, 5
BUCKET_BYTES = 2_000_000
HOT_RUNS, BUSY_RUNS = 20_000, 4
_LAST = 2**63 - 1
_BYTES = 5  # of a window's hash that are shipped
#: Passages of one run that lie on from each other, source included, are joined.
PASSAGES = "bucket int, doc bigint, key bigint, run int, start int, words int, first_doc bigint, first_key bigint, first_start int"


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key % buckets).astype(np.int32)


def _runs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of a chunk: anchor, doc, key, start, whether they stand for several, number of windows; and all their windows."""
    for batch in batches:
        docs, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for chunk in tokens.chunks(batch.column(2)):
            w = tokens.words(chunk, chunk.data, tokens.SPACE_WORDS)
            hashes = tokens.word_hashes(chunk.data, w)
            windows = tokens.window_hashes(hashes, WINDOW)
            grams = tokens.window_hashes(hashes, GRAM)
            r = runs(grams, tokens.windows_in_rows(w.first, WINDOW), WINDOW - GRAM + 1)
            if not len(r.first):
                continue
            row, count = w.row[r.first], r.last - r.first + 1
            doc, key = docs[row + chunk.first_row], keys[row + chunk.first_row]
            content = tokens.window_hashes(hashes, 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens.mix(content), dtype=np.uint64)])
            whole = tokens.mix((sums[r.last + WINDOW] - sums[r.first]) ^ grams[r.anchor]
                               ^ tokens.mix(windows[r.first]) ^ tokens.mix(tokens.mix(windows[r.last]))
                               ^ tokens.mix(_bucket(key, buckets).astype(np.uint64) + np.uint64(1)))
            start = r.first - w.first[row]
            order = np.lexsort((start, key, doc))
            _, keep, times = np.unique(whole[order], return_index=True, return_counts=True)
            keep = order[keep]  # the first of equal runs of a bucket
            _, number = spread(count[keep])
            shipped = windows[np.repeat(r.first[keep], count[keep]) + number]
            yield grams[r.anchor[keep]], doc[keep], key[keep], start[keep], times > 1, count[keep], shipped


def _busy(batches: Iterator[pa.RecordBatch], buckets: int, least: int) -> Iterator[pa.RecordBatch]:
    """Anchors with ``least`` or more runs in a chunk, and how many."""
    for anchor, *_ in _runs(batches, buckets):
        values, counts = np.unique(anchor.view(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values[counts >= least]), pa.array(counts[counts >= least])], names=["anchor", "n"])


def _scan(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of anchors that are not hot, with the hashes of their windows."""
    for anchor, doc, key, start, twins, count, windows in _runs(batches, buckets):
        if len(hot):
            cold = ~np.isin(anchor.view(np.int64), hot)
            windows = windows[np.repeat(cold, count)]
            anchor, doc, key, start, twins, count = (x[cold] for x in (anchor, doc, key, start, twins, count))
        raw = windows.view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()
        offsets = np.concatenate([[0], np.cumsum(count) * _BYTES]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(doc), pa.array(key), pa.array(start.astype(np.int32)), pa.array(twins),
             pa.Array.from_buffers(pa.binary(), len(anchor), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])],
            names=["anchor", "doc", "key", "start", "twins", "windows"])


def _hot_windows(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each window of the runs of hot anchors."""
    for anchor, doc, key, start, twins, count, windows in _runs(batches, buckets):
        run, number = spread(count)
        here = np.isin(anchor.view(np.int64), hot)[run]
        run, number, windows = run[here], number[here], windows[here]
        window = tokens.mix(windows ^ tokens.mix(anchor)[run]).view(np.int64)
        yield from pa.table({"window": window, "doc": doc[run], "key": key[run], "run": start[run].astype(np.int32),
                             "start": (start[run] + number).astype(np.int32),
                             "n": 1 + twins[run].astype(np.int64)}).to_batches(max_chunksize=10_000)


def hot_passages(windows: DataFrame, buckets: int) -> DataFrame:
    """Passages of one window each from (window, doc, key, run, start, n): those that recur, with their first places."""
    firsts = windows.groupBy("window").agg(F.min(F.struct("doc", "key", "start")).alias("first"), F.sum("n").alias("times"))
    firsts = kept(firsts.filter("times > 1").select("window", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc", "key", "start")]),
                  "firsts")
    return windows.join(firsts.hint("merge"), "window").select(
        F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "doc", "key", "run", "start", F.lit(WINDOW).alias("words"),
        "first_doc", "first_key", "first_start")


def _joined(passages: pa.Table) -> pa.Table:
    """Passages of one run that lie on from each other, and whose sources do, as one."""
    doc, key, run, start, words, first_doc, first_key, first_start = (
        passages.column(c).to_numpy().astype(np.int64)
        for c in ("doc", "key", "run", "start", "words", "first_doc", "first_key", "first_start"))
    order = np.lexsort((start, run, key, doc))
    steps = [np.diff(x[order]) for x in (doc, key, run, first_doc, first_key)]
    on = np.diff(start[order])
    new = np.ones(len(order), bool)
    new[1:] = np.any(steps, axis=0) | (on != words[order][:-1] - WINDOW + 1) | (np.diff(first_start[order]) != on)
    begin = np.flatnonzero(new)
    last = order[np.append(begin[1:], len(order)) - 1]
    head = order[begin]
    out = passages.take(pa.array(head))
    return out.set_column(out.schema.get_field_index("words"), "words", pa.array(start[last] + words[last] - start[head]))


def _passages(rows: pa.Table, buckets: int) -> pa.RecordBatch:
    """Passages of whole anchor groups, one row for each run that holds one (or more)."""
    anchor, doc, key, start = (rows.column(c).to_numpy() for c in ("anchor", "doc", "key", "start"))
    packed = rows.column("windows").combine_chunks()
    lengths = np.diff(np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1])
    low = int(np.frombuffer(packed.buffers()[1], np.int32)[packed.offset])
    raw = np.frombuffer(packed.buffers()[2], np.uint8)[low:low + int(lengths.sum())].reshape(-1, _BYTES)
    window = np.zeros((len(raw), 8), np.uint8)
    window[:, :_BYTES] = raw
    run, number = spread(lengths // _BYTES)
    content = tokens.mix(window.view(np.uint64).ravel() ^ tokens.mix(anchor.view(np.uint64))[run])
    place = start[run].astype(np.int64) + number
    order = np.lexsort((place, key[run], doc[run], content))
    ordered = content[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    first = order[np.flatnonzero(new)][group]
    twins = rows.column("twins").to_numpy(zero_copy_only=False)  # runs that stand for several of their bucket
    recurs = np.add.reduceat(1 + twins[run][order], np.flatnonzero(new))[group] > 1
    source, confirmed = np.empty(len(order), np.int64), np.empty(len(order), bool)
    source[order], confirmed[order] = first, recurs
    source_doc, source_key, source_start = doc[run[source]], key[run[source]], place[source]
    breaks = np.ones(len(order) + 1, bool)
    breaks[1:-1] = (run[1:] != run[:-1]) | (source_doc[1:] != source_doc[:-1]) | (source_key[1:] != source_key[:-1]) \
        | (confirmed[1:] != confirmed[:-1]) | (np.diff(source_start) != 1)
    edges = np.flatnonzero(breaks)
    begin, words = edges[:-1][confirmed[edges[:-1]]], (np.diff(edges) + WINDOW - 1)[confirmed[edges[:-1]]]
    at = run[begin]
    return pa.RecordBatch.from_arrays(
        [pa.array(_bucket(key[at], buckets)), pa.array(doc[at]), pa.array(key[at]), pa.array(place[begin].astype(np.int32)),
         pa.array(place[begin].astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(source_doc[begin]), pa.array(source_key[begin]),
         pa.array(source_start[begin].astype(np.int32))],
        names=["bucket", "doc", "key", "run", "start", "words", "first_doc", "first_key", "first_start"])


def _confirm(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Runs sorted by anchor; singles go, whole groups are compared."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor = table.column("anchor").to_numpy()
        same = np.zeros(len(anchor) + 1, bool)
        same[1:-1] = anchor[1:] == anchor[:-1]
        several = same[1:] | same[:-1] | table.column("twins").to_numpy()
        if several.any():
            yield _passages(table.filter(pa.array(several)), buckets)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if held[0].column("anchor")[0] == batch.column("anchor")[-1]:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        anchor = table.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        yield from done(table.slice(0, cut).combine_chunks())
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield from done(pa.Table.from_batches(held).combine_chunks())


def _compile(sequences: list[tuple[int, ...]]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for number, sequence in enumerate(sequences):
        machine.add_word(sequence, number)
    machine.make_automaton()
    return machine


def _remove(docs: pa.Table, passages: pa.Table) -> pa.Table:
    """One bucket: its documents without the words of passages that have an earlier source."""
    n = docs.num_rows
    ids = list(zip(docs.column("doc").to_pylist(), docs.column("key").to_pylist()))
    chunk = next(tokens.chunks(docs.column("text"), 2**62), None)
    w = tokens.words(chunk, chunk.data, tokens.SPACE_WORDS)
    numbers = tokens.span_codes(chunk.data, w.starts, w.ends)[0].astype(np.int64) + 1
    flags = np.zeros(len(numbers), bool)
    if passages.num_rows:
        passages = _joined(passages)
        row_of = {name: r for r, name in enumerate(ids)}
        row = np.array([row_of[name] for name in zip(passages.column("doc").to_pylist(), passages.column("key").to_pylist())])
        begin = w.first[row] + passages.column("start").to_numpy()
        length = passages.column("words").to_numpy()
        distinct: dict[bytes, int] = {}
        packed = numbers.astype(np.int32).tobytes()
        for number, (b, k) in enumerate(zip((begin * 4).tolist(), (length * 4).tolist())):
            distinct.setdefault(packed[b:b + k], number)
        one = np.array(list(distinct.values()))
        sources = np.stack([passages.column(c).to_numpy()[one] for c in ("first_doc", "first_key", "first_start")], axis=1)
        size = length[one]
        machine = _compile([tuple(numbers[b:b + k].tolist()) for b, k in zip(begin[one].tolist(), size.tolist())])
        depth = np.zeros(len(numbers) + 1, np.int64)
        for r in range(n):
            low, high = int(w.first[r]), int(w.first[r + 1])
            if high - low < WINDOW:
                continue
            hits = np.array(list(machine.iter(tuple(numbers[low:high].tolist()))), np.int64).reshape(-1, 2)
            start = hits[:, 0] + 1 - size[hits[:, 1]]
            later = (sources[hits[:, 1]] != np.column_stack([np.full((len(hits), 2), ids[r]), start])).any(axis=1)
            np.add.at(depth, low + start[later], 1)
            np.add.at(depth, low + hits[later, 0] + 1, -1)
        flags = np.cumsum(depth[:-1]) > 0
    removed = tokens.per_row(flags, w.first)
    raw = chunk.data.tobytes()
    texts = []
    for r in range(n):
        low, high = int(w.first[r]), int(w.first[r + 1])
        if removed[r]:
            found = [raw[a:b] for a, b, gone in zip(w.starts[low:high].tolist(), w.ends[low:high].tolist(), flags[low:high].tolist())
                     if not gone]
        else:
            found = raw[int(chunk.offsets[r]):int(chunk.offsets[r + 1])].split()
        texts.append(b" ".join(found))
    shown = docs.column("doc_id")
    return pa.table({"doc_id": shown, "n_words": w.counts, "n_removed": removed,
                     "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})


def remove_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of each row; needs doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // bucket_bytes
    named = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"),
                       F.when(F.col("doc_id").isNull(), named).otherwise(-1 - named).alias("key"), "text")  # null comes last
    texts, least = docs.select("doc", "key", "text"), BUSY_RUNS
    busy = texts.mapInArrow(lambda batches: _busy(batches, buckets, least), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    hot = np.array(sorted(r.anchor for r in busy.filter(F.col("n") > HOT_RUNS).collect()), np.int64)
    found = texts.mapInArrow(lambda batches: _scan(batches, buckets, hot),
                             "anchor bigint, doc bigint, key bigint, start int, twins boolean, windows binary")
    passages = found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        lambda batches: _confirm(batches, buckets), PASSAGES)
    if len(hot):
        passages = passages.unionByName(hot_passages(texts.mapInArrow(
            lambda batches: _hot_windows(batches, buckets, hot),
            "window bigint, doc bigint, key bigint, run int, start int, n bigint"), buckets))
    docs = docs.select("doc_id", "doc", "key", F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "text")
    return docs.groupBy("bucket").cogroup(passages.groupBy("bucket")).applyInArrow(
        _remove, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
