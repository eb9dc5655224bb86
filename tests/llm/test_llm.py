"""The dealt operators against brute force on small fixtures with every odd case."""

import base64
import collections
import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from episodica.llm import (decontaminate, groups, licenses, near_dedup, quality, secret_scan, sentencepiece, sharding,
                           substring_dedup, suffix_dedup, tokens, warc)
from episodica.session import ship_package

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def passages(seed: int, docs: int = 250) -> list[tuple[int, str]]:
    """Documents put together from shared passages, their cuts, periodic runs and noise; ids are not in row order."""
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdéfgh") * r.randint(1, 2) for _ in range(r.randint(25, 160))) for _ in range(10)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(r.randint(0, 5)):
            p, kind = r.choice(pool), r.random()
            if kind < 0.5:
                a = r.randint(0, len(p))
                parts.append(p[a:r.randint(a, len(p))])
            elif kind < 0.6:
                parts.append("x y " * r.randint(1, 80))
            else:
                parts.append(" ".join(r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(r.randint(0, 12))))
        rows.append((3 * i - 50, r.choice((" ", "\n", "")).join(parts)))
    rows += [(5_000 + i, rows[i % 7][1]) for i in range(40)] + [(9_000, ""), (9_001, None)]
    r.shuffle(rows)
    return rows


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns).repartition(4)


# words and windows

def test_words_match_regexes():
    import pyarrow as pa
    texts = ["a bb  a", "", None, "é\x0bÉ a\x1fb", "Ab\x00c-d_e\n\n", "x" * 40]
    for limit in (8, 10_000):
        for chunk in tokens.chunks(pa.array(texts), limit):
            for data, flags, pattern in ((chunk.data, tokens.SPACE_WORDS, SPACE_WORDS),
                                         (tokens.LOWER[chunk.data], tokens.ALNUM_WORDS, ALNUM_WORDS)):
                w = tokens.words(chunk, data, flags)
                for k in range(chunk.rows):
                    text = (texts[chunk.first_row + k] or "")
                    wanted = pattern.findall(text.translate(UPPER) if pattern is ALNUM_WORDS else text)
                    got = [bytes(data[a:b]).decode() for a, b in zip(w.starts[w.row == k], w.ends[w.row == k])]
                    assert got == wanted


# 1 near duplicates

def near_brute(rows):
    sets = {}
    for d, x in rows:
        w = SPACE_WORDS.findall((x or "").translate(UPPER))
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_rows(seed):
    r = random.Random(seed)
    rows = []
    for base in range(12):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(r.choice((3, 5, 30, 120)))]
        for _ in range(r.randint(1, 16)):
            edited = list(words)
            for _ in range(r.randint(0, 3)):
                edited[r.randrange(len(edited))] = f"e{r.randint(0, 30)}"
            rows.append((len(rows) * 7 % 1009, r.choice((" ", "\n")).join(edited).upper()))
    return rows + [(2_000, None), (2_001, ""), (2_002, " \n ")]


@pytest.mark.parametrize("blocks", [(512, 256, 500_000), (8, 4, 100)])
def test_near_duplicates(spark, monkeypatch, blocks):
    for name, value in zip(("CANOPY_BLOCK", "GROUP_BLOCK", "BLOCK_SHINGLES"), blocks):
        monkeypatch.setattr(near_dedup, name, value)
    rows = near_rows(3)
    wanted = near_brute(rows)
    out = near_dedup.near_duplicates(frame(spark, rows).withColumn("kept", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_shingles, r.component_id) == wanted[r.doc_id] and r.kept == (r.doc_id == wanted[r.doc_id][1])


@pytest.mark.parametrize("blocks", [(512, 256, 500_000), (8, 4, 400)])
def test_near_duplicates_far_from_their_pivot(spark, monkeypatch, blocks):
    """Chains: each text is like the next few only, so most of a canopy is not near its pivot; and one large group that is."""
    for name, value in zip(("CANOPY_BLOCK", "GROUP_BLOCK", "BLOCK_SHINGLES"), blocks):
        monkeypatch.setattr(near_dedup, name, value)
    r = random.Random(6)
    rows, ids = [], iter(r.sample(range(10_000), 500))
    for chain in range(2):
        words = [f"c{chain}w{k}" for k in range(90)]
        for step in range(60):
            words[step] = f"c{chain}s{step}"
            rows.append((next(ids), " ".join(words)))
    base = [f"b{k}" for k in range(150)]
    for k in range(70):
        edited = list(base)
        edited[r.randrange(150)] = f"e{k}"
        rows.append((next(ids), " ".join(edited)))
    r.shuffle(rows)
    wanted = near_brute(rows)
    assert len({c for _, c in wanted.values()}) == 3
    out = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == wanted


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, None), (2, "A B C D E F")]
    out = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect())
    assert out == [("1", 2, 1, True), ("1", 2, 1, True), ("2", 2, 1, False), ("None", 0, None, True), ("None", 2, None, True)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_are_corrected_for_chance():
    import numpy as np
    r = np.random.default_rng(5)
    shared = r.integers(0, 2**63, 1_200, dtype=np.uint64)
    low = near_dedup.minima([shared[:900], shared[300:], r.integers(0, 2**63, 900, dtype=np.uint64)])
    signs = near_dedup.packed(low)
    assert abs(near_dedup.estimates(signs[0], signs[1:2])[0] - 0.5) < 0.13
    assert abs(near_dedup.estimates(signs[0], signs[2:])[0]) < 0.1


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(30)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    out = {r.node: r.component for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: find(x) for x in linked}


# 2 repeated byte strings

@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    rows = passages(4, 200)
    seen = collections.Counter()
    for _, x in rows:
        b = (x or "").encode()
        seen.update(b[i:i + 200] for i in range(len(b) - 199))
    out = suffix_dedup.remove_repeats(frame(spark, rows).withColumn("n", F.lit(1))).collect()
    assert len(out) == len(rows)
    texts = {d: (x or "").encode() for d, x in rows}
    for r in out:
        b = texts[r.doc_id]
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\x01" * 200
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        assert (r.n_bytes, r.n_removed, len(r.removed)) == (len(b), sum(gone), spans)
        assert bytes(r.kept) == bytes(c for c, g in zip(b, gone) if not g)


def test_suffix_dedup_odd_rows(spark):
    long = "z" * 50_000
    rows = [(None, long), (1, long), (2, None), (3, ""), (None, "short"), (4, "q" * 199), (5, "q" * 199)]
    out = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert out == {(None, 50_000): 50_000, (1, 50_000): 50_000, (2, 0): 0, (3, 0): 0, (None, 5): 0, (4, 199): 0, (5, 199): 0}
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_rows_with_one_id(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    r = random.Random(2)
    letters = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    p, noise = letters(300), letters(900)
    for i in (1, None):
        rows = [(i, p + "x" + noise[:3]), (i, noise), (2, "y" + p), (i, "z" * 10 + p + letters(50))]
        out = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
        assert sorted((x.n_bytes, x.n_removed) for x in out) == [(301, 300), (304, 300), (360, 300), (900, 0)]


def thue_morse(n: int, flip: bool = False) -> str:
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_words_of_one_polynomial_differ(spark):
    a, b = thue_morse(2_048), thue_morse(2_048, True)
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"{words}\n{a}\n{b}"), (2, f"{b}\n{a} {b}\n{b}")]
    out = {x.doc_id: x.quality.n_dup_lines for x in quality.quality_rules(frame(spark, rows)).collect()}
    assert out == {1: 0, 2: 1}
    rows = [(1, a), (2, b), (3, a.upper())]
    assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(frame(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1}
    tail = " ".join(f"v{k}" for k in range(19))
    rows = [(1, f"{tail} {a}"), (2, f"{tail} {b}"), (3, f"{tail} {a} x")]
    assert {x.doc_id: x.n_removed for x in substring_dedup.remove_repeats(frame(spark, rows)).collect()} == {1: 0, 2: 0, 3: 20}
    rows = [(1, a), (2, b)]
    seen = collections.Counter(x[i:i + 200] for x in (a, b) for i in range(len(x) - 199))
    for x in suffix_dedup.remove_repeats(frame(spark, rows)).collect():
        text = dict(rows)[x.doc_id]
        assert x.n_removed == len({k for i in range(len(text) - 199) if seen[text[i:i + 200]] > 1 for k in range(i, i + 200)})


def test_byte_windows_are_as_equal_as_their_bytes():
    import numpy as np
    r = random.Random(1)
    text = bytes(r.choice(b"ab") for _ in range(300)) * 3 + b"cab" * 100
    w = tokens.ByteWindows(np.frombuffer(text, np.uint8), 200)
    for size in (8, 64, 200):
        hashes = w.everywhere(size) if size == 64 else w.at(np.arange(len(text) - size + 1), size)
        assert len(hashes) == len(text) - size + 1
        by_bytes = {}
        for k, h in enumerate(hashes.tolist()):
            assert by_bytes.setdefault(text[k:k + size], h) == h
        assert len(set(by_bytes.values())) == len(by_bytes)
    assert len(tokens.ByteWindows(np.zeros(5, np.uint8), 200).everywhere(64)) == 0


def test_windows_of_hot_anchors_are_counted_before_the_shuffle(spark):
    import pyarrow as pa
    shared = "".join(chr(97 + k * k % 23) for k in range(260))
    ask = {"anchor": 5, "start": 0, "n": 100, "state": 0, "hot": True}
    batch = pa.RecordBatch.from_pylist([{"doc": d, "key": d + 7, "text": "-" * 38 + chr(65 + d) + shared, "asks": [ask]} for d in range(30)])
    assert sum(x.num_rows for x in suffix_dedup._cut([batch])) == 0  # no bytes of hot windows are shipped
    windows = pa.Table.from_batches(suffix_dedup._hot_windows([batch])).to_pylist()
    assert len(windows) == 30 * 100
    rows = spark.createDataFrame([(x["window"], x["doc"], x["key"], x["start"], x["doc"] == 3) for x in windows],
                                 "window long, doc long, key long, start int, known boolean")
    out = suffix_dedup.hot_repeats(rows)
    assert "SortMergeJoin" in out._jdf.queryExecution().toString()
    assert sorted((r.doc, r.key, r.start, r.n) for r in out.collect()) == [(d, d + 7, k, 1) for d in range(30) if d != 3 for k in range(39, 100)]


@pytest.mark.parametrize("least", [1, 3, 12])
def test_prefix_boundaries_match_sorted_suffixes(least):
    import numpy as np
    r = random.Random(least)
    for _ in range(30):
        text = bytes(r.choice(b"ab") for _ in range(r.randint(1, 60))) + b"\xff"
        order, shared = suffix_dedup.unbounded_prefixes(np.frombuffer(text, np.uint8), least)
        prefixes = [text[k:k + least] for k in order]
        full = [len(p) == least for p in prefixes]
        wanted = [k > 0 and full[k] and prefixes[k] == prefixes[k - 1] for k in range(len(text))]
        assert [bool(s) for s in shared] == wanted


# 3 decontamination

def test_decontamination(spark):
    r = random.Random(6)
    words = lambda n: [r.choice("abcdefg") + r.choice("ABé1") for _ in range(n)]
    items = [(k, r.choice((" ", ", ", "-")).join(words(r.choice((0, 1, 4, 13, 14, 40))))) for k in range(30)] + [(40, None), (None, "solo wörd"), (41, "...")]
    rows = []
    for d in range(120):
        parts = [" ".join(words(r.randint(0, 30)))]
        if r.random() < 0.7:
            item = ALNUM_WORDS.findall((r.choice(items)[1] or "").translate(UPPER))
            a = r.randint(0, max(0, len(item) - 13))
            parts += [" ".join(item[a:a + r.randint(1, 30)]), " ".join(words(r.randint(0, 30)))]
        rows.append((d, r.choice((" ", " -- ", "\n")).join(parts).title()))
    rows += [(500, None), (501, ""), (502, "a" * 9_000)]
    windows = collections.defaultdict(set)
    for k, x in items:
        w = ALNUM_WORDS.findall((x or "").translate(UPPER))
        for i in range(max(len(w) - 12, min(len(w), 1))):
            windows[tuple(w[i:i + 13])].add("null" if k is None else str(k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(frame(spark, rows).withColumn("n_hit", F.lit("clash")), bench).collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for row in out:
        text = texts[row.doc_id] or ""
        w, hit, ids = ALNUM_WORDS.findall(text.translate(UPPER)), set(), set()
        for i in range(len(w)):
            for n in range(1, 14):
                if i + n <= len(w) and tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[tuple(w[i:i + n])]
        c = row.contamination
        assert (c.n_words, c.n_hit, c["items"]) == (len(w), len(hit), sorted(ids))
        assert c.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
        covered = sum(len(ALNUM_WORDS.findall(text[s.start:s.end].translate(UPPER))) for s in c.spans)
        assert covered == len(hit)
    assert decontaminate.decontaminate(frame(spark, rows), bench.limit(0)).filter("contamination.contaminated").count() == 0
    doubled = bench.unionByName(bench)  # repeated ids and items
    parts = decontaminate.decontaminate(frame(spark, rows).withColumn("a.b", F.lit(2)), doubled, max_benchmark_bytes=400)
    key = lambda r: (r.doc_id, str(r.contamination))
    assert sorted(map(key, parts.collect())) == sorted(map(key, out)) and "a.b" in parts.columns
    assert decontaminate.decontaminate(frame(spark, rows).limit(0), bench, max_benchmark_bytes=400).count() == 0


# 4 licenses

def test_licenses(spark):
    r = random.Random(8)
    rows = [(k, " ".join(r.choice(["CC", "by", "General", "public", "license", "all", "Rights", "reserved", "é", "x", "-", "cc-by", "\n"])
                         for _ in range(r.randint(0, 60)))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, "--"), (503, "Licensed under the Apache License, Version 2.0. All rights reserved."),
             (504, "SPDX-License-Identifier: MIT"), (505, "a " * 9_000 + "released under the GNU Lesser General Public License")]
    out = {x.doc_id: x.license for x in licenses.scan_licenses(frame(spark, rows).withColumn("labels", F.lit(0))).collect()}
    for d, x in rows:
        w = ALNUM_WORDS.findall((x or "").translate(UPPER))
        places, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i:i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        c = out[d]
        assert (c.n_words, c.n_base) == (len(w), len(places))
        assert (c.first_word, c.last_word) == ((min(places), max(places)) if places else (None, None))
        assert c.base_labels == sorted(labels) and labels <= set(c.labels) and c.labels == sorted(set(c.labels)) and 0 <= c.score <= 1
        for s in c.detections:
            assert not any(t.start <= s.start and s.end <= t.end and (t.start, t.end) != (s.start, s.end) and t.priority <= s.priority
                           for t in c.detections)
    assert out[503].labels == ["apache", "reserved"] and out[504].labels == ["mit"] and out[504].score == 1.0
    assert "lgpl" in out[505].labels
    assert len(licenses.rules()) > 200 and all(re.compile(p) for _, p, *_ in licenses.rules())


def examples(pattern: str) -> list[str]:
    """Texts that ``pattern`` matches, one for each of its alternatives and options."""
    import re._parser as parser

    def of(tree):
        parts = [step(op, arg) for op, arg in tree]
        first = [p[0] for p in parts]
        return list(dict.fromkeys("".join([*first[:k], x, *first[k + 1:]]) for k, p in enumerate(parts) for x in p)) or [""]

    def step(op, arg):
        name = str(op)
        if name == "LITERAL":
            return [chr(arg)]
        if name == "NOT_LITERAL":
            return ["u"]
        if name == "IN":
            kinds = {"LITERAL": chr, "RANGE": lambda r: chr(r[0]), "CATEGORY": lambda c: " " if str(c) == "CATEGORY_SPACE" else "u"}
            return ["u"] if str(arg[0][0]) == "NEGATE" else [kinds[str(o)](a) for o, a in arg]
        if name == "BRANCH":
            return [x for tree in arg[1] for x in of(tree)]
        if name == "SUBPATTERN":
            return of(arg[3])
        if name == "MAX_REPEAT":
            low, _, tree = arg
            return [x * max(low, 1) for x in of(tree)] + ([""] if low == 0 else [])
        assert name in ("AT", "ASSERT_NOT"), name
        return [""]

    found = [x for x in of(parser.parse(pattern)) if re.search(pattern, x)]
    assert found, pattern
    return found


def test_license_gates_drop_no_match(spark, monkeypatch):
    texts = sorted({x for _, pattern, *_ in licenses.rules() for x in examples(pattern)})
    texts += ["© 2024 Acme", "(c) 2024 Acme", "Released under the Expat license", "SPDX-License-Identifier: OSL-3.0",
              "SPDX-License-Identifier: AFL-3.0", "SPDX-License-Identifier: EDL-1.0", "Unauthorized copying of this file"]
    wanted = dict(zip(texts[-7:], ("copyright", "copyright", "mit", "osl", "afl", "edl", "proprietary")))
    docs = frame(spark, list(enumerate(texts)))
    gated = {r.doc_id: r.license for r in licenses.scan_licenses(docs).collect()}
    for k, x in enumerate(texts):
        assert gated[k].labels and gated[k].score > 0 and wanted.get(x, gated[k].labels[0]) in gated[k].labels, x
    every = [(label, pattern, "", "", *rest) for label, pattern, _, _, *rest in licenses.rules()]
    monkeypatch.setattr(licenses, "rules", lambda: every)
    monkeypatch.setattr(licenses, "_STEMS", ("",))
    assert {r.doc_id: r.license for r in licenses.scan_licenses(docs).collect()} == gated


# 5 sharding

def test_hypergeometric_counts():
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 70, 230, 50) for _ in range(4_000)]
    assert abs(sum(draws) / 4_000 - 50 * 70 / 300) < 0.25 and min(draws) >= 0
    matrix = sharding.communication_matrix([0, 5, 1_000, 17], 7, 3)
    assert [sum(x) for x in matrix] == [0, 5, 1_000, 17] and {sum(x) for x in zip(*matrix)} == {146}


def test_shards(spark):
    rows = [(k % 900, f"t{k % 5}") for k in range(1_000)] + [(None, None)] * 5
    out = sharding.shuffled_shards(frame(spark, rows).withColumn("shard", F.lit("old")), "doc_id", 24).collect()
    again = sharding.shuffled_shards(frame(spark, rows).repartition(7), "doc_id", 24).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(24)]
    assert sum(sizes) == 1_005 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    key = lambda rs: sorted((r.shard, r.slot, str(r.doc_id)) for r in rs)
    assert key(out) == key(again)
    assert sharding.shuffled_shards(spark.createDataFrame([], "doc_id long"), "doc_id", 24).count() == 0


# 6 pieces

@pytest.mark.skipif(not os.path.exists(sentencepiece.MODEL), reason="no tokenizer files")
@pytest.mark.parametrize("table_words", [200_000, 60, 0])
def test_pieces_equal_the_library(spark, table_words):
    import sentencepiece as library
    r = random.Random(9)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "語", "😀", "<", "1", "\t", "ou", "st", "\x00", "<s>", "<0x0A>"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for k in range(400)]
    rows += [(900, None), (901, ""), (902, " "), (903, "ab" * 3_000), (904, "  lead"), (905, "日本 語")]
    own = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    coded = sentencepiece.decode(sentencepiece.encode(frame(spark, rows).withColumn("decoded", F.lit("clash")), table_words=table_words)).collect()
    texts = dict(rows)
    for row in coded:
        text = texts[row.doc_id] or ""
        assert row.piece_ids == own.encode(text)
        assert row.decoded == text
    once = sentencepiece.round_trip(frame(spark, rows), table_words=table_words).collect()
    assert {x.doc_id: (x.coded.piece_ids, x.coded.decoded) for x in once} == {x.doc_id: (x.piece_ids, x.decoded) for x in coded}
    assert sentencepiece.encode(spark.createDataFrame([], "text string")).count() == 0


def test_lattice_folds_merges(spark):
    """Words of the corpus and random ones, each as a text of its own."""
    import pyarrow as pa
    import sentencepiece as library
    r = random.Random(4)
    pieces = sentencepiece.load()
    own = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect() if x.text]
    distinct = set()
    for _, _, _, found in sentencepiece._chunk_words(pieces, pa.array(texts)):
        distinct |= {x.decode() for x in found.to_pylist()}
    distinct |= {" " + "".join(r.choice("abehlnorst語é😀") for _ in range(r.randint(1, 60))) for _ in range(300)} | {" ", "  ", "語" * 61}
    words = spark.createDataFrame([(w,) for w in distinct], "word string")
    got = {x.word: x.ids for x in sentencepiece.encoded_words(words, pieces).collect()}
    assert set(got) == distinct and len(distinct) > 2_000
    whole = [w for w in distinct if w.startswith(" ") and not w.startswith("  ") and len(w) > 1]
    assert [got[w] for w in whole] == own.encode([w[1:] for w in whole])
    table = sentencepiece.WordTable.of(pa.table({"word": list(got), "ids": pa.array(list(got.values()), pa.list_(pa.int32()))}))
    assert sentencepiece.encode_texts(pieces, pa.array(texts), table).to_pylist() == sentencepiece.encode_texts(pieces, pa.array(texts)).to_pylist()


def test_frequent_words_have_a_bound(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 100), ("c", 9), ("d", 1), ("e", 1), ("x" * 70, 500)], "word string, n long")
    for limit, wanted in ((9, "abcde"), (4, "abc"), (2, "ab"), (1, ""), (0, "")):
        assert sorted(x.word for x in sentencepiece.frequent(counts, limit).collect()) == list(wanted)


# 7 secrets

def test_secret_patterns(spark):
    r = random.Random(10)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMN12", "0123456789abcdef", "xyz/+=",
             "ſecret", "é", "\n", "deadbeef"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for k in range(400)] + [(900, None), (901, ""), (902, "a" * 20_000)]
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
                        r"""[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = {x.doc_id: x.secrets for x in secret_scan.scan_secrets(frame(spark, rows).withColumn("spans", F.lit(1))).collect()}
    for d, x in rows:
        x = x or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 16]
        names = ("assign", "access", "hex")
        c = out[d]
        assert [(s.kind, s.start, s.end) for s in c.base] == [(names[k], a, b) for a, k, b in sorted(found)]
        assert (c.n_assign, c.n_access, c.n_hex) == tuple(sum(k == n for _, k, _ in found) for n in range(3))
        assert {(s.kind, s.start, s.end) for s in c.base} <= {(s.kind, s.start, s.end) for s in c.spans}


def test_randomness_battery(spark):
    r = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(r.choice(alphabet) for _ in range(r.choice((24, 40, 64)))) for _ in range(60)]
    plain = ["internationalisierungsbehoerde", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abababababababababababababab", "GetUserAccountInformationById"] * 15
    rows = [(k, f"see {x} here") for k, x in enumerate(keys + plain)]
    out = {x.doc_id: [s.kind for s in x.secrets.spans] for x in secret_scan.scan_secrets(frame(spark, rows)).collect()}
    assert sum("random" in out[k] for k in range(60)) >= 57
    assert not any("random" in out[k] for k in range(60, 120))


def test_random_runs_of_each_alphabet_and_length(spark):
    import uuid
    r = random.Random(12)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [lower + "234567", upper + "234567", digits + lower, digits + upper, upper + lower + digits + "+/", upper[:6] + digits]
    keys = ["".join(r.choice(a) for _ in range(n)) for a in alphabets for n in (24, 32, 40, 48, 64, 96, 128) for _ in range(6)]
    keys = [k for k in keys if any(c in digits for c in k)]
    ids = [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(40)]
    words = ["internationalisierungsbehoerde", "some_identifier_of_a_table_2024", "thequickbrownfoxjumpsoverthelazydog", "page-title-with-many-words-2024",
             "abcabcabc123abcabcabc123abc", "0000000000000000000000000001", "THISISALONGHEADINGWITHOUTSPACES", "x2" * 15] * 12
    rows = list(enumerate(f"see {x} here" for x in keys + ids + words))
    kinds = {x.doc_id: {s.kind for s in x.secrets.spans} for x in secret_scan.scan_secrets(frame(spark, rows)).collect()}
    out = {k: bool(kinds[k] & {"random", "hex"}) for k in kinds}  # long lower-case hex is a pattern of its own
    first = len(keys)
    for low, high in [(k, k + 42) for k in range(0, first - 41, 42)] + [(first, first + 40)]:
        assert sum(out[k] for k in range(low, high)) >= 0.85 * (high - low), low
    assert not [rows[k] for k in range(first + 40, len(rows)) if "random" in kinds[k]]


def test_redaction(spark):
    rows = spark.createDataFrame([("ab é secret", [(3, 4), (3, 4), (5, 11)]), ("", []), (None, [])], "t string, s array<struct<start:bigint,end:bigint>>")
    assert [r[0] for r in rows.select(secret_scan.redacted(F.col("t"), F.col("s"), "#")).collect()] == ["ab # #", "", None]


# 8 quality

def quality_brute(x, least):
    x = x or ""
    w = SPACE_WORDS.findall(x)
    n = len(w)
    three = collections.Counter(tuple(w[i:i + 3]) for i in range(n - 2))
    again = {j for i in range(n - 2) if three[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    seen, lines = set(), 0
    for line in x.split("\n"):
        if SPACE_WORDS.search(line):
            lines += line in seen
            seen.add(line)
    best, covered = 0, set()
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            if k >= least:
                best = max(best, k)
                covered |= set(range(i, i + k))
    symbols = sum(c in "#*$%&|<>" for c in x)
    failed = n < 50 or 100 * len(again) > 50 * n
    kept = not failed and symbols <= 0.1 * sum(map(len, w)) and len(covered) <= 0.5 * n and best <= 0.4 * n
    return (n, sum(map(len, w)), symbols, lines, len(again), failed, len(covered), best, kept)


def test_quality(spark):
    r = random.Random(12)
    rows = [(k, "".join(r.choice(["a", "b", "é", "#c", " ", " ", " ", "\n", "\t"]) for _ in range(r.randint(0, 140)))) for k in range(200)]
    rows += [(k, " ".join(r.choice(["q", "w", "e"]) + str(r.randint(0, 99)) for _ in range(r.randint(40, 90)))) for k in range(300, 340)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "z" * 30_000), (904, "é\né\né")]
    texts = dict(rows)
    out = quality.quality_rules(frame(spark, rows).withColumn("n_words", F.lit("clash")), min_repeat=4).collect()
    assert len(out) == len(rows)
    for row in out:
        assert tuple(row.quality) == quality_brute(texts[row.doc_id], 4)
    assert quality.quality_rules(spark.createDataFrame([], "text string")).count() == 0


# 9 recurring passages

def test_substring_dedup(spark):
    rows = passages(5)
    seen, wanted = set(), {}
    for d, x in sorted(rows):
        w, gone = SPACE_WORDS.findall(x or ""), set()
        for i in range(len(w) - 19):
            key = tuple(w[i:i + 20])
            gone |= set(range(i, i + 20)) if key in seen else set()
            seen.add(key)
        wanted[d] = (len(w), len(gone), " ".join(y for i, y in enumerate(w) if i not in gone))
    out = substring_dedup.remove_repeats(frame(spark, rows).withColumn("words", F.lit(1)), bucket_bytes=4_000).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.n_removed, r.kept_text) == wanted[r.doc_id]


def test_substring_dedup_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (1, text), (2, None), (3, ""), (4, "one two"), (1, text)]
    out = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
    assert out == [("1", 30, 0), ("1", 30, 0), ("2", 0, 0), ("3", 0, 0), ("4", 2, 0), ("None", 30, 30)]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def substring_brute(rows):
    """Words left of each (doc_id, text): windows are kept once, at their first place; of places with one doc_id any may be first."""
    wanted = collections.defaultdict(set)
    for rank in (False, True):
        seen = set()
        for d, x in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] if rank else [-ord(c) for c in r[1]])):
            w, gone = x.split(), set()
            for i in range(len(w) - 19):
                key = tuple(w[i:i + 20])
                gone |= set(range(i, i + 20)) if key in seen else set()
                seen.add(key)
            wanted[d, x].add(" ".join(y for i, y in enumerate(w) if i not in gone))
    return wanted


@pytest.mark.parametrize("bucket_bytes", [300, 2_000_000])
def test_substring_dedup_rows_without_or_with_one_id(spark, bucket_bytes):
    shared = " ".join(f"s{k}" for k in range(40))
    own = [" ".join(f"{c}{k}" for k in range(n)) for c, n in zip("abcdefg", (3, 90, 0, 7, 30, 1, 55))]
    rows = [(None, f"{own[0]} {shared}"), (None, f"{own[1]} {shared} {own[3]}"), (7, f"{own[2]} {shared} {own[4]}"),
            (8, f"{own[5]} {shared}"), (8, f"{own[6]} {shared} {own[0]}"), (None, " ".join(own)), (None, shared[:40])]
    alone = [(None, f"{own[1]} {shared}"), (None, f"{own[0]} {shared} {own[4]}")]
    twice = [(5, f"{own[6]} {shared}"), (5, f"{own[3]} {shared} {own[1]}")]
    for docs in (rows, alone, twice):
        out = substring_dedup.remove_repeats(frame(spark, docs), bucket_bytes).collect()
        wanted = substring_brute(docs)
        assert sorted(r.n_words for r in out) == sorted(len(x.split()) for _, x in docs)
        left = collections.Counter((r.doc_id, r.kept_text) for r in out)
        assert all(any((d, t) in left for t in wanted[d, x]) for d, x in docs)
        if docs is not rows:
            assert sorted(r.n_removed for r in out) == [0, 40]


@pytest.mark.parametrize("hot", [0, 40])
def test_substring_dedup_with_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_RUNS", hot)
    monkeypatch.setattr(substring_dedup, "BUSY_RUNS", 1)
    calls, plain = [], substring_dedup.hot_passages

    def seen(windows, buckets):
        calls.append(plain(windows, buckets))
        return calls[-1]
    monkeypatch.setattr(substring_dedup, "hot_passages", seen)
    test_substring_dedup(spark)
    assert len(calls) == 1 and "SortMergeJoin" in calls[0]._jdf.queryExecution().toString()


# 10 archive

def test_archive(spark, tmp_path):
    r = random.Random(13)
    rows = [(k, f"http://h/{k}", r.choice(["<p>é</p>", "", None, "x" * 5_000, f"own {k}"])) for k in range(200)]
    rows += [(7_000, None, "own 3"), (None, "http://n", "own 5"), (3, rows[3][1], rows[3][2])]
    pages = frame(spark, rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    out = warc.archived(pages).collect()
    assert len(out) == len(rows)
    first = {}
    for k, _, x in sorted(rows, key=lambda y: (y[0] is not None, y[0] or 0)):
        first.setdefault(x or "", k)
    texts = {k: x or "" for k, _, x in rows}
    for row in out:
        raw = texts[row.page_id].encode()
        assert (row.payload_bytes, row.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        again = first[texts[row.page_id]] != row.page_id
        assert (row.record_type, row.refers_to) == (("revisit", first[texts[row.page_id]]) if again else ("response", None))
        head, body = bytes(row.record).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and body == (b"" if again else raw) + b"\r\n\r\n"
    folder = str(tmp_path / "archive")
    warc.write_archive(pages, folder)
    restored = sorted((str(r.page_id), r.url, r.html) for r in warc.read_pages(spark, folder).collect())
    assert restored == sorted((str(k), u or "", x or "") for k, u, x in rows)
    stored = spark.read.parquet(f"{folder}/payloads")
    assert stored.count() == stored.select("digest").distinct().count() == len({x or "" for *_, x in rows})
    assert {r.record_type for r in warc.archived(pages, min_bytes=10**6).collect()} == {"response"}
    broken = warc.archived(frame(spark, [(1, "http://a/\r\nX: y", "z")], "page_id long, url string, html string")).first()
    assert broken.url == "http://a/ X: y" and broken.payload_bytes == 1
    assert warc.archived(pages.limit(0)).count() == 0


# the pipeline

def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts = {d: r.text for d, r in docs.items() if quality_brute_fast(r.text)}
    near = near_brute(list(texts.items()))
    texts = {d: x for d, x in texts.items() if near[d][1] == d}
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = ALNUM_WORDS.findall((r.text or "").translate(UPPER))
        windows |= {tuple(w[i:i + 13]) for i in range(max(len(w) - 12, min(len(w), 1)))}

    def clean(x):
        w, hit = ALNUM_WORDS.findall((x or "").translate(UPPER)), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                hit |= set(range(i, i + n)) if tuple(w[i:i + n]) in windows else set()
        return not hit or 20 * len(hit) < len(w)
    texts = {d: x for d, x in texts.items() if clean(x)}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == set(texts)
    for d, r in out.items():
        spans = secret_scan.pattern_spans(texts[d])
        assert not secret_scan.pattern_spans(r.text)
        assert (r.text == texts[d] or spans or "[secret]" in r.text) and r.n_chars == len(r.text) and (r.lang, r.source) == (docs[d].lang, docs[d].source)
    import sentencepiece as library
    own = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    assert all(r.piece_ids == own.encode(r.text) for r in out.values())


def quality_brute_fast(x):
    """The verdict of the quality rules, with repeats of eight words found through their windows."""
    w = SPACE_WORDS.findall(x or "")
    n = len(w)
    three = collections.Counter(tuple(w[i:i + 3]) for i in range(n - 2))
    again = {j for i in range(n - 2) if three[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    places = collections.defaultdict(list)
    for i in range(n - 7):
        places[tuple(w[i:i + 8])].append(i)
    covered = {j for found in places.values() if len(found) > 1 for i in found for j in range(i, i + 8)}
    best = 0
    for found in places.values():
        for a in found:
            for b in found:
                k = 0
                while a < b and b + k < n and w[a + k] == w[b + k]:
                    k += 1
                best = max(best, k)
    symbols = sum(c in "#*$%&|<>" for c in x or "")
    return (n >= 50 and 100 * len(again) <= 50 * n and symbols <= 0.1 * sum(map(len, w)) and len(covered) <= 0.5 * n
            and best <= 0.4 * n)


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(None, body, "en", "s", 1), (1, body, "en", "s", 1), (1, body, "en", "s", 1), (2, body, None, None, None), (3, None, "en", "s", 0),
            (4, "", "en", "s", 0), (5, body + " password=abcdefgh12345678 é", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash"))
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, "/root/testdata/sf0.001")
            assert set(given.columns) <= set(out.columns), name
            out.collect()
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "None"]  # 2 and 5 repeat 1
    redacted = {r.doc_id: r for r in corpus_pipeline.secrets_redacted(spark, docs, "").collect()}
    assert redacted[5].text == body + " [secret] é" and redacted[5].n_chars == len(redacted[5].text)


def test_pipeline_stages_take_clashing_columns(spark):
    import corpus_pipeline
    body = " ".join(f"w{k}" for k in range(60))
    names = ["row", "found", "hit", "_row", "_quality", "_contamination", "_secrets", "_text", "count", "component", "a.b", "member"]
    rows = [(1, body, *names), (1, body + " x password=abcdefgh12345678", *names), (2, "short", *names), (9, body.upper(), *names)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])  # no n_chars either
    left = {"quality_rules": 3, "near_duplicates": 2, "decontaminated": 4, "secrets_redacted": 4}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        found = out.collect()
        assert len(found) == left[name] and all(list(r)[2:] == names for r in found), name
    out = corpus_pipeline.encoded(spark, docs, "")
    assert out.columns == [*docs.columns, "piece_ids"] and out.count() == 4
