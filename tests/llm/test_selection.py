"""Fingerprints, hard negatives and importance resampling against brute force on small fixtures with every odd case."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from episodica.llm import fingerprints, hard_negatives, importance
from episodica.llm.groups import kept
from episodica.llm.queries import QUERIES
from episodica.operators.ranking import range_number
from episodica.session import ship_package

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# 11 fingerprints

def shingles(text):
    w = WORDS.findall(text.lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def shingle_hash(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed >> 16


def sketch_of(sets, scale=8):
    h = {shingle_hash(s) for s in sets}
    below = {x for x in h if x < 2**48 // scale}
    return sorted(below or ({min(h)} if h else set()))


def like(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def fingerprint_rows():
    r = random.Random(5)
    texts = [" ".join(f"W{r.randint(0, 60)}é" for _ in range(r.choice((1, 3, 5, 9, 60, 400)))) for _ in range(60)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, " \n"), (503, "a\tb\x0bc"), (504, texts[0]), (-7, texts[5] * 40)]
    return rows + [(None, "no id"), (None, "other"), (77, "first of one id"), (77, "second of one id")] + [(78, "same row")] * 30


def test_fingerprint_query_equals_brute_force(spark, tmp_path):
    rows = fingerprint_rows()
    data = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).repartition(5)
    data.write.parquet(str(tmp_path / "documents.parquet"))
    ordered = sorted(((d is None, d or 0, hashlib.sha256((t or "").encode()).hexdigest()), d, t or "") for d, t in rows)
    wanted = []
    for k, (_, d, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][2]
        changed = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        a, b, c = (sketch_of(shingles(x)) for x in (t, changed, after))
        wanted.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), "".join(f"{h:012x}" for h in a),
                       "".join(f"{h:012x}" for h in b), like(a, b), like(a, c)))
    got = QUERIES["op11_document_fingerprints"](spark, str(tmp_path)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))


def test_fingerprints_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["op11_document_fingerprints"](spark, str(tmp_path)).count() == 0


def test_sketches_merge_and_estimate_containment(spark):
    r = random.Random(8)
    long = [f"x{r.randint(0, 10**6)}" for _ in range(20_000)]
    part, other = long[3_000:4_000], [f"y{r.randint(0, 10**6)}" for _ in range(1_000)]
    rows = spark.createDataFrame([(" ".join(long), " ".join(part), " ".join(other))], "a string, b string, c string")
    for c in "abc":
        rows = fingerprints.with_sketch(rows, c, f"s{c}")
    got = rows.select(fingerprints.containment(F.col("sb"), F.col("sa")).alias("inside"),
                      fingerprints.containment(F.col("sc"), F.col("sa")).alias("outside"),
                      fingerprints.merged(F.col("sb"), F.col("sc")).alias("m"), fingerprints.merged(F.array(F.lit(1 << 47)), F.col("sc")).alias("n"), "sc").first()
    assert got["inside"] == 1.0 and got["outside"] == 0.0
    assert got["m"] == sketch_of(shingles(" ".join(part)) | shingles(" ".join(other))) and got["n"] == got["sc"]
    half = spark.createDataFrame([(" ".join(part), " ".join(part[:500] + other[:500]))], "a string, b string")
    half = fingerprints.with_sketch(fingerprints.with_sketch(half, "a", "s"), "b", "t")
    assert abs(half.select(fingerprints.containment(F.col("s"), F.col("t"))).first()[0] - 0.5) < 0.12


def test_sketch_plans_have_no_python(spark, tmp_path):
    spark.createDataFrame(fingerprint_rows(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = QUERIES["op11_document_fingerprints"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# 12 hard negatives

@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 33, 50), (64, 64, 64), (65, 20, 131), (40, 0, 5), (256, 64, 100)])
def test_strassen_is_exact(shape):
    r = np.random.default_rng(3)
    m, k, n = shape
    a, b = r.integers(-2**24, 2**24, (m, k)), r.integers(-2**24, 2**24, (k, n))
    assert (hard_negatives.strassen(a, b, 4) == a.astype(object) @ b.astype(object)).all() if k else (hard_negatives.strassen(a, b, 4) == 0).all()


def negatives_brute(rows):
    valid = []
    for row, (v, label, x) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if v is not None and v % 7 == 0:
            label = (label + 1) % 10
        valid.append((row, v, label, [math.floor(256 * c) for c in x]))
    out = []
    for row, v, label, x in valid:
        if v is None or v % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), w is None, w or 0, k, other == label) for k, w, other, y in valid if k != row)
        for s, null, w, k, same in [c for c in scored if c[4]][:5]:
            fits = [c for c in scored if not c[4] and 80 * -s <= 100 * -c[0] <= 100 * -s][:5]
            out += [(v, None if null else w, i + 1, None if c[1] else c[2], -s, -c[0]) for i, c in enumerate(fits)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("blocks", [(131_072, 262_144, 4_096, 256, 4_096), (2, 60, 60, 2, 16)])
def test_hard_negatives_equal_brute_force(spark, tmp_path, monkeypatch, blocks):
    for name, value in zip(("ANCHOR_BLOCK", "BLOCK", "SMALL_BLOCK", "TILE_ANCHORS", "TILE_ROWS"), blocks):
        monkeypatch.setattr(hard_negatives, name, value)
    r = random.Random(4)
    # few distinct components: many ties; floats that are exact in 32 bits
    rows = [(i, r.randint(0, 9), [r.choice((-0.25, 0.0, 0.125, 0.5, 1.0)) for _ in range(6)]) for i in range(420)]
    rows += [(1_000, 3, None), (1_001, None, [1.0] * 6), (1_002, 3, [1.0, None]), (1_003, 3, [float("nan")] * 6), (1_004, 3, [float("inf")] * 6),
             (None, 1, [1.0] * 6), (1_100, 2, []), (1_101, 2, [1.0]), (1_200, 4, [1.0, 0.5, 0.25]), (1_300, 77, [1.0] * 6)]
    rows += [(1_400, 5, [0.5] * 6)] * 3   # an anchor repeated in full
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("row", F.lit(1)).repartition(3).write.parquet(
        str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op12_hard_negatives"](spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(x)) for x in got) == negatives_brute(rows)


def test_hard_negatives_of_few_rows(spark, tmp_path):
    kind = "vec_id long, label int, embedding array<float>"
    for k, rows in enumerate(([], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 2, [1.0])])):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / str(k) / "embeddings.parquet"))
        assert QUERIES["op12_hard_negatives"](spark, str(tmp_path / str(k))).count() == 0
    huge = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1.0])], kind)
    with pytest.raises(Exception, match="too long for exact"):
        hard_negatives.quantised(huge).collect()


def cell_table(ids, labels, vectors, positives=None):
    table = {"row": pa.array(ids, pa.int64()), "vec_id": pa.array([i or None for i in ids], pa.int64()), "label": pa.array(labels, pa.int64()),
             "vector": pa.array([list(map(int, v)) for v in vectors], pa.list_(pa.int32()))}
    return pa.table(table if positives is None else table | {"positives": pa.array(positives, pa.list_(pa.int64()))})


def cell_brute(ids, labels, vectors, anchors, positives, n=3, low=80):
    """Entries of positives without ``positives``, else of the negatives of any of them."""
    out = set()
    scores = vectors[anchors].astype(object) @ vectors.T.astype(object)
    for a, k in enumerate(anchors):
        order = sorted((-scores[a, j], ids[j] == 0, ids[j], j) for j in range(len(ids)))
        if positives is None:
            out |= {(ids[k], -s, i) for s, _, i, j in [o for o in order if o[3] != k and labels[o[3]] == labels[k]][:n]}
        for p in positives[a] if positives else []:
            fits = [o for o in order if labels[o[3]] != labels[k] and low * p <= -100 * o[0] <= 100 * p]
            out |= {(ids[k], -s, i) for s, _, i, j in fits[:n]}
    return out


@pytest.mark.parametrize("largest, kind", [(40, np.float32), (4_000, np.float64), (20_000_000, np.int64)])
@pytest.mark.parametrize("few", [False, True])
def test_cells_of_halved_tiles_are_exact(monkeypatch, largest, kind, few):
    """Vectors of 64 are halved in tiles that are halved too; ``few`` different ones give more ties than a heap holds."""
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", 70)
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 150)
    r = np.random.default_rng(6)
    vectors = r.integers(-largest, largest + 1, (400, 64))
    vectors = vectors[r.integers(0, 5, 400)] if few else vectors
    ids, labels, anchors = list(range(400)), r.integers(0, 4, 400).tolist(), list(range(0, 400, 4)) + [1]
    assert hard_negatives._exact(vectors, vectors, 1) == kind

    def entries(positives):
        left = cell_table([ids[k] for k in anchors], [labels[k] for k in anchors], vectors[anchors], positives)
        found = hard_negatives._cell(left, cell_table(ids, labels, vectors), 3, 80 if positives else None, 100)
        rows = list(zip(*(found[c].to_pylist() for c in ("anchor", "score", "row"))))
        assert len(rows) == len(set(rows)) and found["vec_id"].to_pylist() == [x or None for *_, x in rows]
        return set(rows)

    best = entries(None)
    assert best == cell_brute(ids, labels, vectors, anchors, None)
    positives = [sorted((s for a, s, _ in best if a == ids[k]), reverse=True) for k in anchors]
    positives[3:6] = [None, [], [-100, -200]]
    assert entries(positives) == cell_brute(ids, labels, vectors, anchors, [p or [] for p in positives])


def test_cells_take_little_time_and_hold_few_entries(monkeypatch):
    """Twenty million pairs took 12 CPU seconds in int64; of equal scores a tile's first are held."""
    r = np.random.default_rng(8)
    unit = r.normal(size=(20_000, 64))
    vectors = np.floor(256 * unit / np.linalg.norm(unit, axis=1)[:, None]).astype(np.int64)
    vectors[10_000:] = vectors[0]
    labels = r.integers(0, 10, 20_000)
    rows = cell_table(range(1, 20_001), labels, vectors)
    anchors = rows.slice(9_500, 1_000)
    held, add = [], hard_negatives._Heaps.add

    def counted(self, anchor, *entries):
        held.append(len(anchor))
        add(self, anchor, *entries)

    monkeypatch.setattr(hard_negatives._Heaps, "add", counted)
    began = time.process_time()
    best = hard_negatives._cell(anchors, rows, 5, None, 100)
    positives = [[] for _ in range(1_000)]
    for a, s in zip(best["anchor"].to_pylist(), best["score"].to_pylist()):
        positives[a - 9_501].append(s)
    hard_negatives._cell(anchors.append_column("positives", pa.array([sorted(p, reverse=True) for p in positives])), rows, 5, 80, 100)
    assert time.process_time() - began < 6
    assert best.num_rows == 5_000 and sum(held) < 400_000


# 13 importance resampling

def importance_brute(docs, items, n=1, buckets=10_000, least=20):
    def feats(text):
        w = ALNUM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    s, t = (Counter(b for x in texts for b in feats(x)[1]) for texts in ([x for _, x in docs], items))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out = []
    for d, x in docs:
        words, f = feats(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least])
    able = sorted((-o[3], o[0] is None, o[0] or 0) for o in out if o[4])
    rank = {}
    for k, key in enumerate(able[:10 * len(able) // 100]):
        rank.setdefault(key, []).append(k + 1)
    done = []
    for o in out:
        mine = rank.get((-o[3], o[0] is None, o[0] or 0)) if o[4] else None
        done.append((*o[:4], mine.pop() if mine else None))
    return sorted(map(repr, done))


def importance_rows():
    r = random.Random(9)
    docs = [(i, " ".join(r.choice(("apple", "Bär", "c3", "delta", "É", "x" * r.randint(1, 9))) for _ in range(r.randint(0, 60))) + r.choice(("", ".", "\x00!")))
            for i in range(300)]
    docs += [(400, None), (401, ""), (402, "-- ,, "), (403, "word " * 30_000), (None, "apple " * 25)] + [(404, "apple pie " * 12)] * 40
    r.shuffle(docs)
    return docs, ["Apple pie, delta!", None, "", "c3 c3 unseen"]


@pytest.mark.parametrize("items", [True, False])
def test_importance_query_equals_brute_force(spark, tmp_path, items):
    docs, target = importance_rows()
    target = target if items else []
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("weight", F.lit("clash")).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = QUERIES["op13_importance_resampling"](spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(x)) for x in got) == importance_brute(docs, target)


def test_importance_of_more_rows_than_a_step(spark, tmp_path):
    r = random.Random(12)
    docs = [(i, " ".join(f"{r.choice('ABcdé')}{r.randint(0, 400)}" for _ in range(r.randint(10, 30)))) for i in range(5_000)]
    target = [docs[i][1] for i in range(0, 5_000, 50)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = QUERIES["op13_importance_resampling"](spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(x)) for x in got) == importance_brute(docs, target)


@pytest.mark.parametrize("step", [importance.STEP_BYTES, 50])
def test_steps_of_slices(step):
    import pyarrow as pa
    docs, _ = importance_rows()
    texts = pa.array([x if x and len(x) < 1_000 else "" for _, x in docs])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    whole = [ALNUM.findall(x.translate(lower)) for x in texts.to_pylist()]
    got = []
    for part in importance.steps(texts.slice(100, 150), step):
        rows, codes, dictionary = importance.word_codes(part)
        got += [[dictionary[c].decode() for c in codes[rows == k]] for k in range(len(part))]
    assert got == whole[100:250]


@pytest.mark.parametrize("step", [importance.STEP_BYTES, 50])
def test_features_of_longer_runs(monkeypatch, step):
    import pyarrow as pa
    docs, _ = importance_rows()
    texts = [x for _, x in docs if len(x or "") < 1_000]
    got, first = Counter(), 0
    for part in importance.steps(pa.array(texts), step):
        for rows, hashed in importance.features(part, 3, 997):
            got.update(zip((rows + first).tolist(), hashed.tolist()))
        first += len(part)
    wanted = Counter()
    for k, x in enumerate(texts):
        w = ALNUM.findall((x or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        wanted.update((k, zlib.crc32(" ".join(w[i:i + n]).encode()) % 997) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert got == wanted


def test_importance_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, importance int, `a.b` string")
    out = importance.weighted(docs, docs).withColumn("in", F.lit(True))
    row = importance.drawn(out.withColumn("w", F.col("importance.weight")), "doc_id", "w", "in", 100, 1).first()
    assert row["a.b"] == "x" and row["importance"]["n_words"] == 2 and row["rank"] == 1
    empty = importance.weighted(docs.limit(0), docs)
    assert empty.count() == 0


def test_range_numbers_cut_through_equal_keys(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 15_000, F.lit(7)).when(F.col("id") == 15_000, F.lit(10**15)).otherwise(F.col("id")).alias("k"), "id")
    numbered = kept(range_number(rows, [F.col("k")]), "numbered")
    got = numbered.orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(20_000)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
