"""Near-duplicate documents with b-bit MinHash.

A document's set holds its distinct shingles of five words (A-Z lower-cased); a shorter text is one shingle. For each set
HASHES minima are taken; BANDS bands of ROWS of them give bucket keys, and the low BITS bits of all minima are packed into
a signature. Equal sets are one class, held by its smallest doc_id, so exact copies never meet in a bucket.

Each bucket names its smallest member as pivot; the members of all buckets of a pivot are its canopy. Within a canopy,
signatures are compared by bit counts, similarities are corrected for chance collisions, and members whose estimate
reaches the threshold less seven standard errors form groups. In a large canopy every member is compared with the pivot
first, row by row, and those near it are the pivot's group. The full sets of a group confirm links with exact integer
arithmetic; a connected forest of the confirmed links leaves the group, never all pairs. Components of the forests are
found by alternating stars on written edges.

Bounds: in a canopy above CANOPY_BLOCK members only those that are not near the pivot meet all others, in pairs of blocks; a
group above GROUP_BLOCK members or BLOCK_SHINGLES shingles is confirmed in blocks that each hold its smallest member, and
then every member that is not yet linked to the smallest one meets all others, again in pairs of blocks. So a group of near
copies of one text costs its size, and no pair of a group is left out. A link whose two
sets share no bucket is lost: with 32 bands of 4 rows that happens to 5 in a million links of similarity 0.75, less above.

Null, empty and wordless texts have an empty set, link with nothing and stay. A row without doc_id is linked with nothing,
has no component and stays. Rows that share a doc_id are one document. Very long texts are taken whole; ties cannot occur, as
ids differ. Extra columns are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .groups import components, kept, per_group

SHINGLE, THRESHOLD = 5, 75
HASHES, BANDS, ROWS, BITS = 256, 32, 4, 4
#: Seven standard errors of the estimate at the threshold: 7 * sqrt(p (1 - p) / HASHES) / (1 - 2**-BITS), p = 0.766.
MARGIN = 0.2
CANOPY_BLOCK, GROUP_BLOCK, BLOCK_SHINGLES = 512, 256, 500_000
#: Size of the bitmap that holds back texts without a candidate.
FILTER_BITS = 1 << 25
_random = np.random.default_rng(31)
_FACTORS = _random.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _random.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_NUMBERS = tokens.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_LANES = np.uint64(0x1111111111111111)


def shingle_sets(chunk: tokens.Chunk) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data = tokens.LOWER[chunk.data]
    w = tokens.words(chunk, data, tokens.SPACE_WORDS)
    hashes = tokens.word_hashes(data, w)
    windows = tokens.window_hashes(hashes, SHINGLE)
    sets = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= SHINGLE:
            found = np.sort(windows[a:b - SHINGLE + 1])
            distinct = np.ones(len(found), bool)
            distinct[1:] = found[1:] != found[:-1]
            sets.append(found[distinct])
        else:
            sets.append(tokens.window_hashes(hashes[a:b], b - a) if b > a else hashes[:0])
    return sets


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each set; no set may be empty."""
    joined = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint64)
    scratch = np.empty_like(joined)
    for k in range(HASHES):
        np.multiply(joined, _FACTORS[k], out=scratch)
        out[:, k] = np.minimum.reduceat(scratch, starts)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of scrambled minima, in words of 64 bits."""
    lanes = (tokens.mix(low) & np.uint64(2**BITS - 1)).reshape(len(low), -1, 64 // BITS)
    return np.bitwise_or.reduce(lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarities of one signature to many: differing lanes by bit count, corrected for lanes that agree by chance."""
    x = one ^ many
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    agree = 1 - np.bitwise_count(x & _LANES).sum(axis=1) / HASHES
    return (agree - 2**-BITS) / (1 - 2**-BITS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in tokens.chunks(batch.column(1)):
            sets = shingle_sets(chunk)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            bands: list = [None] * len(sets)
            signatures: list = [None] * len(sets)
            if len(full):
                low = minima([sets[k] for k in full])
                keys = tokens.mix((low[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS) * _BAND_FACTORS).sum(axis=2) + _BAND_NUMBERS)
                words = packed(low)
                for k, key, word in zip(full.tolist(), keys.view(np.int64), words):
                    bands[k], signatures[k] = key, word.tobytes()
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first_row, chunk.rows), pa.array(sizes), pa.array(digests, pa.string()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                names=["doc_id", "n", "digest", "bands", "signature"])


def _linked_groups(canopy: pa.Table) -> pa.Table | None:
    """(group, member): members whose estimates connect them, named by the smallest."""
    n = canopy.num_rows
    if n < 2:
        return None
    members = canopy.column("member").to_numpy()
    order = np.argsort(members)
    members = members[order]
    signs = np.frombuffer(b"".join(canopy.column("signature").to_pylist()), np.uint64).reshape(n, -1)[order]
    label = np.full(n, -1)
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start] = start
        queue = [start]
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(label < 0)
            if not len(rest):
                break
            near = rest[estimates(signs[x], signs[rest]) >= THRESHOLD / 100 - MARGIN]
            label[near] = start
            queue.extend(near.tolist())
    found = np.bincount(label, minlength=n)[label] > 1
    return pa.table({"group": members[label[found]], "member": members[found]})


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def _confirmed(group: pa.Table) -> pa.Table | None:
    """Stars of the components of the exact links of a group, whose first member is expanded first."""
    n = group.num_rows
    if n < 2:
        return None
    members = group.column("member").to_numpy()
    order = np.argsort(members)
    members = members[order]
    sets: list[np.ndarray] = []
    for chunk in tokens.chunks(group.column("text")):
        sets += shingle_sets(chunk)
    sets = [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets])
    joined = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    by_value = np.argsort(joined, kind="stable")
    values, owner = joined[by_value], owner[by_value]
    union = _Union(n)
    for x in range(n):
        if x and union.find(x) == 0:  # whoever links with it expands, or is with the first one too
            continue
        low, high = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
        spread = high - low
        at = np.arange(int(spread.sum())) + np.repeat(low - (np.cumsum(spread) - spread), spread)
        shared = np.bincount(owner[at], minlength=n)
        for y in np.flatnonzero(100 * shared >= THRESHOLD * (sizes[x] + sizes - shared)).tolist():
            union.join(x, y)
    roots = np.array([union.find(x) for x in range(n)])
    linked = np.flatnonzero(roots != np.arange(n))
    return pa.table({"a": members[linked], "b": members[roots[linked]]})


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Is a member's signature near its pivot's?"""
    for batch in batches:
        own, pivot = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (3, 4))
        near = estimates(pivot, own) >= THRESHOLD / 100 - MARGIN
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near)], names=["group", "member", "blocks", "near"])


def _with_cells(rows: DataFrame, owner: str, blocks: DataFrame) -> DataFrame:
    """Rows with ``cell``: that of the block they belong to; the owner belongs to all blocks."""
    block = F.pmod(F.xxhash64("member"), F.col("blocks"))
    all_blocks = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    own = F.when(F.col("member") == F.col(owner), all_blocks).otherwise(F.array(block))
    return (rows.join(blocks, owner, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
            .withColumn("cell", F.explode(own)).withColumn("cell", F.xxhash64(owner, "cell")).drop("blocks"))


def _outside_cells(labelled: DataFrame) -> DataFrame:
    """(cell, member): cells in which each ``outside`` member of a group meets all its members, themselves in ``blocks`` blocks.

    Those outside are dealt into as few blocks of their own as their share asks for, so a few of them cost a group's size.
    """
    sizes = labelled.groupBy("group").agg(F.count(F.lit(1)).alias("k"), F.count_if("outside").alias("o"), F.max("blocks").alias("b"))
    sizes = kept(sizes.filter("o > 0").select("group", F.ceil(F.col("o") * F.col("b") / F.col("k")).alias("rows")), "outside")
    joined, key = labelled.join(sizes, "group"), F.xxhash64("member")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    ours = joined.filter("outside").select("group", "member", F.pmod(key, F.col("rows")).alias("i"), every("blocks").alias("j"))
    theirs = joined.select("group", "member", every("rows").alias("i"), F.pmod(key, F.col("blocks")).alias("j"))
    return ours.unionByName(theirs).select(F.xxhash64("group", "i", "j").alias("cell"), "member").distinct()


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed rows, classes (digest, rep), forest (a, b) of the confirmed links between classes) of doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = kept(docs.mapInArrow(_sign, "doc_id bigint, n bigint, digest string, bands array<bigint>, signature binary"), "signed")
    known = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = kept(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = kept(known.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi")
                .dropDuplicates(["digest"]).select(F.col("doc_id").alias("member"), "n", "bands", "signature"), "reps")
    banded = reps.select("member", F.explode("bands").alias("band"))
    buckets = kept(banded.groupBy("band").agg(F.min("member").alias("pivot"), F.max("member").alias("last"))
                   .filter("pivot <> last").select("band", "pivot"), "buckets")
    canopies = kept(banded.join(buckets, "band").select("pivot", "member").distinct(), "canopies")
    large = kept(canopies.groupBy("pivot").count().filter(F.col("count") > CANOPY_BLOCK)
                 .select("pivot", F.ceil(F.col("count") / CANOPY_BLOCK).alias("blocks")), "large")
    signatures, cells, stars = reps.select("member", "signature"), canopies, None
    if not large.isEmpty():
        pivots = signatures.select(F.col("member").alias("pivot"), F.col("signature").alias("other"))
        compared = canopies.join(large, "pivot").join(signatures, "member").join(pivots, "pivot").select(
            F.col("pivot").alias("group"), "member", "blocks", "signature", "other")
        stars = kept(compared.mapInArrow(_near, "group bigint, member bigint, blocks bigint, near boolean"), "stars")
        cells = canopies.join(large, "pivot", "left_anti")
    cells = cells.select(F.xxhash64("pivot").alias("cell"), "member")
    if stars is not None:
        cells = cells.unionByName(_outside_cells(stars.select("group", "member", "blocks", (~F.col("near")).alias("outside"))))
    groups = per_group(cells.join(signatures, "member"), "cell", "group bigint, member bigint", _linked_groups)
    if stars is not None:
        groups = groups.unionByName(stars.filter("near").select("group", "member"))
    groups = kept(groups.distinct(), "groups")
    sized = groups.join(reps.select("member", "n"), "member").groupBy("group").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    split = kept(sized.filter((F.col("k") > GROUP_BLOCK) | (F.col("n") > BLOCK_SHINGLES))
                 .select("group", F.ceil(F.greatest(F.col("k") / GROUP_BLOCK, F.col("n") / BLOCK_SHINGLES)).alias("blocks")), "split")
    texts = docs.withColumnRenamed("doc_id", "member")
    cells = _with_cells(groups, "group", split).select("cell", "member")
    edges = kept(_confirm(cells, texts), "links")
    if not split.isEmpty():
        edges = edges.unionByName(kept(_confirm(_rest(groups, split, components(edges)), texts), "links"))
    return signed, classes, edges


def _confirm(cells: DataFrame, texts: DataFrame) -> DataFrame:
    rows = cells.join(_likely(texts, cells), "member")
    return per_group(rows.select("cell", "member", "text"), "cell", "a bigint, b bigint", _confirmed)


def _likely(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """Texts whose member's hash is among those of the cells, so that few others are shuffled for the join.

    The hashes are a bitmap of FILTER_BITS bits, in pieces of 32,768: what is broadcast has that bound at any size, and a
    full bitmap lets everything through.
    """
    place = F.pmod(F.xxhash64("member"), F.lit(FILTER_BITS))
    piece, bit = F.shiftright(place, 15), place.bitwiseAND(32_767)
    bits = cells.select(piece.alias("_piece"), bit.alias("_bit")).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    found = texts.withColumns({"_piece": piece, "_bit": bit.cast("int")}).join(F.broadcast(bits), "_piece")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    test = F.expr("shiftright(_byte, _bit % 8) % 2 = 1")
    return found.withColumn("_byte", byte).filter(test).select("member", "text")


def _rest(groups: DataFrame, split: DataFrame, found: DataFrame) -> DataFrame:
    """Cells in which each member of a split group outside its smallest member's component meets all members."""
    rows = groups.join(split, "group")
    labelled = rows.join(found, rows["member"] == found["node"], "left").select(
        "group", "member", "blocks", F.coalesce("component", "member").alias("component"))
    main = labelled.filter(F.col("group") == F.col("member")).select("group", F.col("component").alias("main"))
    return _outside_cells(labelled.join(main, "group").select("group", "member", "blocks", (F.col("component") != F.col("main")).alias("outside")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept for every row; needs doc_id and text."""
    signed, classes, edges = links(docs)
    found = components(edges)
    named = kept(classes.join(found, classes["rep"] == found["node"], "left")
                 .select("digest", F.coalesce("component", "rep").alias("component")), "named")
    rows = signed.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                       F.col("doc_id").eqNullSafe(component).alias("kept"))
