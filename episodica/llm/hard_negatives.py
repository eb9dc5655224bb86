"""Hard negatives: for each anchor and each of its best positives, the best other-label rows within a window of scores.

Scores are exact integer inner products of quantised vectors. Anchors and candidates are dealt into blocks; a cell of one
anchor block and one candidate block is multiplied in tiles by Strassen's recursion, padded with zeros to even sizes. Every
sum on the way is an integer, and a bound from the lengths of the cell's vectors chooses the numbers that hold all of them
exactly: 32-bit floats, 64-bit floats or int64. So neither the recursion nor the floats change a score. Each cell keeps a
heap of the best positives of every anchor, and in a second pass, when the positives' scores are known, a heap for every
anchor and positive of the best negatives inside its window; heaps of cells merge to the heaps of all rows. Candidates come
in order of ties, so of a tile only scores above a full heap's last are looked at.

Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of different lengths are
padded with zeros. A null vec_id is no anchor, keeps its label, and follows the others in ties. Rows that share a vec_id,
or repeat in full, are rows of their own: each takes part, "other" rows are all but the anchor's own row, and ties among
them are in a fixed order that is not stated. Norms for which a score times 100 would not fit 64 bits raise an error. Empty
tables give no rows; columns beside the three named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import kept

#: Rows of an anchor block and of a candidate block at most; rows a candidate block should have before another is made.
ANCHOR_BLOCK, BLOCK, SMALL_BLOCK = 131_072, 262_144, 4_096
#: What an anchor costs in a block, shipped and with heaps to fill, in shipped rows.
ANCHOR_COST = 2.5
#: Tile of one multiplication, and the size at which the recursion ends: it fits a core's cache, and vectors of 64 are halved.
TILE_ANCHORS, TILE_ROWS, LEAF = 256, 1_024, 32
_HEAP = "anchor bigint, score bigint, vec_id bigint, row bigint"
#: Beyond all scores.
_FAR = 1 << 62


def _levels(m: int, k: int, n: int, leaf: int) -> int:
    """How often matrices of these sizes are halved."""
    levels = 0
    while min(m, k, n) > leaf:
        m, k, n, levels = -(-m // 2), -(-k // 2), -(-n // 2), levels + 1
    return levels


def _parts(x: np.ndarray, levels: int, left: bool) -> np.ndarray | list:
    """The operands that one side gives to the seven products, halved again and again; odd sizes are padded with zeros."""
    if not levels:
        return np.ascontiguousarray(x)
    x = np.pad(x, [(0, -size % (1 << levels)) for size in x.shape])
    i, j = x.shape[0] // 2, x.shape[1] // 2
    x11, x12, x21, x22 = x[:i, :j], x[:i, j:], x[i:, :j], x[i:, j:]
    if left:
        seven = x11 + x22, x21 + x22, x11, x22, x11 + x12, x21 - x11, x12 - x22
    else:
        seven = x11 + x22, x11, x12 - x22, x21 - x11, x22, x11 + x12, x21 + x22
    return [_parts(y, levels - 1, left) for y in seven]


def _multiply(a: np.ndarray | list, b: np.ndarray | list, out: np.ndarray, spare: list[np.ndarray]) -> None:
    """The product of the operands of two sides; ``spare`` holds a quarter of ``out``, of that quarter, and so on."""
    if not spare:
        np.matmul(a, b, out=out)
        return
    i, j = out.shape[0] // 2, out.shape[1] // 2
    c11, c12, c21, c22 = out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:]
    p, *spare = spare
    _multiply(a[6], b[6], c11, spare)
    _multiply(a[5], b[5], c22, spare)
    _multiply(a[2], b[2], c12, spare)
    c22 += c12
    _multiply(a[1], b[1], c21, spare)
    c22 -= c21
    _multiply(a[0], b[0], p, spare)
    c11 += p
    c22 += p
    _multiply(a[3], b[3], p, spare)
    c11 += p
    c21 += p
    _multiply(a[4], b[4], p, spare)
    c11 -= p
    c12 += p


def _room(m: int, n: int, levels: int, kind: np.dtype) -> list[np.ndarray]:
    """Room for a product of this size, padded, and for quarters of it."""
    m, n = -(-m >> levels) << levels, -(-n >> levels) << levels
    return [np.empty((m >> k, n >> k), kind) for k in range(levels + 1)]


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two matrices by seven half-sized products; odd sizes are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    levels = _levels(m, k, n, leaf)
    out, *spare = _room(m, n, levels, a.dtype)
    _multiply(_parts(a, levels, True), _parts(b, levels, False), out, spare)
    return out[:m, :n]


def _exact(left: np.ndarray, right: np.ndarray, levels: int) -> np.dtype:
    """The numbers that hold all sums of a product: operands double their length at each level, and four products are added."""
    norms = [float(np.einsum("ij,ij->i", x, x, dtype=np.float64).max(initial=0.0)) for x in (left, right)]
    bound = 1.001 * (norms[0] * norms[1]) ** 0.5 * 4.0 ** (levels + 1)
    return np.dtype(np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of a matrix, padded with zeros to the longest."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    if len(flat) == width * len(lengths):
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class _Block:
    """Rows of a cell in order of ties: vec_id with null last, then row."""

    def __init__(self, table: pa.Table):
        null = np.asarray(table["vec_id"].is_null())
        ids = table["vec_id"].fill_null(0).to_numpy()
        rows = table["row"].to_numpy()
        order = np.lexsort((rows, ids, null))
        self.ids, self.null, self.rows = ids[order], null[order], rows[order]
        self.labels = table["label"].to_numpy()[order]
        self.vectors = _matrix(table["vector"])[order]
        if "positives" in table.column_names:
            scores = _matrix(table["positives"])[order]
            known = np.arange(scores.shape[1]) < pc.list_value_length(table["positives"]).fill_null(0).to_numpy()[order, None]
            self.positives = scores, known


def _first(anchor: np.ndarray, fits: np.ndarray, n: int) -> np.ndarray:
    """Of entries ordered by anchor and preference, the first ``n`` fitting ones of each anchor."""
    picked = np.flatnonzero(fits)
    own = anchor[picked]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
    return picked[place < n]


class _Heaps:
    """The ``n`` best scores of each anchor inside each of its windows from ``floor`` to ``top``, with their places.

    What a tile has is held until it is as much as the heaps hold; ``merge`` then cuts all heaps to ``n`` and raises ``least``,
    the score from which a window still takes one of a later place.
    """

    def __init__(self, floor: np.ndarray, top: np.ndarray, n: int):
        self.floor, self.top, self.n = floor, top, n
        self.least = np.where(floor > top, _FAR, floor)
        self.low, self.high = self.least.min(axis=1, initial=_FAR), top.max(axis=1, initial=-_FAR)
        self.best, self.more, self.held = np.zeros((3, 0), np.int64), [], 0

    def add(self, anchor: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        self.more.append(np.stack([anchor, score.astype(np.int64), place]))
        self.held += len(anchor)

    def search(self, anchor: np.ndarray, place: np.ndarray, scores: np.ndarray, barred) -> None:
        """Hold what a tile has; ``barred`` says which pairs of some anchors and all places are none."""
        largest = scores[np.arange(len(anchor)), scores.argmax(axis=1)]
        some = np.flatnonzero(largest >= self.low[anchor].astype(scores.dtype))
        if not len(some):
            return
        anchor, scores = anchor[some], scores[some]
        low, high = (x[anchor].astype(scores.dtype)[:, None] for x in (self.low, self.high))
        fits = (scores >= low) & (scores <= high)
        some = np.flatnonzero(fits.any(axis=1))
        if not len(some):
            return
        anchor, scores, fits = anchor[some], scores[some], fits[some]
        fits &= ~barred(anchor, place)
        many = np.count_nonzero(fits, axis=1) > 4 * self.n
        if many.any():
            self._search_many(anchor[many], place, np.where(fits[many], scores[many], self._none(scores)))
            fits[many] = False
        i, j = np.divmod(np.flatnonzero(fits), len(place))   # few: faster than in two dimensions
        self.add(anchor[i], scores[i, j], place[j])

    def _search_many(self, anchor: np.ndarray, place: np.ndarray, scores: np.ndarray) -> None:
        """The ``n`` largest scores of each row and window, the first of equal ones: ties may be as many as there are rows."""
        for window in range(self.top.shape[1]):
            least, top = (x[anchor, window].astype(scores.dtype) for x in (self.least, self.top))
            left = np.where(scores <= top[:, None], scores, self._none(scores))
            for _ in range(self.n):
                j = left.argmax(axis=1)
                i = np.flatnonzero(left[np.arange(len(left)), j] >= least)
                self.add(anchor[i], left[i, j[i]], place[j[i]])
                left[np.arange(len(left)), j] = self._none(scores)

    @staticmethod
    def _none(scores: np.ndarray) -> float | int:
        return -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min

    def merge(self) -> np.ndarray:
        """(anchor, score, place) of all heaps; an entry of several windows is one."""
        held = np.concatenate([self.best, *self.more], axis=1)
        held = held[:, np.lexsort((held[2], -held[1], held[0]))]
        held = held[:, np.r_[True, (held[:, 1:] != held[:, :-1]).any(axis=0)]] if held.shape[1] else held
        anchor, score = held[:2]
        stays = np.zeros(len(anchor), bool)
        for window in range(self.top.shape[1]):
            floor, top = self.floor[anchor, window], self.top[anchor, window]
            picked = _first(anchor, (score >= floor) & (score <= top), self.n)
            stays[picked] = True
            last = picked[self.n - 1:][anchor[picked[self.n - 1:]] == anchor[picked[:max(0, len(picked) - self.n + 1)]]]  # of full heaps
            more = score[last] + 1
            self.least[anchor[last], window] = np.where(more > self.top[anchor[last], window], _FAR, more)
        self.low = self.least.min(axis=1, initial=_FAR)
        self.best, self.more, self.held = held[:, stays], [], 0
        return self.best

    def merge_if_full(self, tiles: int) -> None:
        """After the first, second, fourth ... tile, and when as much is held as the heaps hold."""
        if tiles & (tiles - 1) == 0 or self.held > max(self.best.shape[1], 1 << 16):
            self.merge()


def _tiles(places: np.ndarray, most: int) -> list[np.ndarray]:
    return [places[k:k + most] for k in range(0, len(places), most)]


def _cell(anchors: pa.Table, rows: pa.Table, n: int, low: int | None, base: int) -> pa.Table:
    """Heaps of one cell: positives if ``low`` is None, else the negatives with low * p <= base * score <= base * p of any p."""
    left, right = _Block(anchors), _Block(rows)
    if low is None:
        windows = np.full((len(left.ids), 1), -_FAR), np.full((len(left.ids), 1), _FAR)
        pairs = [(np.flatnonzero(left.labels == v), np.flatnonzero(right.labels == v)) for v in np.unique(left.labels)]
    else:
        p, known = left.positives
        windows = np.where(known, -((-low * p) // base), _FAR), np.where(known, p, -_FAR)
        pairs = [(np.arange(len(left.ids)), np.arange(len(right.ids)))]
    names, codes = np.unique(np.r_[left.labels, right.labels], return_inverse=True)
    own, other = np.split(codes.astype(np.uint8 if len(names) < 256 else np.int64), [len(left.ids)])

    def barred(anchor: np.ndarray, place: np.ndarray) -> np.ndarray:
        return left.rows[anchor][:, None] == right.rows[place] if low is None else own[anchor][:, None] == other[place]

    width = max(left.vectors.shape[1], right.vectors.shape[1])
    wide = [np.pad(x.vectors, ((0, 0), (0, width - x.vectors.shape[1]))) for x in (left, right)]
    found = [np.zeros((3, 0), np.int64)]
    for these, those in pairs:
        if not len(these) or not len(those):
            continue
        tiles, heaps = _tiles(np.arange(len(these)), TILE_ANCHORS), _Heaps(*(x[these] for x in windows), n)
        levels = _levels(min(len(these), TILE_ANCHORS), width, min(len(those), TILE_ROWS), LEAF)
        kind = _exact(wide[0][these], wide[1][those], levels)
        sides = [_parts(wide[0][these[some]].astype(kind), levels, True) for some in tiles]
        room = {size: _room(*size, levels, kind) for size in {(len(some), len(place)) for some in tiles for place in _tiles(those, TILE_ROWS)}}
        for k, place in enumerate(_tiles(those, TILE_ROWS), 1):
            side = _parts(wide[1][place].astype(kind).T, levels, False)
            for some, parts in zip(tiles, sides):
                out, *spare = room[len(some), len(place)]
                _multiply(parts, side, out, spare)
                heaps.search(some, place, out[:len(some), :len(place)], lambda anchor, place: barred(these[anchor], place))
            heaps.merge_if_full(k)
        anchor, score, place = heaps.merge()
        found.append(np.stack([these[anchor], score, place]))
    anchor, score, place = np.concatenate(found, axis=1)
    return pa.table([pa.array(left.rows[anchor]), pa.array(score),
                     pa.array(right.ids[place], mask=right.null[place]), pa.array(right.rows[place])],
                    names=["anchor", "score", "vec_id", "row"])


def _merged(heaps: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first ``n`` of each key over all cells, with ``rank`` from 1."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row"))
    return heaps.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def quantised(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", factor: int = 256) -> DataFrame:
    """(row, vec_id, label, vector): the rows that take part, with integer components floor(factor * x)."""
    values = F.col(f"`{vector}`")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(values, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))
    norm = F.aggregate(whole, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    taken = rows.filter(F.col(f"`{label}`").isNotNull() & values.isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("bigint").alias("vec_id"),
        F.col(f"`{label}`").cast("bigint").alias("label"), whole.alias("vector"), norm.alias("norm"))
    safe = F.when(F.col("norm") < 2.0 ** 63 / 128, F.col("vector")).otherwise(
        F.raise_error(F.lit("a vector is too long for exact 64-bit scores")))
    return taken.select("row", "vec_id", "label", safe.cast("array<int>").alias("vector"))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, base: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``quantised`` rows.

    ``rows`` should be a written table: it is read several times, and its row ids must stay.
    """
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("anchors")).first()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = -(-sizes["n"] // SMALL_BLOCK)
    wanted = min(parts, small)   # cells, so dealt that anchors and rows in all of them cost least
    anchor_blocks = max(1, -(-sizes["anchors"] // ANCHOR_BLOCK), round((wanted * ANCHOR_COST * sizes["anchors"] / max(1, sizes["n"])) ** 0.5))
    blocks = max(1, -(-sizes["n"] // BLOCK), min(small, -(-wanted // anchor_blocks)))

    def dealt(frame: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        """Each row for all cells it is in; the number of tasks is given, as small cells are work too."""
        return frame.withColumns({own: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"),
                                  other: F.explode(F.sequence(F.lit(0), F.lit(others - 1)))}).repartition(
            anchor_blocks * blocks, "anchor_block", "block").groupBy("anchor_block", "block")

    def cells(anchors: DataFrame, least: int | None, n: int) -> DataFrame:
        left = dealt(anchors, "anchor_block", anchor_blocks, "block", blocks)
        right = dealt(rows, "block", blocks, "anchor_block", anchor_blocks)
        return left.cogroup(right).applyInArrow(lambda a, b: _cell(a, b, n, least, base), _HEAP)

    anchors = kept(rows.filter(is_anchor), "anchors")
    best = kept(_merged(cells(anchors, None, positives), positives, "anchor").select(
        "anchor", (F.col("rank") - 1).alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    known = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("positive", "positive_score"))).alias("s")).select(
        F.col("anchor").alias("row"), F.col("s.positive_score").alias("positives"))  # ``positives`` scores at most
    inside = (F.col("positive_score") * low <= F.col("score") * base) & (F.col("score") <= F.col("positive_score"))
    found = _merged(cells(anchors.join(known, "row"), low, negatives).join(best, "anchor").filter(inside), negatives, "anchor", "positive")
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
