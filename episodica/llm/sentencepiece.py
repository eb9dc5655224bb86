"""SentencePiece encoding and decoding with a public byte-fallback BPE model.

A text becomes words that no piece crosses: runs of spaces with what follows them, cut also around characters that occur in
no longer piece. Words are counted over all texts. Of the frequent ones, TABLE_WORDS at most, a lattice is built: their
substrings of bounded length are exploded and joined to the piece table, the edges are grouped by word, and a higher-order
``aggregate`` folds them. The borders between a word's symbols are the bits of a number; a step of the fold takes the edge
with the best score (leftmost in a tie) that spans exactly two symbols and clears the border between them. The table of
encoded words is broadcast, and texts look their words up. Rarer words, and those of over LATTICE_CHARS characters, are folded in
the same order by NumPy, for all such words of a chunk at a time. Encodings equal those of the model's own library.

The method dealt for this operator folds Viterbi over the lattice. That finds the best path of a unigram model; the public
model is a BPE model, whose encoding is the order of its merges and no best path, so the lattice's fold is that of merges.

Nulls and empty texts have no pieces; no rows give no rows. Unknown characters become byte pieces. Long texts are encoded
whole. A text with the meta symbol U+2581 decodes to a space, as the library does. Only models without normalisation are
taken. The piece table is broadcast, at most MAX_PIECES pieces. Other columns come along; an output column replaces one of
its name. Repeated rows and ties of counts change nothing: a word has one encoding, wherever it is folded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from . import tokens
from .batches import struct, with_struct
from .groups import kept
from .winnow import spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_PIECES = 1_000_000
#: Bytes of text whose words are encoded together.
CHUNK_BYTES = 1_500_000
#: Words of the broadcast table at most, and the longest word of the lattice: its borders are bits of a 64-bit number.
TABLE_WORDS, LATTICE_CHARS = 200_000, 61
_SPACE = "▁"
_NONE = np.int64(2**31 - 1)


@dataclass
class Pieces:
    """Ids of characters, of bytes, merges by pair of ids, ranks of scores, and the bytes of each id."""
    size: int
    char_ids: np.ndarray
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    rank: np.ndarray
    spelled: list[bytes]
    alone: np.ndarray
    prefix: bool
    normal: dict[str, int]


def load(path: str = MODEL) -> Pieces:
    """The tables of a BPE model file with byte fallback and without normalisation."""
    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
        raise ValueError("only BPE models with byte fallback are taken")
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models without normalisation are taken")
    if len(model.pieces) > MAX_PIECES:
        raise ValueError(f"the model has more than {MAX_PIECES} pieces")
    kinds = proto.ModelProto.SentencePiece
    normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)}
    byte_ids = np.zeros(256, np.int64)
    spelled = []
    for i, p in enumerate(model.pieces):
        if p.type == kinds.BYTE:
            byte_ids[int(p.piece[1:-1], 16)] = i
            spelled.append(bytes([int(p.piece[1:-1], 16)]))
        else:
            spelled.append(p.piece.replace(_SPACE, " ").encode() if p.piece in normal else b"")
    size = len(model.pieces)
    # characters that only occur in longer pieces get ids past the table; all others are unknown, size
    char_ids = np.full(0x110000, size, np.int64)
    extra = size + 1
    for c in sorted({c for p in normal for c in p}):
        char_ids[ord(c)] = normal.get(c, extra)
        extra += c not in normal
    known = {**normal, **{c: int(char_ids[ord(c)]) for p in normal for c in p}}
    if any(_SPACE in p.lstrip(_SPACE) for p in normal):
        raise ValueError("a piece has a space after another character")
    pairs = {}
    for p, i in normal.items():
        for k in range(1, len(p)):
            if p[:k] in known and p[k:] in known:
                pairs[known[p[:k]] * extra + known[p[k:]]] = i
    keys = np.array(sorted(pairs), np.int64)
    scores = np.array([p.score for p in model.pieces])
    joined = {c for p in normal if len(p) > 1 for c in p}
    alone = np.array([chr(b) not in joined for b in range(128)] + [False] * 128)
    alone[0x20] = False
    return Pieces(extra, char_ids, byte_ids, keys, np.array([pairs[k] for k in keys.tolist()], np.int64),
                  np.unique(-scores, return_inverse=True)[1].astype(np.int64), spelled, alone, model.normalizer_spec.add_dummy_prefix, normal)


def _lookup(pieces: Pieces, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The piece of each pair, or -1."""
    keys = left * pieces.size + right
    at = np.minimum(np.searchsorted(pieces.pair_keys, keys), len(pieces.pair_keys) - 1)
    return np.where(pieces.pair_keys[at] == keys, pieces.pair_ids[at], -1)


def merged(pieces: Pieces, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words after all merges, and how many each word has; every word has a symbol."""
    out_symbols, out_words, word = [], [], np.repeat(np.arange(len(counts)), counts)
    joins = np.full(len(symbols), -1, np.int64)
    inner = np.flatnonzero(word[1:] == word[:-1])
    joins[inner] = _lookup(pieces, symbols[inner], symbols[inner + 1])
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        order = np.where(joins >= 0, pieces.rank[joins], _NONE) << np.int64(32) | np.arange(len(symbols))
        best = np.minimum.reduceat(order, first)
        going = (best >> np.int64(32)) != _NONE
        lengths = np.diff(np.append(first, len(symbols)))
        at = best[going] & np.int64(0xFFFFFFFF)
        symbols[at] = joins[at]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        active = np.repeat(going, lengths)
        out_symbols.append(symbols[~active])
        out_words.append(word[~active])
        place = np.cumsum(stays & active) - 1
        at = place[at]
        keep = stays & active
        symbols, word, joins = symbols[keep], word[keep], joins[keep]
        if not len(symbols):
            break
        for left in (at - 1, at):  # only pairs beside a merge are looked up again
            left = left[left >= 0]
            paired = (left + 1 < len(symbols)) & (word[np.minimum(left + 1, len(symbols) - 1)] == word[left])
            joins[left[~paired]] = -1
            left = left[paired]
            joins[left] = _lookup(pieces, symbols[left], symbols[left + 1])
    symbols, word = np.concatenate(out_symbols), np.concatenate(out_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.bincount(word, minlength=len(counts))


def _words(pieces: Pieces, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, the starts of their words and of the texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    cut = np.zeros(len(data) + 1, bool)
    space, alone = data == 0x20, pieces.alone[data]
    cut[1:-1] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    cut[offsets] = True
    return data, np.flatnonzero(cut), offsets


def _chunk_words(pieces: Pieces, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """For each chunk: rows, number of the first word of each row (and of all words), dictionary index of each word, distinct words."""
    for chunk in tokens.chunks(column, CHUNK_BYTES):
        raw = chunk.data.tobytes()
        bounds = chunk.offsets.tolist()
        texts = [raw[a:b].replace(_SPACE.encode(), b" ") for a, b in zip(bounds[:-1], bounds[1:])]
        texts = [b" " + t if t and pieces.prefix else t for t in texts]
        data, cuts, offsets = _words(pieces, texts)
        starts, ends = (cuts[:-1], cuts[1:]) if len(data) else (cuts[:0], cuts[:0])
        codes, distinct = tokens.span_codes(data, starts, ends)
        yield chunk.rows, np.searchsorted(starts, offsets), codes, distinct


@dataclass
class WordTable:
    """Encoded words by their sorted hashes: the words, and their ids in one array."""
    hashes: np.ndarray
    words: pa.Array
    offsets: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> WordTable:
        table = table.combine_chunks()
        words = table["word"].combine_chunks().cast(pa.large_binary()) if table.num_rows else pa.array([], pa.large_binary())
        ids = table["ids"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
        hashes = tokens.value_hashes(words)
        order = pa.array(np.argsort(hashes))
        words, ids = words.take(order), ids.take(order)
        lengths = ids.value_lengths().to_numpy(zero_copy_only=False)
        return cls(hashes[order.to_numpy()], words, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), ids.flatten().to_numpy())

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, or -1; words are compared in full."""
        if not len(self.hashes) or not len(words):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, tokens.value_hashes(words)), len(self.hashes) - 1)
        same = pc.equal(self.words.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)


EMPTY = WordTable(np.zeros(0, np.uint64), pa.array([], pa.large_binary()), np.zeros(1, np.int64), np.zeros(0, np.int32))


def _folded(pieces: Pieces, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words by merges in NumPy, and how many each has."""
    spelled = [x.decode() for x in words.to_numpy(zero_copy_only=False)]
    points = np.frombuffer("".join(spelled).replace(" ", _SPACE).encode("utf-32-le"), np.uint32)
    symbols, sizes = merged(pieces, pieces.char_ids[points], np.array([len(s) for s in spelled]))
    unknown = np.flatnonzero(symbols >= len(pieces.spelled))
    return _with_bytes(pieces, symbols, sizes, spelled, unknown) if len(unknown) else (symbols, sizes)


def encode_texts(pieces: Pieces, column: pa.Array, table: WordTable = EMPTY) -> pa.ListArray:
    """Piece ids of each text."""
    parts = []
    for rows, first, word, distinct in _chunk_words(pieces, column):
        if not len(word):
            parts.append(pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], pa.int32())))
            continue
        at = table.find(distinct)
        rare = np.flatnonzero(at < 0)
        low, sizes, ids = table.offsets[:-1][at] if len(table.hashes) else at.copy(), np.zeros(len(at), np.int64), table.ids
        sizes[at >= 0] = np.diff(table.offsets)[at[at >= 0]]
        if len(rare):
            symbols, sizes[rare] = _folded(pieces, distinct.take(pa.array(rare)))
            low[rare] = len(ids) + np.cumsum(sizes[rare]) - sizes[rare]
            ids = np.concatenate([ids, symbols.astype(np.int32)])
        group, number = spread(sizes[word])
        totals = np.concatenate([[0], np.cumsum(sizes[word])])
        parts.append(pa.ListArray.from_arrays(pa.array(totals[first].astype(np.int32)), pa.array(ids[low[word][group] + number])))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def word_counts(docs: DataFrame, text: str, pieces: Pieces) -> DataFrame:
    """(word, n): the words of all texts and how often each occurs, counted in each chunk before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, codes, distinct in _chunk_words(shared.value, batch.column(0)):
                if len(codes):
                    yield pa.RecordBatch.from_arrays([distinct.cast(pa.large_string()).cast(pa.string()), pa.array(np.bincount(codes))], names=["word", "n"])

    counted = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, limit: int = TABLE_WORDS) -> DataFrame:
    """The words of the largest counts, ``limit`` at most: all words from a count on, in steps of an eighth of a power of two."""
    counts = counts.withColumn("level", F.floor(F.log2("n") * 8).cast("int")).where(F.length("word") <= LATTICE_CHARS)
    room, least = limit, None
    for row in sorted(counts.groupBy("level").count().collect(), reverse=True):  # some 500 levels at most
        room -= row["count"]
        if room < 0:
            break
        least = row["level"]
    return counts.where(F.lit(False) if least is None else F.col("level") >= least).select("word")


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, start, end, id, rank) for each substring of a word that is a piece, and for each character (id may be null)."""
    spark = words.sparkSession
    spelled = [(p, i, int(pieces.rank[i])) for p, i in pieces.normal.items()]
    table = spark.createDataFrame(spelled, "piece string, id int, rank bigint")  # MAX_PIECES rows at most
    longest = max(len(p) for p in pieces.normal)
    text = F.replace("word", F.lit(" "), F.lit(_SPACE))
    starts = words.select("word", text.alias("text"), F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start")))
    parts = starts.select("*", F.explode(lengths).alias("size")).select(
        "word", "start", (F.col("start") + F.col("size")).alias("end"), F.substring("text", F.col("start") + 1, F.col("size")).alias("piece"))
    joined = parts.join(F.broadcast(table), "piece", "left").where("id IS NOT NULL OR end = start + 1")
    return joined.select("word", "start", "end", "id", "rank")


def encoded_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of words of at most LATTICE_CHARS characters: the edges of each word's lattice, folded."""
    one = F.lit(1).cast("bigint")

    def bit(at: Column) -> Column:
        return F.call_function("shiftleft", one, at)

    edge = F.struct("rank", "start", "end", "id", bit(F.col("start")).bitwiseOR(bit(F.col("end"))).alias("ends"),
                    (bit(F.col("end")) - bit(F.col("start") + 1)).alias("inner"))
    grouped = lattice(words, pieces).groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))  # of one word
    longer = F.filter("edges", lambda e: (e["end"] - e["start"] > 1))
    folded = grouped.select("word", "edges", longer.alias("longer"), F.length("word").alias("size"))

    def joins(state: Column, e: Column) -> Column:
        between = state.bitwiseAND(e["inner"])
        return (state.bitwiseAND(e["ends"]) == e["ends"]) & (between != 0) & (between.bitwiseAND(between - 1) == 0)

    def step(state: Column, _: Column) -> Column:
        best = F.get(F.filter("longer", lambda e: joins(state, e)), F.lit(0))
        return F.coalesce(state - state.bitwiseAND(best["inner"]), state)  # the border between the two symbols goes

    full = bit(F.col("size") + 1) - 1
    borders = F.when(F.size("longer") == 0, full).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("size") - 1, F.lit(1))), full, step))
    folded = folded.select("word", "edges", borders.alias("borders"))
    left = F.filter("edges", lambda e: (F.col("borders").bitwiseAND(e["ends"]) == e["ends"]) & (F.col("borders").bitwiseAND(e["inner"]) == 0))
    in_order = F.array_sort(F.transform(left, lambda e: F.struct(e["start"].alias("start"), e["id"].alias("id"))))
    byte_ids = F.array(*[F.lit(int(i)) for i in pieces.byte_ids])

    def of_bytes(e: Column) -> Column:
        digits = F.hex(F.encode(F.substring("word", e["start"] + 1, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)),
                           lambda k: F.get(byte_ids, F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("int")))

    ids = F.flatten(F.transform(in_order, lambda e: F.when(e["id"].isNull(), of_bytes(e)).otherwise(F.array(e["id"]))))
    return folded.select("word", ids.alias("ids"))


def _with_bytes(pieces: Pieces, symbols: np.ndarray, sizes: np.ndarray, spelled: list[str],
                unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols without a piece, single characters, as the pieces of their bytes."""
    low = np.cumsum(sizes) - sizes
    widths = np.ones(len(symbols), np.int64)
    found = {}
    for w in np.unique(np.searchsorted(low, unknown, "right") - 1).tolist():
        at = 0
        text = spelled[w]
        for k in range(int(low[w]), int(low[w] + sizes[w])):
            if symbols[k] >= len(pieces.spelled):
                found[k] = text[at].encode()
                at += 1
            else:
                at += len(pieces.spelled[symbols[k]].decode()) if symbols[k] not in pieces.byte_ids else 1
    for k, raw in found.items():
        widths[k] = len(raw)
    out = np.repeat(symbols, widths)
    begin = np.cumsum(widths) - widths
    for k, raw in found.items():
        out[begin[k]:begin[k] + len(raw)] = pieces.byte_ids[list(raw)]
    return out, np.add.reduceat(widths, low)


def decode_ids(pieces: Pieces, ids: list[int]) -> str:
    text = b"".join(map(pieces.spelled.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if pieces.prefix and text.startswith(" ") else text


def _appended(rows: DataFrame, source: str, output: str, kind: T.DataType, pieces: Pieces, fn) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(pieces)
    return with_struct(rows, source, output, kind, lambda column: fn(shared.value, column), 1_000)


def word_table(docs: DataFrame, text: str, pieces: Pieces, limit: int) -> Broadcast:
    """The encoded frequent words of all texts, ``limit`` at most, broadcast."""
    words = frequent(kept(word_counts(docs, text, pieces), "words"), limit)
    return docs.sparkSession.sparkContext.broadcast(WordTable.of(encoded_words(words, pieces).toArrow()))


def encode(docs: DataFrame, text: str = "text", output: str = "piece_ids", model: str = MODEL, table_words: int = TABLE_WORDS) -> DataFrame:
    """``docs`` with the piece ids of each text; a column of that name is replaced. Texts are read twice."""
    pieces = load(model)
    table = word_table(docs, text, pieces, table_words)
    return _appended(docs, text, output, T.ArrayType(T.IntegerType()), pieces, lambda p, column: encode_texts(p, column, table.value))


def round_trip(docs: DataFrame, text: str = "text", output: str = "coded", model: str = MODEL, table_words: int = TABLE_WORDS) -> DataFrame:
    """``docs`` with a struct of the piece ids of each text and the text they decode to, from one pass of one Python worker."""
    pieces = load(model)
    kind = T.StructType([T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def both(p: Pieces, column: pa.Array) -> pa.StructArray:
        parts = []
        for start in range(0, len(column), 100):
            ids = encode_texts(p, column.slice(start, 100), table.value)
            parts.append(struct(kind, [ids, pa.array([decode_ids(p, x) for x in ids.to_pylist()], pa.string())]))
        return pa.concat_arrays(parts) if parts else struct(kind, [pa.array([], pa.list_(pa.int32())), pa.array([], pa.string())])

    table = word_table(docs, text, pieces, table_words)
    return _appended(docs, text, output, kind, pieces, both)


def decode(rows: DataFrame, ids: str = "piece_ids", output: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of each list of piece ids; null is empty."""
    return _appended(rows, ids, output, T.StringType(), load(model), lambda pieces, column: pa.array(
        [decode_ids(pieces, x or []) for x in column.to_pylist()], pa.string()))
