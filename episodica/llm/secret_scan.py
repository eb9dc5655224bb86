"""Secret scans: pattern rules and a battery of randomness tests.

Pattern rules find assignments, access keys and hex runs. The battery takes every run of 20 or more characters of
``[A-Za-z0-9+/_-]`` with its padding, infers its encoding (hex, plain or dashed like a UUID; base32 and base36 of either case,
which need a digit; else base64) and tests that it is uniform over that alphabet: a chi-squared test on the alphabet's parts, a runs test on halves of the alphabet and a test of serial correlation. The smallest of the three
p-values, times three, tells how badly a run fits random characters. Runs that are not random are sorted out with the
Benjamini-Hochberg rule, over all runs of the corpus of a similar length, so short runs, on which the tests see little,
do not borrow from long ones; p-values are counted on a fixed grid, so only a bounded table reaches the driver. A run
that is left is reported unless a pattern's span covers it. The control bounds the share of random runs that are lost; it says
nothing on how many of the reported runs are no secrets.

Offsets are code points, ends exclusive. Nulls and empty texts have no spans, long texts are scanned whole, and equal rows
give equal results. No rows give no rows. Other columns come along; a column of the output's name is replaced. Ties of p-values
share a cell of the grid and are kept or sorted out together.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .batches import struct, with_struct

KINDS = ("assign", "access", "hex", "random")
#: The share of random runs that may be lost to the non-random ones.
FALSE_DISCOVERIES = 0.01
MIN_RANDOM, MIN_HEX, MIN_ACCESS, MIN_VALUE = 20, 16, 18, 12
#: Lower ends of the length strata, and the steps of the p-value grid for each power of ten, down to 10**-GRID_DECADES.
STRATA, GRID, GRID_DECADES = (20, 24, 32, 40, 48, 64, 96, 128), 10, 30
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS, _HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{%d,}" % MIN_HEX)
_RANDOM = re.compile("[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RANDOM)
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_BYTES, _RUN_BYTES = np.zeros(256, bool), np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True
_RUN_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
#: Alphabets from the narrowest on, and whether a run needs a digit to be taken for one: words of letters alone are none.
_ALPHABETS = (("0123456789abcdef", False), ("0123456789ABCDEF", False), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", True),
              ("abcdefghijklmnopqrstuvwxyz234567", True), ("0123456789abcdefghijklmnopqrstuvwxyz", True),
              ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", True))
_DASHED = re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_BASE64 = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")} | {"-": 62, "_": 63}
_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]] + [
    T.StructField("base", T.ArrayType(_SPAN)), T.StructField("spans", T.ArrayType(_SPAN))])
RUNS = T.StructType([T.StructField("cells", T.ArrayType(T.LongType()))])
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _chi_squared_tail(x: float, df: int) -> float:
    """Wilson-Hilferty."""
    spread = 2 / (9 * df)
    return 0.5 * math.erfc(((x / df) ** (1 / 3) - (1 - spread)) / math.sqrt(2 * spread))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(run: str) -> float:
    """How well the run fits uniform characters of its encoding: the smallest p-value of three tests, times three."""
    body = run.rstrip("=")
    body = body.replace("-", "") if _DASHED.fullmatch(body) else body
    n = len(body)
    chars = set(body)
    for alphabet, needs_digit in _ALPHABETS:
        if chars <= set(alphabet) and not (needs_digit and chars.isdisjoint("0123456789")):
            values = np.array([alphabet.index(c) for c in body])
            size, edges = len(alphabet), np.arange(0, len(alphabet) + 1, len(alphabet) // (8 if n >= 40 else 4))
            break
    else:
        values, size, edges = np.array([_BASE64[c] for c in body]), 64, np.array([0, 26, 52, 64])
    seen = np.bincount(np.searchsorted(edges, values, "right") - 1, minlength=len(edges) - 1)
    expected = n * np.diff(edges) / size
    uniform = _chi_squared_tail(float(((seen - expected) ** 2 / expected).sum()), len(expected) - 1)
    high = values >= size // 2
    ones = int(high.sum())
    zeros = n - ones
    if not ones or not zeros:
        return 0.0
    runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * ones * zeros / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    alternation = _two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    centred = values - values.mean()
    power = float((centred ** 2).sum())
    serial = _two_sided((float((centred[1:] * centred[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    return min(1.0, 3 * min(uniform, alternation, serial))


def _cell(p: float) -> int:
    """The grid cell of a p-value: 0 for the largest."""
    return GRID * GRID_DECADES if p <= 0 else min(GRID * GRID_DECADES, int(-math.log10(p) * GRID))


def _stratum(length: int) -> int:
    return max(k for k, low in enumerate(STRATA) if length >= low)


def _long_runs(chunk: tokens.Chunk, flags: np.ndarray, least: int) -> np.ndarray:
    """Rows with a run of at least ``least`` flagged bytes."""
    w = tokens.words(chunk, chunk.data, flags)
    return np.unique(w.row[w.ends - w.starts >= least])


def _rows(chunk: tokens.Chunk, patterns: bool) -> set[int]:
    """Rows that may hold a span."""
    rows = set(_long_runs(chunk, _RUN_BYTES, MIN_RANDOM).tolist())
    if patterns:
        rows |= set(_long_runs(chunk, _HEX_BYTES, MIN_HEX).tolist())
        raw = chunk.data.tobytes()
        lowered = raw.lower()
        for text, keys in ((raw, (b"AKIA",)), (lowered, _KEYS)):
            for key in keys:
                at = text.find(key)
                while at >= 0:
                    row = int(np.searchsorted(chunk.offsets, at, "right")) - 1
                    rows.add(row)
                    at = text.find(key, int(chunk.offsets[row + 1]))
    return rows


def _text(chunk: tokens.Chunk, row: int) -> str:
    return chunk.data[chunk.offsets[row]:chunk.offsets[row + 1]].tobytes().decode()


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the pattern rules, in that order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _scan_runs(column: pa.Array) -> pa.StructArray:
    cells: list[list[int]] = []
    for chunk in tokens.chunks(column):
        rows = _rows(chunk, False)
        for row in range(chunk.rows):
            runs = _RANDOM.findall(_text(chunk, row)) if row in rows else ()
            cells.append([_stratum(len(r)) * 1000 + _cell(randomness(r)) for r in runs])
    return struct(RUNS, [pa.array(cells, pa.list_(pa.int64()))])


def _scan(column: pa.Array, limits: dict[int, int]) -> pa.StructArray:
    counts: list[list[int]] = [[], [], []]
    base, spans = [], []
    for chunk in tokens.chunks(column):
        rows = _rows(chunk, True)
        for row in range(chunk.rows):
            text = _text(chunk, row) if row in rows else ""
            found = pattern_spans(text)
            more = [(m.start(), 3, m.end()) for m in _RANDOM.finditer(text)
                    if _cell(randomness(m[0])) < limits[_stratum(m.end() - m.start())]
                    and not any(a <= m.start() and m.end() <= b for a, _, b in found)]
            for k in range(3):
                counts[k].append(sum(kind == k for _, kind, _ in found))
            for out, part in ((base, found), (spans, sorted(found + more))):
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in part])
    return struct(FIELDS, [pa.array(c, pa.int64()) for c in counts] + [pa.array(base, _SPANS), pa.array(spans, _SPANS)])


def random_limits(docs: DataFrame, text: str = "text", false_discoveries: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """For each length stratum the grid cell from which on runs are not random; bounded by the grid, not by the data."""
    runs = with_struct(docs.select(text), text, "runs", RUNS, _scan_runs)
    counts = runs.select(F.explode("runs.cells").alias("cell")).groupBy("cell").count().collect()
    limits = {}
    for stratum in range(len(STRATA)):
        cells = {r.cell % 1000: r["count"] for r in counts if r.cell // 1000 == stratum}
        total, below, limit = sum(cells.values()), 0, GRID * GRID_DECADES + 1
        for cell in sorted(cells, reverse=True):  # from the smallest p-value
            below += cells[cell]
            if total * 10 ** (-cell / GRID) <= false_discoveries * below:
                limit = cell
        limits[stratum] = limit
    return limits


def scan_secrets(docs: DataFrame, text: str = "text", output: str = "secrets",
                 false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """``docs`` with a struct of the pattern rules' counts and spans, and of all spans; reads the texts twice."""
    limits = random_limits(docs, text, false_discoveries)
    return with_struct(docs, text, output, FIELDS, lambda column: _scan(column, limits))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each maximal run of spans replaced; spans are ordered by start."""
    kind = "struct<at: bigint, out: string>"
    step = F.aggregate(
        spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")).cast(kind),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
                acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
            .alias("out")).cast(kind))
    rest = F.concat(step["out"], F.substring(text, step["at"].cast("int") + 1, F.length(text)))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
