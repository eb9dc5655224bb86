"""Reading numbers and actions out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags and patterns of the text interface.
OBS_START, OBS_END = "<observation>", "</observation>"
ACTION_START, ACTION_END = "<action>", "</action>"
DECIMAL_LIST = r"^([-+]?\d*\.\d+(?:,\s*[-+]?\d*\.\d+)*)"
INTEGER_LIST = r"^(\d+(?:,\s*\d+)*)"
LOOSE_DECIMAL_LIST = r"^\s*([-+]?\d*\.?\d+(?:,\s*[-+]?\d*\.?\d+)*)"
LOOSE_INTEGER_LIST = r"^\s*(\d+(?:,\s*\d+)*)"
TAGGED_DECIMAL_LIST = r"<action>([-+]?\d*\.\d+(?:,\s*[-+]?\d*\.\d+)*)</action>"
MAX_TOKEN = 999


def discrete_pattern(n_discrete: int) -> str:
    if not 1 <= n_discrete <= 10:
        raise ValueError("discrete actions are one digit: n_discrete must be 1 to 10")
    return rf"^[0-{n_discrete - 1}]</action>"


def matched_list(text: Column, pattern: str) -> Column:
    """The number list found by ``pattern``; empty string when there is none."""
    return F.regexp_extract(text, pattern, 1)


def item_count(numbers: Column) -> Column:
    return F.length(numbers) - F.length(F.replace(numbers, F.lit(","), F.lit(""))) + 1


def floats_of(text: Column, pattern: str, n: int) -> Column:
    """The n floats of the matched list, NULL when nothing matches or the count is wrong."""
    numbers = matched_list(text, pattern)
    items = F.split(numbers, ",")
    return F.when((numbers != "") & (F.size(items) == n),
                  F.transform(items, lambda x: x.try_cast("double")))


def tokens_of(text: Column, pattern: str, n: int) -> Column:
    """The n integer tokens, NULL when the count is wrong or one lies outside 0..999."""
    items = F.split(matched_list(text, pattern), ",")
    tokens = F.transform(items, lambda x: x.try_cast("bigint"))
    bad = F.exists(tokens, lambda t: t.isNull() | (t > MAX_TOKEN))
    return F.when((F.size(items) == n) & ~bad, tokens)


def parse_tagged_vector(text: Column, start: str, end: str, strict: bool = True) -> Column:
    """Floats between the last opening tag and the closing tag after it.

    A malformed number raises; with ``strict=False`` the whole vector becomes NULL.
    """
    inner = F.substring_index(F.substring_index(text, start, -1), end, 1)
    items = F.split(inner, ",")
    if strict:
        return F.transform(items, lambda x: x.cast("double"))
    values = F.transform(items, lambda x: x.try_cast("double"))
    return F.when(~F.exists(values, lambda v: v.isNull()), values)


def parse_bracket_vector(text: Column, dim: int | None = None, strict: bool = True) -> Column:
    """``[a, b, ...]`` as floats, blank items skipped; the count must be ``dim`` when given."""
    items = F.filter(F.split(F.translate(text, "[]", ""), ","), lambda x: F.trim(x) != "")
    values = F.transform(items, lambda x: x.cast("double") if strict else x.try_cast("double"))
    if dim is None:
        return values
    if not strict:
        return F.when(F.size(values) == dim, values)
    complaint = F.format_string("Expected %d observations, got %d", F.lit(dim), F.size(values))
    return F.when(F.size(values) == dim, values).otherwise(
        F.raise_error(complaint).cast("array<double>"))


def extract_action_continuous(response: Column, n: int) -> Column:
    """Leading number list (blanks and integers allowed) of exactly n items, else NULL."""
    return floats_of(response, LOOSE_DECIMAL_LIST, n)


def extract_action_tokenized(response: Column, n: int, lo: float = -1.0, hi: float = 1.0) -> Column:
    """Leading integer tokens decoded to (lo, hi), else NULL."""
    tokens = tokens_of(response, LOOSE_INTEGER_LIST, n)
    return F.transform(tokens, lambda t: lo + (t / float(MAX_TOKEN)) * (hi - lo))


def extract_action_discrete(response: Column, n_discrete: int) -> Column:
    """The digit before ``</action>`` at the very start, else NULL."""
    return F.when(response.rlike(discrete_pattern(n_discrete)), F.substring(response, 1, 1).cast("int"))


def lenient_items(response: Column, prefix: str = "") -> Column:
    """The first six items after the last ``<action>``, stripped to digits, minus and point."""
    inner = F.substring_index(F.substring_index(response, ACTION_START, -1), ACTION_END, 1)
    forced = F.concat(F.lit(f"{ACTION_START} {prefix}"), inner) if prefix else inner
    items = F.split(forced, ",")
    items = F.when(items[0] == "", F.slice(items, F.lit(2), F.size(items))).otherwise(items)
    return F.transform(F.slice(items, 1, 6), lambda x: F.regexp_replace(x, r"[^0-9\-.]", ""))


def extract_action_lenient(response: Column, prefix: str = "") -> Column:
    """STRUCT<action, error>: six floats, or NULL and the reason."""
    items = lenient_items(response, prefix)
    values = F.transform(items, lambda x: x.try_cast("double"))
    bad = F.exists(values, lambda v: v.isNull())
    error = (F.when(F.size(items) != 6, F.concat(F.lit("expected 6 values, got "), F.size(items).cast("string")))
             .when(bad, F.lit("not a number")))
    return F.struct(F.when(error.isNull(), values).alias("action"), error.alias("error"))


def completion_text(text: Column | None = None, messages: Column | None = None,
                    add_action_tag: bool = False) -> Column:
    """The response from a text column or from the first chat message."""
    options = ([text] if text is not None else []) + ([messages[0]["content"]] if messages is not None else [])
    response = F.coalesce(*options)
    return F.concat(F.lit(ACTION_START), response) if add_action_tag else response
