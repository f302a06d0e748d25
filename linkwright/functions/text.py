"""Text functions as Column expressions: tokens, segments, n-grams, prices, quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Units of each family of quantities, and their size in the family's base unit.
QUANTITY_PATTERNS = {
    "storage": r"\b(\d+(?:\.\d+)?)\s?(kb|mb|gb|tb)\b",
    "length": r"\b(\d+(?:\.\d+)?)\s?(inch|inches|in|\")(?![a-z])",
    "power": r"\b(\d+(?:\.\d+)?)\s?(w|watt|watts)\b",
}
UNITS = {"kb": 1.0, "mb": 1024.0, "gb": 1048576.0, "tb": 1073741824.0}


def word_tokens(text: Column) -> Column:
    """All runs of [a-z0-9] of the lower-cased text, in order, repeats kept; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(word_tokens(text))


def segments(text: Column) -> Column:
    """Tokens welded across gaps that a digit touches: behind a digit, or between a letter and a digit."""
    gap = r"(?<=[0-9])[^a-z0-9]+(?=[a-z0-9])|(?<=[a-z])[^a-z0-9]+(?=[0-9])"
    return word_tokens(F.regexp_replace(F.lower(text), gap, ""))


def char_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct substrings of n characters inside segments; shorter segments give none."""
    long_enough = F.filter(segments(text), lambda s: F.length(s) >= n)
    return F.array_distinct(F.flatten(F.transform(long_enough, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n))))))


def collapsed(text: Column) -> Column:
    """The text without anything but letters and digits."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def record_text(columns: list[str]) -> Column:
    """Attributes joined by a space, nulls skipped, in lower case."""
    return F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))


def labelled_text(columns: list[str]) -> Column:
    """'column: value' pairs joined by ' | ', nulls skipped."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.col(c)) for c in columns])


def is_identifier_like(token: Column) -> Column:
    """Five characters or more with a letter and a digit."""
    return (F.length(token) >= 5) & token.rlike("[a-z]") & token.rlike("[0-9]")


def is_identifier_shaped(token: Column) -> Column:
    """Five characters or more with a digit: digits alone count here."""
    return (F.length(token) >= 5) & token.rlike("[0-9]")


def parse_price(text: Column) -> Column:
    """A positive finite number, or null."""
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when((value > 0) & (value < float("inf")), value)


def null_if_empty(items: Column) -> Column:
    """The sorted array; null where there is no evidence."""
    return F.when(F.size(items) > 0, F.array_sort(items))


def quantities(text: Column) -> Column:
    """Map from family to the sorted distinct values that the text states, in the family's base unit."""
    lowered = F.coalesce(F.lower(text), F.lit(""))
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    entries = []
    for family, pattern in QUANTITY_PATTERNS.items():
        number, unit = (F.regexp_extract_all(lowered, F.lit(pattern), F.lit(g)) for g in (1, 2))
        values = F.zip_with(number, unit, lambda x, u: x.cast("double") * F.coalesce(units[u], F.lit(1.0)))
        entries.append(F.struct(F.lit(family).alias("key"), F.array_sort(F.array_distinct(values)).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def interval(point: Column, low: Column, high: Column) -> Column:
    """'61.47 [58.95, 64.09]'."""
    return F.format_string("%.2f [%.2f, %.2f]", point, low, high)


def human_size(size: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if size < 1024 or unit == "GB":
            return f"{size:.1f} {unit}"
        size /= 1024
    raise AssertionError
