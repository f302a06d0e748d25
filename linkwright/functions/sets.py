"""Similarities of arrays, numbers and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities are kept this far from 0 and 1 before they become bits.
EPSILON = 1e-15


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def once(value: Column, use) -> Column:
    """use(value) with the value computed one time, however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """word_jaccard of arrays that hold nothing twice."""
    return once(shared(a, b), lambda n: n.cast("double") / F.nullif(F.size(a) + F.size(b) - n, F.lit(0)))


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared over all members in double precision; null if both are empty or one is null."""
    return jaccard_of_sets(F.array_distinct(a), F.array_distinct(b))


def set_jaccard(a: Column, b: Column) -> Column:
    """As word_jaccard, but 0.0 where nothing can be compared."""
    return F.coalesce(word_jaccard(a, b), F.lit(0.0))


def price_gap(a: Column, b: Column) -> Column:
    """Difference relative to the larger price; null if one is null."""
    return F.abs(a - b) / F.nullif(F.greatest(a, b), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def l2_normalise(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)))


def quantities_conflict(a: Column, b: Column) -> Column:
    """Whether some family is stated on both sides without a common value; silence is no conflict."""
    families = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.exists(families, lambda f: ~F.arrays_overlap(a[f], b[f]))


def match_bits(p: Column) -> Column:
    """log2 of the odds."""
    kept = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), p))
    return F.log2(kept / (1 - kept))


def probability(bits: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(2.0), -bits))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)
