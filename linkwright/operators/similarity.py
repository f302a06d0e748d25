"""Pairs of similar sets, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions import sets as S
from linkwright.sources.tables import ID, LEFT, RIGHT


def ordered_prefixes(df: DataFrame, frequency: DataFrame, threshold: float, on: list[str]) -> DataFrame:
    """(unique_id, on, item, place, size): the rarest items of each set, as many as a similar set must share one of.

    Two sets with a Jaccard of t share at least t of each one's items, so that the rarest size - ceil(t * size) + 1 hold one
    of those. frequency (item, df) gives the order; ties go by item.
    """
    items = df.select(ID, *on, F.size("tokens").alias("size"), F.explode("tokens").alias("item")).join(frequency, "item")
    place = F.row_number().over(Window.partitionBy(ID).orderBy("df", "item"))
    # A hair is taken off the product, so that rounding never shortens a prefix.
    length = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    return items.withColumn("place", place).filter(F.col("place") <= length).select(ID, *on, "item", "place", "size")


def similar_sets(a: DataFrame, b: DataFrame, threshold: float, on: list[str] | None = None) -> DataFrame:
    """(left, right, similarity) of the pairs whose sets have a Jaccard of threshold or more, equal in ``on`` where it is given.

    a and b hold (unique_id, tokens without repeats, on). Pairs meet at items of both prefixes. Pairs whose sizes, or whose
    places of that item, leave too little to share are dropped; the others are compared whole. Empty sets have no pairs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    on = on or []
    frequency = a.select(F.explode("tokens").alias("item")).unionByName(b.select(F.explode("tokens").alias("item"))).groupBy("item").agg(F.count("*").alias("df"))
    left = ordered_prefixes(a, frequency, threshold, on).select(F.col(ID).alias(LEFT), *on, "item", F.col("place").alias("pl"), F.col("size").alias("nl"))
    right = ordered_prefixes(b, frequency, threshold, on).select(F.col(ID).alias(RIGHT), *on, "item", F.col("place").alias("pr"), F.col("size").alias("nr"))
    met = left.join(right, [*on, "item"])
    sizes = (F.col("nl") >= threshold * F.col("nr") - 1e-9) & (F.col("nr") >= threshold * F.col("nl") - 1e-9)
    # The first common item of a pair: behind it, no more than the shorter rest can be shared.
    first = met.filter(sizes).groupBy(LEFT, RIGHT, "nl", "nr").agg(F.min(F.struct("pl", "pr")).alias("at"))
    most = F.least(F.col("nl") - F.col("at.pl"), F.col("nr") - F.col("at.pr")) + 1
    least = threshold / (1 + threshold) * (F.col("nl") + F.col("nr")) - 1e-9
    pairs = first.filter(most >= least).select(LEFT, RIGHT)
    whole = pairs.join(a.select(F.col(ID).alias(LEFT), F.col("tokens").alias("tl")), LEFT).join(b.select(F.col(ID).alias(RIGHT), F.col("tokens").alias("tr")), RIGHT)
    return whole.select(LEFT, RIGHT, S.jaccard_of_sets(F.col("tl"), F.col("tr")).alias("similarity")).filter(F.col("similarity") >= threshold)
