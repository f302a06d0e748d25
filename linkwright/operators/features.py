"""Corpus statistics and features of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.functions import text as X
from linkwright.sources.shared import kept
from linkwright.sources.tables import ATTRIBUTES, ID

RARE_IDENTIFIER, RARE_TOKEN = 5, 20
FEATURES = ["title_tokens", "rare_identifier_tokens", "common_identifier_tokens", "brand_terms", "rare_tokens"]


def tokenised(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(unique_id, tokens) with the distinct tokens of all attributes."""
    columns = columns or [c for c in ATTRIBUTES if c in df.columns]
    return df.select(ID, X.token_set(X.record_text(columns)).alias("tokens"))


def postings(df: DataFrame, items: str, name: str = "item") -> DataFrame:
    """The inverted index: one row for each record and distinct item."""
    return df.select(ID, F.explode(F.array_distinct(items)).alias(name))


def document_frequency(index: DataFrame, name: str = "item") -> DataFrame:
    """How many records hold an item (index has distinct pairs)."""
    return index.groupBy(name).agg(F.count("*").alias("df"))


def brand_vocabulary(*tables: DataFrame) -> DataFrame:
    """Distinct lower-cased brand values of exactly one token."""
    values = [t.select(F.lower("brand").alias("brand")) for t in tables]
    both = values[0]
    for v in values[1:]:
        both = both.unionByName(v)
    return both.filter(F.size(X.token_set(F.col("brand"))) == 1).distinct()


def brand_harvest(df: DataFrame, tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(unique_id, brand): a record's own one-token brand as it is written, and its tokens that are brands."""
    own = df.select(ID, F.lower("brand").alias("brand")).filter(F.size(X.token_set(F.col("brand"))) == 1)
    named = postings(tokens, "tokens", "brand").join(vocabulary, "brand", "left_semi")
    return own.unionByName(named.select(ID, "brand")).distinct()


def add_features(df: DataFrame, pooled: DataFrame, vocabulary: DataFrame, rare_identifier: int = RARE_IDENTIFIER, rare_token: int = RARE_TOKEN, tokens: DataFrame | None = None) -> DataFrame:
    """Five sorted arrays and the price of each record; an array without members is null.

    pooled holds (item, df) over both tables. A record's tokens (those of tokenised(df), where they are not given) meet their
    frequencies in one join and one aggregation.
    """
    tokens = postings(tokenised(df) if tokens is None else tokens, "tokens").join(pooled, "item").join(vocabulary.select(F.col("brand").alias("item"), F.lit(True).alias("is_brand")), "item", "left")
    shaped, rare = X.is_identifier_shaped(F.col("item")), F.col("df") <= rare_identifier
    pick = lambda when: F.collect_set(F.when(when, F.col("item")))
    grouped = tokens.groupBy(ID).agg(
        pick(shaped & rare).alias("rare_identifier_tokens"), pick(shaped & ~rare).alias("common_identifier_tokens"),
        pick(F.col("is_brand")).alias("brand_terms"), pick(~shaped & (F.col("df") <= rare_token)).alias("rare_tokens"),
    )
    base = df.select(ID, X.token_set(F.col("title")).alias("title_tokens"), X.parse_price(F.col("price")).alias("price_value"))
    base = base.withColumn("title_tokens", X.null_if_empty(F.col("title_tokens")))  # in a step of its own: the words are computed once
    return base.join(grouped, ID, "left").select(ID, "title_tokens", *[X.null_if_empty(F.col(c)).alias(c) for c in FEATURES[1:]], "price_value")


def features_of(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features of both tables under pooled frequencies."""
    ta, tb = (kept(tokenised(d)) for d in (a, b))
    pooled = document_frequency(postings(ta.unionByName(tb), "tokens"))
    vocabulary = brand_vocabulary(a, b)
    return add_features(a, pooled, vocabulary, tokens=ta), add_features(b, pooled, vocabulary, tokens=tb)


def coverage(features: DataFrame) -> DataFrame:
    """Percentage of records with evidence, by feature."""
    shares = features.agg(*[F.round(100 * F.avg(F.col(c).isNotNull().cast("int")), 6).alias(c) for c in [*FEATURES, "price_value"]])
    return shares.unpivot([], [*FEATURES, "price_value"], "feature", "pct")
