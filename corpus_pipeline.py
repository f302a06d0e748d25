"""A corpus pipeline of five stages, each of which reads what the one before it wrote.

Language identification drops documents whose language can't be told; the Jaccard join keeps one document of each group of
near copies; suffix-array dedup cuts byte strings that repeat earlier text; mixing brings sources to target weights;
byte-level BPE encodes what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm import bpe, common, jaccard, language_id, mixing, suffix_dedup

#: A document is rejected if no language can be told, if its n-grams are less usual in its best language by this in mean
#: log probability (random letters are below -3, names and license lines above -2), or if less of it than this is in one language.
LEAST_SCORE, LEAST_FIT, LEAST_SHARE = 0.5, -2.5, 0.65


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one known language; a null lang becomes the language found.

    Null and empty texts, texts without a letter, junk and texts in several languages go. Repeated rows and repeated or
    null ids each stay or go by their text. Other columns stay as they are, whatever their names.
    """
    inner, back = common.sheltered(docs, ("doc_id", "text", "lang"))
    found = language_id.identify(inner, language_id.fit(inner), "__found")
    told = (F.col("__found.lang_pred") != language_id.UNDETERMINED) & (F.col("__found.score") >= LEAST_SCORE)
    kept = found.filter(told & (F.col("__found.fit") >= LEAST_FIT) & (F.col("__found.share") >= LEAST_SHARE))
    return back(kept.withColumn("lang", F.coalesce("lang", F.col("__found.lang_pred"))))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (by doc_id, null first; then by a hash of the text) of every component of near copies.

    Texts without a word link with nothing and stay. Of rows that repeat, one stays. An empty table stays empty.
    """
    return jaccard.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without bytes in strings of 100 that start earlier in the corpus.

    All rows stay, with null texts null and others perhaps empty; earlier is by doc_id (null first), then by a hash of the text.
    """
    return suffix_dedup.remove_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last one that a source's target reaches is cut at a word.

    Null and empty texts have no words and are not taken; a null source is one of its own; repeated rows count each.
    """
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit integers) of each document of the mix.

    Null and empty texts have no ids; repeated and null doc_ids keep a row each.
    """
    ids = bpe.encode(docs)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", identified), ("jaccard_join", distinct), ("suffix_dedup", without_repeats), ("mixing", mixed), ("bpe", encoded)]

#: No stage but mixing can be put into SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What each returns is written to the shared folder and read again; then its input goes."""
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            common.remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs
