"""Queries through files: what the sinks write, the sources read back. Each call has a new folder in the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkwright.plans import queries as base
from linkwright.plans.registry import query
from linkwright.sources import tables as A
from linkwright.sources.shared import shared_folder
from linkwright.sources.tables import ID, LEFT, RIGHT
from linkwright.sources.views import catalogue, sides, table

SPLITS = ("train", "valid", "test")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


@query()
def stored_catalogue(spark, sf):
    """Both sides of the documents' catalogue as CSV, read as a pair: whole texts, with quotes, line breaks and blanks."""
    folder = _folder(spark)
    for name, side in zip(("a", "b"), sides(catalogue(spark, sf)), strict=True):
        A.save_catalogue(side, f"{folder}/{name}")
    a, b = A.read_pair(spark, f"{folder}/a", f"{folder}/b")
    return a.withColumn("side", F.lit("A")).unionByName(b.withColumn("side", F.lit("B")))


@query()
def stored_candidates(spark, sf):
    """Candidates of all rules as CSV and back."""
    path = _folder(spark)
    A.save_pairs(base._candidates(spark, sf), path)
    return A.read_candidates(spark, path)


@query()
def stored_pair_scores(spark, sf):
    """Scores of product pairs as CSV and back; probabilities keep every digit."""
    path = _folder(spark)
    A.save_pairs(base._scored(spark, sf).select(LEFT, RIGHT, "match_probability"), path)
    return A.read_scores(spark, path)


@query()
def stored_labels(spark, sf):
    """Pairs of products with their label, in three splits by the left record, written and read as answer keys."""
    folder = _folder(spark)
    plain = lambda c, name: F.substring_index(c, "_", -1).alias(name)
    labelled = base._scored(spark, sf).join(base._truth(spark, sf).withColumn("label", F.lit(1)), [LEFT, RIGHT], "left")
    rows = labelled.select(plain(LEFT, "ltable_id"), plain(RIGHT, "rtable_id"), F.coalesce("label", F.lit(0)).alias("label"), (F.crc32(F.col(LEFT).cast("binary")) % len(SPLITS)).alias("split"))
    for k, split in enumerate(SPLITS):
        rows.filter(F.col("split") == k).drop("split").write.csv(f"{folder}/{split}.csv", header=True)
    read = [A.read_labels(spark, folder, split, unlocked=True).withColumn("split", F.lit(split)) for split in SPLITS]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query()
def stored_embeddings(spark, sf):
    """All vectors through the store, asked for by the ids of the table: vec is null for a vector that isn't there."""
    path = _folder(spark)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    A.save_embeddings(vectors.filter("vec is not null").dropDuplicates(["id"]), path)
    return A.read_embeddings(spark, path, vectors)
