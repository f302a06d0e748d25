"""Catalogues over the synthetic tables: whole tables, each row on one of two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE_SQL = """cat AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'A_' ELSE 'B_' END || doc_id AS unique_id, CASE WHEN doc_id % 7 = 0 THEN 'A' ELSE 'B' END AS side, doc_id,
 text AS title, lang AS category, translate(source, '0123456789', 'abcdefghij') AS brand, 'sku' || (doc_id % 97) || 'x' AS modelno,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS price FROM documents)"""
PRODUCTS_SQL = """prod AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'A_' ELSE 'B_' END || p_partkey AS unique_id, CASE WHEN p_partkey % 5 = 0 THEN 'A' ELSE 'B' END AS side,
 p_name AS title, p_type AS category, p_brand AS brand, CAST(NULL AS VARCHAR) AS modelno, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price, p_size FROM part)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("doc_id") % 7 == 0, "A").otherwise("B")
    return table(spark, sf_dir, "documents").select(
        F.concat(side, F.lit("_"), F.col("doc_id")).alias("unique_id"), side.alias("side"), "doc_id",
        F.col("text").alias("title"), F.col("lang").alias("category"), F.translate("source", "0123456789", "abcdefghij").alias("brand"),
        F.concat(F.lit("sku"), F.col("doc_id") % 97, F.lit("x")).alias("modelno"),
        F.when(F.col("doc_id") % 5 != 0, F.col("n_chars").cast("string")).alias("price"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("p_partkey") % 5 == 0, "A").otherwise("B")
    return table(spark, sf_dir, "part").select(
        F.concat(side, F.lit("_"), F.col("p_partkey")).alias("unique_id"), side.alias("side"),
        F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.lit(None).cast("string").alias("modelno"), F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"), "p_size",
    )


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides, without the column side."""
    return df.filter("side = 'A'").drop("side"), df.filter("side = 'B'").drop("side")
