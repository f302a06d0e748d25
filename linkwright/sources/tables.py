"""Sources and sinks: catalogues, labels, candidates, scores, logs, and profiles of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID, LEFT, RIGHT = "unique_id", "unique_id_l", "unique_id_r"
ATTRIBUTES = ["title", "category", "brand", "modelno", "price"]
CANDIDATES = f"{LEFT} string, {RIGHT} string, rules string"
SCORES = f"{LEFT} string, {RIGHT} string, match_probability double"
_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def attribute_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ID]


def prefixed(df: DataFrame, side: str, key: str = "id") -> DataFrame:
    """The table with ids unique across both sides; null, empty or repeated ids raise."""
    if key not in df.columns:
        raise ValueError(f"no column {key} in {df.columns}")
    out = df.select(F.concat(F.lit(f"{side}_"), F.col(key)).alias(ID), *[c for c in df.columns if c != key])
    odd = out.groupBy(ID).count().filter((F.col("count") > 1) | F.col(ID).isNull()).limit(5).collect()
    if odd:
        raise ValueError(f"null or repeated ids in table {side}: {[r[ID] for r in odd]}")
    return out


def read_catalogue(spark: SparkSession, path: str, side: str) -> DataFrame:
    """A CSV file with all columns as strings; an empty cell is null, 'NA' and 'null' are text."""
    raw = spark.read.options(**_CSV).csv(path)
    return prefixed(raw.select([F.nullif(F.col(c), F.lit("")).alias(c) for c in raw.columns]), side)


def save_catalogue(df: DataFrame, path: str) -> None:
    """A table that read_catalogue gives back, with its ids as a column id without their side; texts keep their white space."""
    plain = df.select(F.substring_index(ID, "_", -1).alias("id"), *[F.col(c).cast("string") for c in df.columns if c != ID])
    plain.write.mode("overwrite").options(**_CSV, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_pair(spark: SparkSession, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    a, b = read_catalogue(spark, left, "A"), read_catalogue(spark, right, "B")
    if a.columns != b.columns:
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")
    return a, b


def dataset_folder(known: dict[str, str], name: str) -> str:
    if name not in known:
        raise KeyError(f"no dataset {name}; there are {', '.join(sorted(known))}")
    return known[name]


def read_labels(spark: SparkSession, folder: str, split: str, unlocked: bool = False) -> DataFrame:
    """Labelled pairs of a split. They are the answer key: reading them takes unlocked=True."""
    if not unlocked:
        raise PermissionError("labels are locked; pass unlocked=True where the answer key may be read")
    if split not in ("train", "valid", "test"):
        raise ValueError(f"no split {split}")
    raw = spark.read.csv(f"{folder}/{split}.csv", header=True, schema="ltable_id string, rtable_id string, label int")
    return raw.select(F.concat(F.lit("A_"), "ltable_id").alias(LEFT), F.concat(F.lit("B_"), "rtable_id").alias(RIGHT), "label")


def save_pairs(df: DataFrame, path: str) -> None:
    """Candidates, scores or accepted pairs as CSV, sorted by both ids."""
    df.orderBy(LEFT, RIGHT).write.mode("overwrite").csv(path, header=True)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CANDIDATES)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SCORES)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType | str, key: str, order: str) -> DataFrame:
    """The last entry of each key."""
    return last_of_each(spark.read.json(path, schema=schema), key, order)


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    latest = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n")


def save_embeddings(df: DataFrame, path: str) -> None:
    df.select("id", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(id, vec) as save_embeddings wrote them. With ids (id), one row for each of those, vec null where none is stored.

    An id that is stored twice raises when it is read.
    """
    twice = F.raise_error(F.concat(F.lit("stored twice: "), F.col("id").cast("string"))).cast("array<float>")
    found = spark.read.parquet(path).groupBy("id").agg(F.count("*").alias("n"), F.first("vec").alias("vec")).select("id", F.when(F.col("n") > 1, twice).otherwise(F.col("vec")).alias("vec"))
    return found if ids is None else ids.select("id").distinct().join(found, "id", "left")


def profile(df: DataFrame) -> DataFrame:
    """column, n_rows, n_null, pct_null of each column, from one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in df.columns])
    rows = counts.select("__rows", F.explode(entries).alias("e"))
    share = F.when(F.col("__rows") > 0, F.round(100.0 * F.col("e.n_null") / F.col("__rows"), 6)).otherwise(0.0)
    return rows.select(F.col("e.column").alias("column"), F.col("__rows").alias("n_rows"), F.col("e.n_null").alias("n_null"), share.alias("pct_null"))


def label_balance(splits: dict[str, DataFrame], unlocked: bool = False) -> DataFrame:
    """split, n_rows, n_matches, pct_matches."""
    if not unlocked:
        raise PermissionError("labels are locked")
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("split"), "label") for k, d in splits.items()])
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum("label").cast("long").alias("n_matches"), F.round(100 * F.avg("label"), 6).alias("pct_matches"))


def snapshot_differences(kept: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows that only one of two snapshots holds, with the side that has them."""
    gone = kept.exceptAll(rebuilt).withColumn("side", F.lit("kept"))
    return gone.unionByName(rebuilt.exceptAll(kept).withColumn("side", F.lit("rebuilt")))
