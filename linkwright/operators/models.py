"""A store of trained models: parameters, run metadata, and the frequencies and brands under which features were built.

A version is a folder of its own: params (comparison, level, m, u), frequencies (item, df), vocabulary (brand), sessions, and
meta, one row of JSON that is written last. A version without meta was never finished and is not read. Versions are never
changed, so that scores can be repeated later under the frequencies of their time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators import features as D
from linkwright.operators.scoring import COMPARISONS, Model

FORMAT = 1
_PARAMS = "comparison string, level int, m double, u double"


@dataclass
class Stored:
    """A model with what its features need, as read from a store."""

    version: int
    model: Model
    meta: dict
    frequencies: DataFrame
    vocabulary: DataFrame

    def features(self, df: DataFrame) -> DataFrame:
        """Features of records, old or new, under the frozen frequencies; a token that nobody held then counts as held once."""
        tokens = D.postings(D.tokenised(df), "tokens").select("item").distinct()
        new = tokens.join(self.frequencies, "item", "left_anti").select("item", F.lit(1).cast("long").alias("df"))
        return D.add_features(df, self.frequencies.unionByName(new), self.vocabulary)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, oldest first. The folder may be in any store that Spark writes."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("version=")]
    done = lambda p: files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "meta/_SUCCESS"))
    return sorted(int(p.getName().split("=")[1]) for p in found if done(p))


def save(model: Model, path: str, a: DataFrame, b: DataFrame, sessions: list = (), **meta) -> int:
    """Store a model trained on both tables (records, not features) as the next version; returns its number."""
    spark = a.sparkSession
    version = max(versions(spark, path), default=0) + 1
    at = f"{path}/version={version}"
    pooled = D.document_frequency(D.postings(D.tokenised(a).unionByName(D.tokenised(b)), "tokens"))
    pooled.write.mode("overwrite").parquet(f"{at}/frequencies")
    D.brand_vocabulary(a, b).write.mode("overwrite").parquet(f"{at}/vocabulary")
    model.rows(spark).coalesce(1).write.mode("overwrite").parquet(f"{at}/params")
    runs = [(s.block, s.prior, s.rounds, s.pairs, s.credible) for s in sessions]
    spark.createDataFrame(runs, "block string, prior double, rounds int, pairs long, credible boolean").coalesce(1).write.mode("overwrite").json(f"{at}/sessions")
    own = {"format": FORMAT, "prior": model.prior, "max_rounds": model.max_rounds, "tolerance": model.tolerance, "comparisons": list(COMPARISONS), "spark": spark.version}
    spark.createDataFrame([(json.dumps(own | meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/meta")
    return version


def load(spark: SparkSession, path: str, version: int | None = None, strip_m: bool = False) -> Stored:
    """A version (the newest if none is named). With strip_m the model comes without any m: labels alone then decide."""
    there = versions(spark, path)
    if not there or (version is not None and version not in there):
        raise FileNotFoundError(f"no finished version {version or ''} in {path}; there are {there}")
    version = version if version is not None else there[-1]
    at = f"{path}/version={version}"
    meta = json.loads(spark.read.text(f"{at}/meta").first()[0])
    if meta["format"] != FORMAT:
        raise ValueError(f"version {version} has format {meta['format']}, not {FORMAT}")
    if meta["comparisons"] != list(COMPARISONS):
        raise ValueError(f"version {version} compares {meta['comparisons']}")
    model = Model(prior=meta["prior"], max_rounds=meta["max_rounds"], tolerance=meta["tolerance"])
    for r in spark.read.schema(_PARAMS).parquet(f"{at}/params").collect():
        for side, value in (("m", None if strip_m else r["m"]), ("u", r["u"])):
            if value is not None:
                getattr(model, side).setdefault(r["comparison"], {})[r["level"]] = value
    return Stored(version, model, meta, spark.read.schema("item string, df long").parquet(f"{at}/frequencies"), spark.read.schema("brand string").parquet(f"{at}/vocabulary"))
