"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document gets the key -ln(u) / w for its hash u in (0, 1) and its quality weight w. Within its source, documents
ordered by key are a weighted sample without replacement. A source first gives as many complete epochs as its target
holds; what is left is filled in the order of keys, by prefix sums of sizes. Prefix sums are taken in two levels (range
partitions, then rows in each), so that no source needs to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RID, checkpoint, sheltered, table, with_rid

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST_EPOCHS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 17


def quality() -> Column:
    """From 0.05 to 1: how near the mean length of words is to six characters, as in running text."""
    ratio = F.length("text") / (F.col("__size") * 6.0)
    return F.when(F.col("__size") > 0, F.greatest(F.lit(0.05), F.least(ratio, 1 / ratio))).otherwise(F.lit(0.05))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Target of each source from rows (source, source_size): by weight, and none above ``most`` times its size.

    Resharing the excess by weight until no target is above its cap ends at min(cap, level * weight), where level is
    found by taking sources in the order of cap / weight. One row per source goes through its windows.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("__w", F.element_at(cycle, ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("__cap", F.col("source_size") * most).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    rising = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    t = t.withColumn("__total", F.sum("source_size").over(every) * share)
    level = (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(rest)
    t = t.withColumn("__level", level)
    found = F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).over(every)
    t = t.withColumn("__found", found)
    target = F.coalesce(F.least(F.col("__cap"), F.col("__found") * F.col("__w")), F.col("__cap"))
    return t.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with __size, __source_size, __target and __taken (words that the mix takes, repeats counted).

    A null text has size 0, a null source is a source of its own. The last document that a source's target reaches is
    taken in part. Ties of keys (repeated rows) fall by doc_id; equal rows may trade places. An empty table stays empty.
    """
    sized = docs.withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id"), F.col("text")).cast("binary")), 1, 13)
    chance = (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(2**52))
    keys = checkpoint(sized.select("doc_id", "source", "__size", (-F.log(chance) / quality()).alias("__key")))
    # Range partitions sample their input first: texts are read and hashed once, before.
    spread = keys.repartitionByRange(F.col("source"), F.col("__key")).sortWithinPartitions("source", "__key", "doc_id")
    return _taken(checkpoint(spread.select("*", F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().alias("__nth"))))


def repeated(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs as often as the mix takes them: whole for each epoch, then in part where the target cuts a document.

    All columns stay; n_chars, if present, follows a cut text. Documents without a word are not taken.
    """
    inner, back = sheltered(docs, ("doc_id", "text", "source", "n_chars"))
    keyed = with_rid(inner, "doc_id", "text")
    plan = mix(keyed.withColumn("doc_id", F.col(RID)), seed).select(F.col("doc_id").alias("__id"), F.col("__size").alias("__n"), "taken").filter("taken > 0")
    joined = keyed.join(plan, F.col(RID) == F.col("__id"))
    whole, rest = F.floor(F.col("taken") / F.col("__n")).cast("int"), (F.col("taken") % F.col("__n")).cast("int")
    times = F.concat(F.array_repeat(F.col("__n").cast("int"), whole), F.array_repeat(rest, F.when(rest > 0, 1).otherwise(0)))
    out = joined.withColumn("__words", F.explode(times))
    out = out.withColumn("text", F.when(F.col("__words") < F.col("__n"), _first_words(F.col("text"), F.col("__words"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back(out)


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, with single spaces between words."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(n, F.lit(1))), " ")


def _taken(light: DataFrame) -> DataFrame:
    """From rows in range partitions: exact prefix sums, first over partitions, then over rows of one partition."""
    by_part = light.groupBy("source", "__pid").agg(F.sum("__size").alias("__in_part"))
    sizes = by_part.groupBy("source").agg(F.sum("__in_part").alias("source_size"))
    goal = targets(sizes)
    parts = by_part.withColumn("__ahead", F.coalesce(F.sum("__in_part").over(Window.partitionBy("source").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select(F.col("p.source").alias("__s"), F.col("p.__pid").alias("__p"), "__ahead", "source_size", "target")
    rows = light.withColumn("__before", F.sum("__size").over(Window.partitionBy("__pid", "source").orderBy("__nth").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
    rows = rows.join(parts, (F.col("__pid") == F.col("__p")) & F.col("source").eqNullSafe(F.col("__s")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("__epochs", epochs.cast("long"))
    budget = F.round(F.col("target") - F.col("__epochs") * F.col("source_size")).cast("long")
    left = F.greatest(F.lit(0), F.least(F.col("__size"), budget - F.col("__ahead") - F.col("__before")))
    return rows.withColumn("taken", (F.col("__epochs") * F.col("__size") + left).cast("long"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").cast("string").alias("source"))
    return mix(docs).select("doc_id", F.col("__size").alias("size"), "source_size", "target", "taken")
