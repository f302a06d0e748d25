"""What tables between stages must satisfy. Violations are counted in Spark; the first one raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.sources.tables import ID, LEFT, RIGHT

# Names of fields that hold an answer.
ANSWER_FIELDS = ("truth", "truth_shown", "truthshown", "label", "labels", "correct", "is_match", "answer", "gold", "y")


class ContractError(ValueError):
    """A table breaks the contract between two stages."""


def _columns(df: DataFrame, needed: list[str]) -> None:
    if missing := [c for c in needed if c not in df.columns]:
        raise ContractError(f"missing columns {missing}")


def _counted(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.lit(name).alias("violation"), F.count("*").alias("n"))


def duplicates(df: DataFrame) -> DataFrame:
    return df.groupBy(LEFT, RIGHT).count().filter("count > 1")


def candidate_violations(candidates: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """violation, n: unknown ids of either side and repeated pairs."""
    left = candidates.join(a.select(F.col(ID).alias(LEFT)), LEFT, "left_anti")
    right = candidates.join(b.select(F.col(ID).alias(RIGHT)), RIGHT, "left_anti")
    return _counted(left, "unknown_left").unionByName(_counted(right, "unknown_right")).unionByName(_counted(duplicates(candidates), "duplicate"))


def grouped_violations(a: DataFrame, b: DataFrame, on: list[str], listed: DataFrame) -> DataFrame:
    """candidate_violations() of the pairs that are equal in ``on`` and the ``listed`` ones: the former are counted, never listed.

    Ids whose rows have the same keys, each as often, are one class: all pairs of two classes are found equally often.
    """
    keys = [d.filter(F.concat(*[F.col(c).isNotNull().cast("int").cast("string") for c in on]) == "1" * len(on)).groupBy(ID, F.struct(*on).alias("key")).agg(F.count("*").alias("n")) for d in (a, b)]
    profiles = [d.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("held")).groupBy("held").agg(F.count("*").alias("ids")) for d in keys]
    left, right = (d.select(F.col("held").alias(f"{k}h"), F.col("ids").alias(f"{k}ids"), F.explode("held").alias("x")).select(f"{k}h", f"{k}ids", "x.key", F.col("x.n").alias(f"{k}n")) for d, k in zip(profiles, "lr", strict=True))
    often = left.join(right, "key").groupBy("lh", "rh").agg(F.sum(F.col("ln") * F.col("rn")).alias("times"), F.first(F.col("lids") * F.col("rids")).alias("pairs"))
    repeated = often.filter("times > 1").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n"))
    more = listed.groupBy(LEFT, RIGHT).agg(F.count("*").alias("m"))
    found = more.select(LEFT, RIGHT).join(keys[0].select(F.col(ID).alias(LEFT), "key", F.col("n").alias("ln")), LEFT).join(keys[1].select(F.col(ID).alias(RIGHT), "key", F.col("n").alias("rn")), [RIGHT, "key"])
    times = found.groupBy(LEFT, RIGHT).agg(F.sum(F.col("ln") * F.col("rn")).alias("times"))
    seen = more.join(times, [LEFT, RIGHT], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    again = seen.filter("times <= 1 and m + times > 1").agg(F.count("*").alias("n"))
    unknown = candidate_violations(listed, a, b).filter("violation <> 'duplicate'")
    return unknown.unionByName(repeated.unionByName(again).agg(F.lit("duplicate").alias("violation"), F.sum("n").cast("long").alias("n")))


def score_violations(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """violation, n: repeated, invented and missing pairs, null probabilities and those outside [0, 1]."""
    p = F.col("match_probability")
    found = _counted(duplicates(scores), "duplicate")
    for rows, name in (
        (scores.join(candidates, [LEFT, RIGHT], "left_anti"), "invented"),
        (candidates.join(scores, [LEFT, RIGHT], "left_anti"), "missing"),
        (scores.filter(p.isNull()), "null"),
        (scores.filter((p < 0) | (p > 1)), "out_of_range"),
    ):
        found = found.unionByName(_counted(rows, name))
    return found


def _raise_first(violations: DataFrame) -> None:
    for row in violations.filter("n > 0").collect():
        raise ContractError(f"{row['violation']}: {row['n']} rows")


def validate_candidates(candidates: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    _columns(candidates, [LEFT, RIGHT, "rules"])
    if candidates.isEmpty():
        raise ContractError("no candidates")
    _raise_first(candidate_violations(candidates, a, b))
    return candidates


def validate_scores(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    _columns(scores, [LEFT, RIGHT, "match_probability"])
    _raise_first(score_violations(scores, candidates))
    return scores


def answer_fields(df: DataFrame) -> list[str]:
    """Dotted names of the fields of df, at any depth of structs, arrays and map values, that are named as an answer is.

    Only the schema is read: what a field holds doesn't count, nor does a name that has an answer's name in it.
    """
    found, todo = [], [(f.name, f) for f in df.schema]
    for name, field in todo:
        if field.name.lower() in ANSWER_FIELDS:
            found.append(name)
        kind = field.dataType
        while isinstance(kind, (T.ArrayType, T.MapType)):
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if isinstance(kind, T.StructType):
            todo.extend((f"{name}.{f.name}", f) for f in kind)
    return sorted(found)


def without_answers(df: DataFrame) -> DataFrame:
    """df, if nothing in its schema gives an answer away."""
    if found := answer_fields(df):
        raise ContractError(f"fields {found} give answers away")
    return df
