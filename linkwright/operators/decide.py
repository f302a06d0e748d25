"""From scored pairs to outcomes: ranks, margins, vetoes, tie groups and review items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions import sets as S
from linkwright.sources.tables import ID, LEFT, RIGHT

ACCEPT_BITS, MARGIN_BITS, FLOOR_BITS, TIE_BITS, EXTRA = 6.0, 1.0, -3.5, 0.05, 10
ACCEPT, TIED, UNSURE, DIFFERENT, QUANTITY, NOT_RECIPROCAL = "accept", "review_tied", "review_unsure", "confidently_different", "review_quantity_conflict", "review_not_reciprocal"
REVIEWS = [TIED, UNSURE, QUANTITY, NOT_RECIPROCAL]


def ranked(scores: DataFrame) -> DataFrame:
    """0-based rank of each candidate by bits, ties to the smaller right id."""
    order = Window.partitionBy(LEFT).orderBy(F.col("bits").desc(), F.col(RIGHT))
    return scores.withColumn("rank", F.row_number().over(order) - 1)


def outcomes(scores: DataFrame, accept: float = ACCEPT_BITS, margin: float = MARGIN_BITS, floor: float = FLOOR_BITS) -> DataFrame:
    """One row for each left record: its best candidate, how far ahead that is, and the outcome."""
    order = Window.partitionBy(LEFT).orderBy(F.col("bits").desc(), F.col(RIGHT))
    top = scores.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("bits").over(order)).filter("rank = 1")
    return decided(top, accept, margin, floor)


def decided(top: DataFrame, accept: float = ACCEPT_BITS, margin: float = MARGIN_BITS, floor: float = FLOOR_BITS) -> DataFrame:
    """outcomes() of left records whose best candidate (right, bits) and next score are known."""
    gap = F.coalesce(F.col("bits") - F.col("next"), F.lit(float("inf")))
    outcome = F.when((F.col("bits") >= accept) & (F.col("margin_bits") > margin), ACCEPT).when(F.col("bits") >= accept, TIED).when(F.col("bits") >= floor, UNSURE).otherwise(DIFFERENT)
    out = top.withColumn("margin_bits", gap).withColumn("outcome", outcome)
    return out.select(LEFT, F.col(RIGHT).alias("best_candidate"), F.col("bits").alias("best_bits"), S.probability(F.col("bits")).alias("best_probability"), "margin_bits", "outcome")


def quantity_veto(decided: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Accepted records whose quantities conflict go to review; left and right hold (unique_id, quantities)."""
    l, r = left.select(F.col(ID).alias(LEFT), F.col("quantities").alias("ql")), right.select(F.col(ID).alias("best_candidate"), F.col("quantities").alias("qr"))
    met = decided.join(l, LEFT, "left").join(r, "best_candidate", "left")
    hit = (F.col("outcome") == ACCEPT) & F.coalesce(S.quantities_conflict(F.col("ql"), F.col("qr")), F.lit(False))
    return met.withColumn("outcome", F.when(hit, QUANTITY).otherwise(F.col("outcome"))).select(decided.columns)


def reciprocal_best(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(left, right) where the left's best is the only top scorer of that right record, in groups of ``by``, if given."""
    groups = by or []
    left = Window.partitionBy(*groups, LEFT).orderBy(F.col("bits").desc(), F.col(RIGHT))
    best = scores.withColumn("rank", F.row_number().over(left)).filter("rank = 1").select(*groups, LEFT, RIGHT, "bits")
    tops = scores.groupBy(*groups, RIGHT).agg(F.max("bits").alias("top"))
    at_top = scores.join(tops, [*groups, RIGHT]).filter(F.col("bits") == F.col("top")).groupBy(*groups, RIGHT).agg(F.max("top").alias("top"), F.count("*").alias("n_top"))
    return best.join(at_top.filter("n_top = 1"), [*groups, RIGHT]).filter(F.col("bits") == F.col("top")).select(LEFT, RIGHT)


def reciprocity_veto(decided: DataFrame, mutual: DataFrame) -> DataFrame:
    """Accepted records that aren't mutual go to review."""
    kept = mutual.select(F.col(LEFT), F.lit(True).alias("mutual"))
    met = decided.join(kept, LEFT, "left")
    hit = (F.col("outcome") == ACCEPT) & F.col("mutual").isNull()
    return met.withColumn("outcome", F.when(hit, NOT_RECIPROCAL).otherwise(F.col("outcome"))).select(decided.columns)


def tie_groups(values, width: float = TIE_BITS):
    """Group number of each value of a descending array; a group ends below its first value by more than width.

    The fold only notes where groups start: it copies a short array at each start, not a long one at each value.
    """
    state = "struct<starts:array<int>,n:int,l:double>"
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("l")).cast(state)

    def step(s, v):
        new = s["l"].isNull() | (s["l"] - v > width + 1e-9)
        return F.struct(F.when(new, F.concat(s["starts"], F.array(s["n"]))).otherwise(s["starts"]).alias("starts"), (s["n"] + 1).alias("n"), F.when(new, v).otherwise(s["l"]).alias("l")).cast(state)

    def numbered(s):
        places = F.when(s["n"] > 0, F.sequence(F.lit(0), s["n"] - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.size(F.filter(s["starts"], lambda x: x <= i)) - 1)

    return F.aggregate(values, start, step, numbered)


def grouped_candidates(scores: DataFrame, floor: float = FLOOR_BITS, width: float = TIE_BITS) -> DataFrame:
    """left, right, bits, rank and tie group of candidates at the floor or above."""
    pool = ranked(scores).filter(F.col("bits") >= floor)
    lists = pool.groupBy(LEFT).agg(F.array_sort(F.collect_list(F.struct("rank", RIGHT, "bits"))).alias("c"))
    both = lists.withColumn("g", tie_groups(F.transform("c", lambda x: x["bits"]), width))
    rows = both.select(LEFT, F.explode(F.arrays_zip("c", "g")).alias("x"))
    return rows.select(LEFT, F.col(f"x.c.{RIGHT}").alias(RIGHT), F.col("x.c.bits").alias("bits"), F.col("x.c.rank").alias("rank"), F.col("x.g").alias("group"))


def displayed(scores: DataFrame, floor: float = FLOOR_BITS, extra: int = EXTRA) -> DataFrame:
    """Candidates on a reviewer's screen: the first tie group whole and the next ``extra``; true_size of each group."""
    c = grouped_candidates(scores, floor)
    size = Window.partitionBy(LEFT, "group")
    rest = F.sum((F.col("group") > 0).cast("int")).over(Window.partitionBy(LEFT).orderBy("rank"))
    c = c.withColumn("true_size", F.count("*").over(size)).withColumn("nth", rest)
    return c.filter((F.col("group") == 0) | (F.col("nth") <= extra)).drop("nth")


def shuffle_key(salt: str, *parts):
    """An order that looks random, is fixed by salt, and shows no rank."""
    return F.md5(F.concat_ws("#", F.lit(salt), *parts))


def review_items(scores: DataFrame, decided: DataFrame, a: DataFrame, b: DataFrame, salt: str = "") -> DataFrame:
    """One nested row for each record to review: the record, its blocks of candidates and the allowed answers."""
    columns = [c for c in b.columns if c != ID]
    shown = displayed(scores).join(b.select(F.col(ID).alias(RIGHT), *columns), RIGHT)
    shown = shown.withColumn("key", shuffle_key(salt, F.col(LEFT), F.col(RIGHT)))
    member = F.struct(RIGHT, F.round("bits", 4).alias("bits"), S.probability(F.col("bits")).alias("match_probability"), *columns)
    blocks = shown.groupBy(LEFT, "group").agg(F.array_sort(F.collect_list(F.struct("key", member.alias("m")))).alias("rows"), F.count("*").alias("shown"), F.max("true_size").alias("true_size"))
    block = F.struct("group", (F.col("shown") > 1).alias("tied"), F.transform("rows", lambda x: x["m"]).alias("members"), "shown", "true_size", (F.col("shown") < F.col("true_size")).alias("truncated"))
    nested = blocks.groupBy(LEFT).agg(F.array_sort(F.collect_list(block)).alias("candidate_blocks"))
    total = scores.filter(F.col("bits") >= FLOOR_BITS).groupBy(LEFT).agg(F.count("*").alias("total_candidates_above_floor"))
    record = a.select(F.col(ID).alias(LEFT), F.struct(*columns).alias("record"))
    todo = decided.filter(F.col("outcome").isin(REVIEWS))
    margin = F.when(F.col("margin_bits") < float("inf"), F.round("margin_bits", 4))
    answers = F.array(*[F.lit(x) for x in ("match", "none_of_these", "cannot_tell")])
    return todo.join(record, LEFT).join(nested, LEFT).join(total, LEFT).select(LEFT, "record", F.col("outcome").alias("reason"), F.round("best_bits", 4).alias("best_bits"), margin.alias("margin_bits"), "candidate_blocks", "total_candidates_above_floor", answers.alias("allowed_outcomes"), F.lit(None).cast("string").alias("decision"))


def outcome_summary(decided: DataFrame) -> DataFrame:
    total = Window.partitionBy(F.lit(1))
    counts = decided.groupBy("outcome").agg(F.count("*").alias("n"))
    return counts.select("outcome", "n", F.round(F.col("n") / F.sum("n").over(total), 9).alias("share"))


def accepted(decided: DataFrame) -> DataFrame:
    return decided.filter(F.col("outcome") == ACCEPT).select(LEFT, F.col("best_candidate").alias(RIGHT), F.col("best_bits").alias("bits"))
