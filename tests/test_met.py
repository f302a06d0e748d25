"""What classes score against all records of their brand, without pairs of them, against plain pairs."""

import random

import pytest
from pyspark.sql import functions as F

from linkwright.operators import classes as E
from linkwright.operators import decide as H
from linkwright.operators import evaluate as I
from linkwright.operators import met as V
from linkwright.operators.similarity import similar_sets
from linkwright.plans import queries as base
from linkwright.plans import sql as Q
from linkwright.sources.tables import ID, LEFT, RIGHT

_WORDS = ["red", "bolt", "old", "913", "10", "rod"]


def _sides(spark, a=40, b=90, seed=3):
    """Products with odd attributes: nulls, no words, words that are prices, prices near each other, a brand on one side only."""
    rng = random.Random(seed)
    title = lambda: rng.choice([None, "", "---", " ".join(rng.sample(_WORDS, rng.randrange(1, 4))), "red bolt", "bolt red"])
    row = lambda s, i: (f"{s}_{i}", title(), rng.choice([None, "SMALL", "ECONOMY", "10"]), rng.choice([None, "Brand#10", "Brand#2", f"only {s}"]), rng.choice([None, "x", "0", "913.10", "913.1", "900", "918.2", "1e999", str(rng.randrange(800, 1100))]))
    return [spark.createDataFrame([row(s, i) for i in range(n)], f"{ID} string, title string, category string, brand string, price string") for s, n in (("A", a), ("B", b))]


@pytest.mark.parametrize("asking, asked, parts", [(16_384, 65_536, 4), (5, 7, 1)])
def test_values_are_those_of_pairs(spark, monkeypatch, asking, asked, parts):
    for name, n in (("ASKING", asking), ("ASKED", asked), ("PARTS", parts)):
        monkeypatch.setattr(V, name, n)
    left, right = _sides(spark)
    a, b = (E.classes(d, base._ALIKE) for d in (left, right))
    x, y = (base._with_compared(d) for d in (a, b))
    pairs = base._labelled_pairs(x, y).localCheckpoint()
    got = V.values(x, y, base.WEIGHTS, Q.PRIOR_BITS, None).groupBy(F.col(ID).alias(LEFT), "bits").agg(F.sum("n").alias("n"), F.min("best").alias("best"), F.sum("m").alias("m"))
    want = pairs.groupBy(LEFT, "bits").agg(F.sum("nr").alias("n"), F.min(RIGHT).alias("best"), F.sum(F.col("label") * F.col("nr")).alias("m"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(got) == rows(want) and got.count() > 100
    mine = E.highest(V.values(x, y, base.WEIGHTS, Q.PRIOR_BITS).withColumnRenamed(ID, LEFT), LEFT)
    theirs = E.highest(V.values(y, x, base.WEIGHTS, Q.PRIOR_BITS).withColumnRenamed(ID, RIGHT), RIGHT)
    who = E.members(left, a, base._ALIKE)
    assert rows(E.top_outcomes(mine, who)) == rows(E.outcomes(pairs, who))
    assert rows(E.top_reciprocal(mine, theirs, who)) == rows(E.reciprocal_best(pairs, who))


@pytest.mark.parametrize("asking, asked, parts", [(16_384, 65_536, 4), (6, 9, 1)])
def test_nearest_sets_lose_none(spark, monkeypatch, asking, asked, parts):
    for name, n in (("ASKING", asking), ("ASKED", asked), ("PARTS", parts)):
        monkeypatch.setattr(V, name, n)
    tokens = lambda *on: F.array_distinct(F.filter(F.split(F.concat_ws(" ", *on), "[^a-z0-9]+"), lambda w: w != ""))
    held = [d.select(ID, "brand", tokens("title", "price").alias("tokens"), tokens("title").alias("head")) for d in _sides(spark, seed=5)]
    want = I.top_one(similar_sets(*[d.select(ID, "brand", "tokens") for d in held], 0.34, ["brand"]))
    got = I.top_one(V.nearest_sets(*held, 0.34).withColumnsRenamed({ID: LEFT, "best": RIGHT}))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10


def test_variants_and_errors_of_groups_are_those_of_pairs(spark):
    left, right = _sides(spark, 60, 60, 9)
    on = ["title", "category"]
    truth = left.select(F.col(ID).alias(LEFT), *on).join(right.select(F.col(ID).alias(RIGHT), *on), on).select(LEFT, RIGHT)
    rng = random.Random(1)
    scores = spark.createDataFrame([(f"A_{i}", f"B_{j}", float(rng.randrange(4))) for i in range(60) for j in rng.sample(range(60), 9)], f"{LEFT} string, {RIGHT} string, bits double")
    best = H.ranked(scores).filter("rank = 0").select(LEFT, RIGHT, "bits")
    tops = scores.join(scores.groupBy(RIGHT).agg(F.max("bits").alias("top")), RIGHT).filter("bits = top").groupBy(RIGHT, "top").agg(F.count("*").alias("n_top"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(I.one_to_one_grouped(best, tops, left, right, on)) == rows(I.one_to_one_variants(scores, best, truth))
    assert rows(I.error_classes_grouped(best, left, right, on)) == rows(I.error_classes(best, truth))


@pytest.mark.parametrize("name", ["accepted_pairs", "agreement", "baseline_evaluate", "bootstrap_2000", "bootstrap_ci", "error_classes", "one_to_one_variants", "paired_bootstrap"])
def test_decisions_list_no_pairs(spark, data, monkeypatch, name):
    """Neither pairs of products, nor of classes, nor true ones, nor those that share a token."""

    def listed(*_):
        raise AssertionError("pairs are listed")

    for where, what in ((base, "_brand_levels"), (base, "_scored"), (base, "_truth"), (base, "similar_sets")):
        monkeypatch.setattr(where, what, listed, raising=False)
    assert base.queries()[name](spark, data).count() > 0


def test_budget_lists_pairs_of_few_classes(spark, data, monkeypatch):
    seen = []
    levels = base._brand_levels
    monkeypatch.setattr(base, "_brand_levels", lambda a, b, *more: seen.append(a) or levels(a, b, *more))
    assert base.budget(spark, data).count() == 8
    assert [d.count() <= 8 for d in seen] == [True]


@pytest.mark.parametrize("name", ["pair_protocol", "label_value"])
def test_labels_are_counted_by_patterns(spark, data, monkeypatch, name):
    """Levels of all pairs of products are not listed."""

    def listed(*_):
        raise AssertionError("pairs are listed")

    for what in ("_levels", "_labelled", "_truth"):
        monkeypatch.setattr(base, what, listed)
    assert base.queries()[name](spark, data).count() > 0


def test_a_row_of_a_protocol_stands_for_many(spark):
    rows = [(float(b), y) for b in (-1, 5, 6, 9, 20) for y in (0, 1) for _ in range(3 * b % 7 + y)]
    pairs = spark.createDataFrame(rows, "bits double, label int")
    counted = pairs.groupBy("bits", "label").agg(F.count("*").alias("n"))
    assert I.pair_protocol(counted, 2e-5).collect() == I.pair_protocol(pairs, 2e-5).collect()
    assert I.pair_protocol(counted.limit(0), 2e-5).collect() == I.pair_protocol(pairs.limit(0), 2e-5).collect()
