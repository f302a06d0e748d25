"""Candidates in cells against plain pairs, and queries that shuffle and store none."""

import random

import pytest
from pyspark.sql import functions as F

from linkwright.operators import blocking as B
from linkwright.operators import cells
from linkwright.operators import scoring as G
from linkwright.operators.blocking import BITS, ClassicalBlocker, Settings
from linkwright.sources.tables import ID, LEFT, RIGHT

_WORDS = [f"w{i}" for i in range(30)]


def _records(rng, side, n):
    """Ids that repeat, nulls, records without words, several brands."""
    pick = lambda pool, most: rng.sample(pool, rng.randrange(most))
    return [(f"{side}_{rng.randrange(n)}" if i % 9 == 0 else f"{side}_{i}", pick(["x", "y", "z"], 3), pick(["i1", "i2", "i3", "i4"], 2), pick(_WORDS, 12), rng.choice([None, pick(_WORDS, 5)]), rng.choice([None, 1.0, 2.5])) for i in range(n)]


@pytest.mark.parametrize("parts, words, at_once", [((4, 8), 128, 100_000), ((1, 1), 64, 7), ((3, 2), 64, 1)])
def test_cells_find_what_pairs_have_in_common(spark, monkeypatch, parts, words, at_once):
    for name, value in (("PARTS", parts), ("WORDS", words), ("SLICE", at_once)):
        monkeypatch.setattr(cells, name, value)
    rng = random.Random(6)
    a, b = _records(rng, "A", 30), _records(rng, "B", 50)
    rare = [(f"A_{rng.randrange(32)}", f"B_{rng.randrange(52)}", rng.choice([1, 8])) for _ in range(90)]
    want: dict = {}
    ids = [{r[0] for r in d} for d in (a, b)]
    for l, r, bit in rare:
        if l in ids[0] and r in ids[1]:
            want[l, r] = want.get((l, r), 0) | bit
    for x in a:
        for y in b:
            bits = 2 * bool({*x[2]} & {*y[2]}) | 4 * (bool({*x[1]} & {*y[1]}) and len({*x[3]} & {*y[3]}) >= 2)
            if bits:
                want[x[0], y[0]] = want.get((x[0], y[0]), 0) | bits
    kind = f"{ID} string, brands array<string>, items array<string>, words array<string>, title_tokens array<string>, price double"
    left, right = (spark.createDataFrame(d, kind) for d in (a, b))
    met = spark.createDataFrame(rare, f"{LEFT} string, {RIGHT} string, found int")
    got = cells.found(left, right, met, 2, (2, 4)).collect()
    assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want) > 200
    rows = cells.found(left, right, met, 2, (2, 4), counted=True).collect()
    tally: dict = {}
    for r in rows:
        if r["found"] is not None:
            tally[r[LEFT], r["found"]] = tally.get((r[LEFT], r["found"]), 0) + r["n"]
    assert tally == {k: sum((l, f) == k for (l, _), f in want.items()) for k in {(l, f) for (l, _), f in want.items()}}
    assert {r[RIGHT] for r in rows if r["found"] is None} == {r for _, r in want}
    firsts = [d.dropDuplicates([ID]) if len({*i}) == 0 else d for d, i in zip((left, right), ids, strict=True)]
    single = [d.groupBy(ID).count().filter("count = 1") for d in firsts]  # of an id that repeats, any row may give the features
    known = lambda d: d.join(single[0].select(F.col(ID).alias(LEFT)), LEFT, "left_semi").join(single[1].select(F.col(ID).alias(RIGHT)), RIGHT, "left_semi")
    compared = known(cells.found(left, right, met, 2, (2, 4), ("title_tokens",), ("price",)).drop("found"))
    plain = G.pair_counts(known(spark.createDataFrame([k for k in want], f"{LEFT} string, {RIGHT} string")), left, right, ["title_tokens"], ["price"])
    order = lambda d: sorted(map(repr, (tuple(r) for r in d.select(plain.columns).collect())))
    assert order(compared) == order(plain) and compared.count() > 100


def test_candidates_are_counted_as_they_are_listed(spark):
    """Some records are reached by a rescue rule only."""
    rng = random.Random(2)
    kind = f"{ID} string, title string, category string, brand string, modelno string, price string"
    side = lambda s, n: spark.createDataFrame([(f"{s}_{i}", " ".join(rng.choices(["tall", "oven", "mitts", "newoven", "greyish", f"zq{i % 5}81bx"], k=rng.randrange(1, 4))), None, rng.choice(["acme", "bolt", None]), None, None) for i in range(n)], kind)
    a, b = side("A", 20), side("B", 40)
    blocker = ClassicalBlocker(Settings(rare_word=3, rare_ngram=3, neighbours=2))
    pairs = blocker.generate_candidates(a, b).localCheckpoint()
    assert pairs.filter("rules like '%R4%'").count() and pairs.filter("rules like '%R3%'").count()
    held, right = blocker.counted_candidates(a, b)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(B.counted_report(held)) == rows(B.rule_report(pairs))
    assert rows(B.counted_per_left(held, a)) == rows(B.per_left_counts(pairs, a))
    assert rows(B.counted_totals(held, right, a, b)) == rows(B.totals(pairs, a, b))


def test_pairs_of_a_brand_are_not_shuffled(spark):
    """An exchange by the pair would hold them all."""
    kind = f"{ID} string, title string, category string, brand string, modelno string, price string"
    a, b = (spark.createDataFrame([(f"{s}_{i}", "red old bolt", None, "acme", None, None) for i in range(12)], kind) for s in "AB")
    for found in (ClassicalBlocker().generate_candidates(a, b), ClassicalBlocker().rule_brand(a, b)):
        assert found.count() == 144
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsIn" in plan.split("Aggregate")[0]  # the pairs are not made distinct behind their cells
    assert BITS["R2"] == 2 and BITS["R3"] == 4


def test_candidates_are_compared_where_they_are_found(spark, data, monkeypatch):
    """Pairs are not listed before they are compared."""
    from linkwright.plans import queries as base

    def listed(*_, **__):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(G, "pair_counts", listed)
    monkeypatch.setattr(base, "_candidates", listed)
    for name in ("absences", "candidate_patterns", "candidate_scores", "prior_outcomes"):
        base.queries()[name](spark, data)
