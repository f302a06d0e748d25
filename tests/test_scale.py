"""Global places, similar sets, resamples by classes and sampled diagnostics against plain loops."""

import random
from collections import Counter
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from linkwright.functions import sets as S
from linkwright.operators import analyses as N
from linkwright.operators import blocking as B
from linkwright.operators import classes as E
from linkwright.operators import contracts as C
from linkwright.operators import decide as H
from linkwright.operators import scoring as G
from linkwright.operators.blocking import ClassicalBlocker, Settings, grouped_counts, grouped_totals, nearest, per_left_counts, totals
from linkwright.operators import diagnostics as J
from linkwright.operators import evaluate as I
from linkwright.operators import review as L
from linkwright.operators.order import numbered
from linkwright.operators.similarity import similar_sets
from linkwright.plans import queries as base
from linkwright.sources.tables import ID, LEFT, RIGHT


@pytest.mark.parametrize("parts", ["1", "5"])
def test_places_and_running_sums(spark, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = random.Random(2)
        rows = [(i, rng.randrange(6), rng.choice([None, "a", "b"])) for i in range(300)]
        df = spark.createDataFrame(rows, "id int, v int, s string").repartition(7)
        got = numbered(df, [F.col("v").desc(), "id"], "place", {"total": F.col("v"), "n": F.lit(1)}).orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want, total = [], 0
    for place, (i, v, s) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        total += v
        want.append((i, v, s, place, total, place + 1))
    assert [tuple(r) for r in got] == want
    assert numbered(df.limit(0), ["id"]).count() == 0


def test_no_single_task_orders_all(spark):
    rows = spark.createDataFrame([("A", f"B{i}", float(i), i % 2) for i in range(50)], f"{LEFT} string, {RIGHT} string, bits double, label int")
    plan = I.acquisition(rows)._jdf.queryExecution().executedPlan().toString()
    # The only global window runs over the ranges, of which there is a row each.
    assert plan.count("SinglePartition") <= 1


@pytest.mark.parametrize("threshold", [0.2, 0.34, 0.5, 0.8, 1.0])
def test_similar_sets_lose_no_pair(spark, threshold):
    rng = random.Random(int(threshold * 100))
    pool = [f"w{i}" for i in range(30)]
    draw = lambda: sorted(set(rng.choices(pool, [30 - i for i in range(30)], k=rng.randrange(0, 9))))
    a, b = ({f"{s}_{i}": (draw(), rng.choice("xy")) for i in range(60)} for s in "AB")
    b |= {f"B_c{i}": x for i, x in enumerate(a.values())}
    frame = lambda d: spark.createDataFrame([(k, t, g) for k, (t, g) in d.items()], f"{ID} string, tokens array<string>, g string")
    score = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if set(x) | set(y) else 0.0
    for on in ([], ["g"]):
        want = {(k, m): score(t, u) for (k, (t, g)), (m, (u, h)) in product(a.items(), b.items()) if score(t, u) >= threshold and (not on or g == h)}
        got = {(r[0], r[1]): r[2] for r in similar_sets(frame(a), frame(b), threshold, on).collect()}
        assert got == want and len(got) > 20
    plan = similar_sets(frame(a), frame(b), threshold)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        similar_sets(frame(a), frame(b), 0.0)


def test_resamples_by_classes_agree_with_resamples_by_records(spark):
    rng = random.Random(4)
    rows = [(f"A_{i}", i, *rng.choice([(1, 0, 0), (0, 1, 1), (0, 0, 1), (0, 0, 0), (0, 1, 0)])) for i in range(150)]
    records = spark.createDataFrame(rows, f"{LEFT} string, nth long, tp int, fp int, fn int")
    one = I.percentile_interval(I.bootstrap(records, 1000, "x")).first()
    two = I.percentile_interval(I.bootstrap_classes(records, 2000, 5)).first()
    assert abs(one["low"] - two["low"]) < 2.5 and abs(one["high"] - two["high"]) < 2.5 and two["kept"] == 2000
    assert I.bootstrap_classes(records, 50, 5).collect() == I.bootstrap_classes(records.repartition(5), 50, 5).collect()
    assert I.contains(I.percentile_interval(I.bootstrap_classes(records)), (one["low"] + one["high"]) / 2).first()["contains"]
    with pytest.raises(ValueError, match="undefined"):
        I.bootstrap_classes(records.withColumn("tp", F.lit(0)).withColumn("fp", F.lit(0)).withColumn("fn", F.lit(0)))
    with pytest.raises(ValueError, match="classes"):
        I.class_draws(records, ["nth"], 5, most_classes=10)
    better = records.withColumn("fp", F.lit(0)).withColumn("tp", F.lit(1)).withColumn("fn", F.lit(0))
    paired = I.paired_classes(better, records).first()
    assert paired["significant"] and paired["favours_a"] == 1.0
    assert not I.paired_classes(records, records).first()["significant"]


def test_sampled_taxonomy_is_exact_or_close(spark):
    rng = random.Random(6)
    def side(s, n):
        return [(f"{s}_{i}", [f"w{rng.randrange(12)}" for _ in range(2)], [f"g{rng.randrange(5)}"], rng.choice("xyz")) for i in range(n)]
    rows = side("A", 60), side("B", 90)
    a, b = (spark.createDataFrame(r, f"{ID} string, tokens array<string>, grams array<string>, brand string").withColumn("tokens", F.array_distinct("tokens")) for r in rows)
    gone = {(x[0], y[0]) for x in rows[0][:30] for y in rows[1][:40]}
    kept = spark.createDataFrame(sorted(gone), f"{LEFT} string, {RIGHT} string")
    want = Counter()
    for x, y in product(*rows):
        if (x[0], y[0]) not in gone:
            n = len(set(x[1]) & set(y[1]))
            want["brand" if x[3] == y[3] else "common_words" if n else "common_sequences" if set(x[2]) & set(y[2]) else "nothing", min(n, 5)] += 1
    assert {(r[0], r[1]): r[2] for r in J.sampled_taxonomy(kept, a, b).collect()} == want
    some = J.sampled_taxonomy(kept, a, b, most=3000).collect()
    inside = sum(r["low"] <= want[r["reason"], r["shared"]] <= r["high"] for r in some)
    assert len(some) >= len(want) - 1 and inside >= len(some) - 1 and all(r["low"] < r["n"] < r["high"] for r in some)


def test_brand_rule_tells_frequent_words_from_others(spark):
    """Signatures settle pairs of frequent words; pairs that share rare words, or only brands, are compared whole."""
    words = [f"w{i}" for i in range(80)]
    row = lambda i, text, brand: (i, " ".join(text), None, brand, None, None)
    schema = "unique_id string, title string, category string, brand string, modelno string, price string"
    lots = [row(f"B_{i}", words[: 70 - i], "acme") for i in range(20)]
    a = spark.createDataFrame([row("A_0", words[:2], "acme"), row("A_1", ["rare", "seldom"], "acme"), row("A_2", ["acme", "bolt", "w0"], "bolt"), row("A_3", [], None), row("A_4", words[68:70], "acme")], schema)
    b = spark.createDataFrame([*lots, row("B_r", ["rare", "seldom", "x"], "acme"), row("B_b", ["acme", "bolt", "w0"], "bolt"), row("B_n", ["rare", "seldom"], None), row("B_o", words[:2], "other")], schema)
    got = {tuple(r) for r in ClassicalBlocker().rule_brand(a, b).collect()}
    of = lambda d: {r[0]: (set(" ".join(str(x) for x in r[1:] if x is not None).split()), r["brand"]) for r in d.collect()}
    left, right = of(a), of(b)
    vocabulary = {br for _, br in [*left.values(), *right.values()] if br}
    brands = lambda w, br: (w & vocabulary) | ({br} if br else set())
    want = {(i, j) for i, (w, br) in left.items() for j, (v, bs) in right.items() if brands(w, br) & brands(v, bs) and len((w & v) - brands(w, br)) >= 2}
    assert got == want and ("A_1", "B_r") in got and ("A_4", "B_0") in got


def test_features_stay_in_their_cells(spark, monkeypatch):
    rng = random.Random(9)
    some = lambda pool, most: rng.choice([None, sorted(rng.sample(pool, rng.randrange(1, most)))])
    words = [f"w{i}" for i in range(25)]
    kind = f"{ID} string, " + ", ".join(f"{c} array<string>" for c in G.COMPARISONS if c != "price_value") + ", price_value double"
    side = lambda s, n: spark.createDataFrame([(f"{s}_{i}", *[some(words, 9) for _ in range(5)], rng.choice([None, 1.0, 1.01, 1.1, 5.0])) for i in range(n)], kind)
    a, b = side("A", 40), side("B", 60)
    pairs = a.select(F.col(ID).alias(LEFT)).crossJoin(b.select(F.col(ID).alias(RIGHT))).unionByName(spark.createDataFrame([("A_0", "B_x"), ("A_x", "B_0")], f"{LEFT} string, {RIGHT} string"))
    want = sorted(map(tuple, G.gammas(G.pair_features(pairs, a, b)).collect()))
    assert len(want) == 2400
    for chars, most in ((48_000_000, 1_000_000), (3000, 100)):
        monkeypatch.setattr(G, "CELL_CHARS", chars)
        monkeypatch.setattr(G, "CELL_PAIRS", most)
        counts = G.pair_counts(pairs, a, b)
        assert sorted(map(tuple, G.pair_levels(pairs, a, b).collect())) == want
        assert not any("array" in t for _, t in counts.dtypes)
    assert sorted(map(tuple, N.absences(counts).collect())) == sorted(map(tuple, N.absences(G.pair_features(pairs, a, b)).collect()))


def test_decisions_of_classes_are_those_of_records(spark):
    rng = random.Random(11)
    a, b = ([(f"{s}_{i}", rng.choice([None, "x", "y", "z"]), rng.randrange(4), rng.choice([None, 1.0, 2.0])) for i in range(n)] for s, n in (("A", 30), ("B", 50)))
    on = ["k", "v", "p"]
    left, right = (spark.createDataFrame(d, f"{ID} string, k string, v int, p double") for d in (a, b))
    ca, cb = E.classes(left, on), E.classes(right, on)
    assert ca.count() < 30 and sorted(r[0] for r in E.members(left, ca, on).collect()) == sorted(r[0] for r in a)
    bits = F.when(F.col("lv") == F.col("rv"), 7.0).otherwise(F.abs(F.col("lv") - F.col("rv")).cast("double") * 0.25) + F.when(F.col("lp") == F.col("rp"), 1.5).otherwise(0.0)

    def scored(l, r, *more):
        l, r = (d.select(F.col(ID).alias(n), "k", *[F.col(c).alias(f"{p}{c}") for c in ("v", "p", *more)]) for d, n, p in ((l, LEFT, "l"), (r, RIGHT, "r")))
        return l.join(r, "k").select(LEFT, RIGHT, bits.alias("bits"), *[F.col(f"{p}{c}").alias(f"{c}{p}") for c in more for p in "lr"])

    records, pairs, who = scored(left, right), scored(ca, cb, "n"), E.members(left, ca, on)
    assert pairs.count() < records.count()
    assert E.outcomes(pairs, who).columns == H.outcomes(records).columns
    assert sorted(map(tuple, E.outcomes(pairs, who).collect())) == sorted(map(tuple, H.outcomes(records).collect()))
    # One record that is alone at the top, and copies that are not.
    one = [("A_a", "k1", 0, None), ("A_b", "k2", 0, None), ("A_c", "k2", 0, None)], [("B_a", "k1", 0, None), ("B_b", "k1", 0, None), ("B_c", "k2", 0, None)]
    left, right = (spark.createDataFrame(d, f"{ID} string, k string, v int, p double") for d in one)
    ca, cb = E.classes(left, on), E.classes(right, on)
    got, want = E.reciprocal_best(scored(ca, cb, "n"), E.members(left, ca, on)), H.reciprocal_best(scored(left, right))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [("A_a", "B_a")]


def test_true_pairs_are_counted_by_groups(spark):
    a, b = (spark.createDataFrame([(f"{s}_{i}", f"t{i % m}" if i % 5 else None) for i in range(40)], f"{ID} string, t string") for s, m in (("A", 6), ("B", 9)))
    truth = a.select(F.col(ID).alias(LEFT), "t").join(b.select(F.col(ID).alias(RIGHT), "t"), "t").select(LEFT, RIGHT)
    chosen = spark.createDataFrame([(f"A_{i}", f"B_{i % 7}") for i in range(20)], f"{LEFT} string, {RIGHT} string")
    assert I.evaluate_grouped(chosen, a, b, ["t"]).collect() == I.evaluate_pairs(chosen, truth).collect()


def test_equal_products_are_no_pairs(spark, tmp_path):
    """100 copies of a few products: plans that list pairs of records would have 10,000 times as many."""
    from linkwright.plans import queries as base

    rows = [(5 * i + s, f"red w{i % 3}", "Brand#1", "SMALL", 900.0 + i % 2, 5) for i in range(300) for s in (0, 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    pairs, who = base._scored_classes(spark, str(tmp_path))
    assert pairs.count() == 36 and who.count() == 300
    assert base.accepted_pairs(spark, str(tmp_path)).count() == 0 and base.baseline_decide(spark, str(tmp_path)).count() == 300


def test_nearest_meets_classes_and_loses_none(spark):
    rng = random.Random(13)
    pool = [rng.sample("abcdefgh", rng.randrange(0, 5)) for _ in range(12)]
    q, t = ([(f"{s}{i}", rng.choice(pool)) for i in range(n)] for s, n in (("q", 40), ("t", 90)))
    frame = lambda d: spark.createDataFrame(d, f"{ID} string, grams array<string>")
    for k in (1, 7, 100):
        want = set()
        for i, x in q:
            near = sorted(((len({*x} & {*y}) / len({*x} | {*y}), j) for j, y in t if {*x} & {*y}), reverse=True)[:k]
            want |= {(i, j, s, n + 1) for n, (s, j) in enumerate(near)}
        assert {tuple(r) for r in nearest(frame(q), frame(t), k).collect()} == want
    # 60 equal records of each side: one pair of classes, not 3,600 of records.
    plan = nearest(frame([(f"q{i}", ["a", "b"]) for i in range(60)]), frame([(f"t{i}", ["a"]) for i in range(60)]), 5)
    assert plan.count() == 300 and "class" in plan._jdf.queryExecution().analyzed().toString()


def test_group_sizes_tell_what_pairs_tell(spark):
    a, b = (spark.createDataFrame([(f"{s}_{i}", rng, f"t{i % m}") for i in range(40) for rng in [None if i % 11 == 0 else "x"]], f"{ID} string, k string, t string") for s, m in (("A", 6), ("B", 4)))
    on = ["k", "t"]
    pairs = a.select(F.col(ID).alias(LEFT), *on).join(b.select(F.col(ID).alias(RIGHT), *on), on).select(LEFT, RIGHT)
    assert grouped_totals(a, b, on).collect() == totals(pairs, a, b).collect()
    assert sorted(map(tuple, grouped_counts(a, b, on).collect())) == sorted(map(tuple, per_left_counts(pairs, a).collect()))
    assert J.spread_of_counts(grouped_counts(a, b, on), b, 9).collect() == J.exclusion_spread(pairs, a, b, 9).collect()
    # One row for each record or group, whatever the number of pairs: no join on both ids.
    assert LEFT not in grouped_totals(a, b, on)._jdf.queryExecution().analyzed().toString()


def test_pairs_with_several_identifiers_are_told_once(spark):
    rows = lambda s, titles: spark.createDataFrame([(f"{s}_{i}", t, None, None, None, None) for i, t in enumerate(titles)], f"{ID} string, title string, category string, brand string, modelno string, price string")
    a, b = rows("A", ["ab123 cd456 ef789", "ab123 plain", "none"]), rows("B", ["ab123 ef789", "cd456 zz", "ef789 cd456 ab123 ab123"])
    found = ClassicalBlocker().rule_identifier(a, b)
    assert sorted(map(tuple, found.collect())) == [("A_0", "B_0"), ("A_0", "B_1"), ("A_0", "B_2"), ("A_1", "B_0"), ("A_1", "B_2")]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs are not shuffled to become distinct


def test_rules_of_a_pair_are_flags_that_are_shuffled_once(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(40)] + [f"zq{i}81bx" for i in range(6)]
    schema = "unique_id string, title string, category string, brand string, modelno string, price string"
    side = lambda s, n: spark.createDataFrame([(f"{s}_{i}", " ".join(rng.choices(words, k=rng.randrange(1, 6))), None, rng.choice(["acme", "bolt", None]), None, None) for i in range(n)], schema)
    a, b = side("A", 30), side("B", 50)
    blocker = ClassicalBlocker(Settings(rare_word=6, rare_ngram=8))
    # Sets of names would fall back to sorting all pairs.
    assert "collect_set(rule" not in blocker.generate_candidates(a, b)._jdf.queryExecution().toString()
    want: dict = {}
    for name, rule in (("R1", blocker.rule_word), ("R2", blocker.rule_identifier), ("R3", blocker.rule_brand), ("R5", blocker.rule_ngram)):
        rows = [tuple(r) for r in rule(a, b).collect()]
        assert len(rows) == len(set(rows)) > 0
        for pair in rows:
            want.setdefault(pair, []).append(name)
    got = {(r[0], r[1]): r["rules"].split("+") for r in blocker.generate_candidates(a, b).collect()}
    assert {k: v for k, v in got.items() if not any(r.startswith("R4") for r in v)} == want
    assert sum(map(len, got.values())) == blocker.candidates_by_rule(a, b).count()


def test_cells_without_pairs(spark):
    side = lambda s: spark.createDataFrame([(f"{s}_0", ["x", "y"]), (f"{s}_1", ["y"])], f"{ID} string, words array<string>")
    pairs = spark.createDataFrame([("A_0", "B_0"), ("A_1", "B_x")], f"{LEFT} string, {RIGHT} string")
    got = lambda p: [tuple(r) for r in G.shared_members(p, side("A"), side("B"), "words").collect()]
    assert got(pairs) == [("A_0", "B_0", 2)] and got(pairs.limit(0)) == [] and got(pairs.filter(F.col(RIGHT) == "B_x")) == []


def test_discards_of_classes_are_those_of_records(spark):
    rng = random.Random(6)
    on = ["brand", "title"]
    side = lambda s, n: spark.createDataFrame([(f"{s}_{i}", rng.choice("xy"), rng.choice(["red bolt", "red nut", "old cup", "q"])) for i in range(n)], f"{ID} string, brand string, title string")
    a, b = side("A", 40), side("B", 60)

    def told(a, b):
        pairs = a.select(F.col(ID).alias(LEFT), *on).join(b.select(F.col(ID).alias(RIGHT), *on), on).select(LEFT, RIGHT)
        a, b = (d.withColumns({"tokens": F.split("title", " "), "grams": F.split("title", "")}) for d in (a, b))
        return sorted(map(tuple, J.discard_taxonomy(pairs, a, b).filter("n > 0").collect()))

    classes = told(E.classes(a, on), E.classes(b, on))
    assert classes == told(a, b) and sum(r[2] for r in classes) < 2400 and len(classes) > 2


def test_shortlist_within_is_the_shortlist_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 12)
    rng = random.Random(8)
    pool = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(25)] + [[0.0, 0.0, 0.0], [1.0, None, 2.0], None, [1.0, 2.0], [float("nan"), 1.0, 1.0], []]
    side = lambda s, n: spark.createDataFrame([(f"{s}_{i}", rng.choice(pool), rng.choice(["x", "y", "z" + s, None])) for i in range(n)], f"{ID} string, vec array<double>, label string")
    a, b = side("A", 50), side("B", 90)
    pairs = a.select(F.col(ID).alias(LEFT), "label").join(b.select(F.col(ID).alias(RIGHT), "label"), "label")
    for k in (4, 60):
        rows = lambda d: sorted((r[LEFT], r["rank"], r[RIGHT], repr(r["cosine"])) for r in d.collect())
        assert rows(L.shortlist_within(a, b, "label", k)) == rows(L.shortlist(pairs, a, b, k))


def test_budget_of_classes_is_that_of_pairs(spark):
    """Equal values, ties at the k-th match, classes of several records and more wanted than there are."""
    rng = random.Random(8)
    left = [(f"A_{i}", f"A_{i % 5}") for i in range(23)]
    right = [(f"B_{i}", f"B_{i % 4}") for i in range(31)]
    sizes = [Counter(c for _, c in d) for d in (left, right)]
    labelled = [(p, q, sizes[0][p], sizes[1][q], float(rng.randrange(3)), int(rng.random() < 0.3)) for p, q in product(sizes[0], sizes[1]) if rng.random() < 0.9]
    ks = [0, 1, 2, 10, 40, 100, 5000]
    schema = f"{LEFT} string, {RIGHT} string, nl long, nr long, bits double, label int"
    members = [spark.createDataFrame(d, f"{ID} string, class string") for d in (left, right)]
    got = {r["k"]: (r["cost"], r["exhausted"]) for r in E.budget(spark.createDataFrame(labelled, schema), *members, ks).collect()}
    pairs = [(x, y, b, m) for p, q, _, _, b, m in labelled for x, c in left if c == p for y, d in right if d == q]
    listed = spark.createDataFrame(pairs, f"{LEFT} string, {RIGHT} string, bits double, label int")
    assert got == {r["k"]: (r["cost"], r["exhausted"]) for r in I.budget(I.acquisition(listed), ks).collect()}
    assert got[0] == (0, False) and got[5000] == (len(pairs), True) and not got[1][1]


def test_violations_of_groups_are_those_of_pairs(spark):
    """Ids that repeat, under one key and under several, listed pairs that are in the groups or unknown, keys that are null."""
    rng = random.Random(4)
    rows = lambda side, n: [(f"{side}_{rng.randrange(n)}", rng.choice("xyz"), rng.choice(["p", "q", None])) for _ in range(n)]
    a, b = (spark.createDataFrame(rows(s, n), f"{ID} string, brand string, title string") for s, n in (("A", 14), ("B", 20)))
    pairs = a.withColumnRenamed(ID, LEFT).join(b.withColumnRenamed(ID, RIGHT), ["brand", "title"]).select(LEFT, RIGHT)
    more = pairs.filter(F.col(LEFT) < "A_3").unionByName(pairs.filter(F.col(LEFT) == "A_5").select(F.col(RIGHT).alias(LEFT), F.col(LEFT).alias(RIGHT)))
    for listed in (more, more.limit(0), pairs):
        want = {r["violation"]: r["n"] for r in C.candidate_violations(pairs.unionByName(listed), a, b).collect()}
        got = C.grouped_violations(a, b, ["brand", "title"], listed)
        assert {r["violation"]: r["n"] for r in got.collect()} == want and want["duplicate"] > 0


def test_budget_and_violations_list_no_pairs_of_a_brand(spark, data, monkeypatch):
    """The queries read classes: neither asks for scored pairs or all pairs of equal titles."""
    from linkwright.plans import queries as base

    monkeypatch.setattr(base, "_scored", None)
    monkeypatch.setattr(base.C, "duplicates", lambda df: (_ for _ in ()).throw(AssertionError("pairs are grouped")) if df.count() > 2000 else df.groupBy(LEFT, RIGHT).count().filter("count > 1"))
    assert base.budget(spark, data).count() == 8 and base.candidates_violations(spark, data).count() == 3


def test_features_and_rules_read_texts_once(spark):
    """Tokens of a text are written once, not computed again by each step that reads them."""
    from linkwright.operators import features as D
    from linkwright.operators import training as T

    a, b = (spark.createDataFrame([(f"{s}_{i}", f"word{i} item{i % 3}x", None, "brand", None, "1") for i in range(4)], f"{ID} string, title string, category string, brand string, modelno string, price string") for s in "AB")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    for side in D.features_of(a, b):
        assert plan(side).count("regexp_extract_all(lower(title") == 1 and "concat_ws" not in plan(side)
    pairs, keys = T.rule_pairs(a, b)
    assert "regexp_extract_all" not in plan(pairs) + plan(keys)


def _parts(spark, folder):
    """Odd parts: prices that repeat, are null or zero, keys that are null or repeat, names and brands that are null, one large group."""
    rng = random.Random(11)
    rows = [(i, "n" if i < 60 else rng.choice(["m", "o", None]), "x" if i < 60 else rng.choice(["x", "y", None]), rng.choice("tu"), rng.randrange(4), rng.choice([None, 0.0, 1.5, 2.5, 7.25])) for i in range(100)]
    rows += [(None, "n", "x", "t", 1, 2.5), (7, "n", "x", "t", 1, 2.5), (7, "n", "x", "u", 2, None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["price_gap", "quantity_conflict", "pair_key_explode"])
def test_pairs_of_equal_titles_meet_as_chunks(spark, tmp_path, monkeypatch, name):
    """A group of equal titles is no single task, and chunks of any size list the pairs of SQL, odd values and keys included."""
    folder = _parts(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    known = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    for chunk in (1, 3, 1024):
        monkeypatch.setattr(B, "CHUNK", chunk)
        found = base.queries()[name](spark, folder)
        assert known(tuple(r) for r in found.collect()) == known(con.execute(base.oracle_sql()[name]).fetchall())
        assert sum(n > 0 for n in found.rdd.glom().map(len).collect()) > 2


def test_acquisition_of_classes_is_that_of_pairs(spark, monkeypatch):
    """Equal values over several records and classes: every place and count, and no sort of all pairs."""
    sorted_rows = []
    monkeypatch.setattr(E, "numbered", lambda df, *args: (sorted_rows.append(df.count()), numbered(df, *args))[1])
    rng = random.Random(9)
    left = [(f"A_{i}", f"A_{i % 5}") for i in range(17)]
    right = [(f"B_{i}", f"B_{i % 4}") for i in range(23)]
    sizes = [Counter(c for _, c in d) for d in (left, right)]
    labelled = [(p, q, sizes[0][p], sizes[1][q], float(rng.randrange(3)), int(rng.random() < 0.3)) for p, q in product(sizes[0], sizes[1]) if rng.random() < 0.9]
    members = [spark.createDataFrame(d, f"{ID} string, class string") for d in (left, right)]
    got = E.acquisition(spark.createDataFrame(labelled, f"{LEFT} string, {RIGHT} string, nl long, nr long, bits double, label int"), *members)
    pairs = [(x, y, b, m) for p, q, _, _, b, m in labelled for x, c in left if c == p for y, d in right if d == q]
    listed = I.acquisition(spark.createDataFrame(pairs, f"{LEFT} string, {RIGHT} string, bits double, label int"))
    columns = [LEFT, RIGHT, "bits", "label", "found", "cost"]
    assert got.columns == columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, listed.select(columns).collect()))
    assert sum(sorted_rows) < len(pairs) / 4


@pytest.mark.parametrize("block", [4, 4096])
def test_cosines_in_cells_are_those_of_pairs(spark, monkeypatch, block):
    """Gaps, zeros, lengths that differ, values that are not finite, halves at the sixth place, equal ids; a label is no single task."""
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "SLICE", 3)
    rng = random.Random(3)
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1e-30, 1.0, 0.0]]
    halves = [[1.0, 0.0, 0.0, 0.0], [0.0078125, 0.9999694815187804, 0.0, 0.0], [-0.0078125, 0.9999694815187804, 0.0, 0.0]]
    vectors = odd + halves + [[rng.choice([-1.0, 0.5, rng.gauss(0, 1)]) for _ in range(rng.choice([3, 4]))] for _ in range(14)]
    rows = [(i, v, label) for label in (1, 2) for i, v in enumerate(vectors)] + [(5, [1.0, 2.0, 3.0], 1), (None, [1.0, 2.0, 3.0], 1), (99, [1.0, 2.0, 3.0], None)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    a, b = (df.select(F.col("id").alias(k), "label", F.col("vec").alias(f"{k}v")) for k in ("l", "r"))
    want = a.join(b, "label").filter("l < r").select("l", "r", F.round(S.cosine(F.col("lv"), F.col("rv")), 6).alias("cosine"))
    got = L.cosines_within(df, "label")
    told = lambda d: sorted((r["l"], r["r"], repr(r["cosine"])) for r in d.collect())
    assert told(got) == told(want)
    assert block > 4 or sum(n > 0 for n in got.rdd.glom().map(len).collect()) > 2
    assert told(L.cosines_within(df.limit(0), "label")) == []


def test_rare_postings_are_made_once(spark):
    """Items above the cutoff go, others keep all their records; what makes the postings is in the plan once."""
    rows = [(f"B_{i}", x) for i in range(6) for x in (["a"] if i < 3 else ["b", "c"] if i < 5 else ["a", None])]
    index = B.dealt(spark.createDataFrame(rows, f"{ID} string, item string"), "item")
    found = B.rare(index, 3)
    assert sorted(map(tuple, found.collect())) == sorted((k, x) for k, x in rows if x in ("b", "c"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
