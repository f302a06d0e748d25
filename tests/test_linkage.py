import re

import pytest
from pyspark.sql import functions as F

from linkwright.functions import text as X
from linkwright.operators import contracts as C
from linkwright.operators import decide as H
from linkwright.operators import evaluate as I
from linkwright.operators import features as D
from linkwright.operators import review as L
from linkwright.operators import scoring as G
from linkwright.operators import training as T
from linkwright.operators.blocking import ClassicalBlocker, Settings, candidate_map, nearest, rule_report
from linkwright.sources import tables as A
from linkwright.streaming import windows as K

RECORD = "unique_id string, title string, category string, brand string, modelno string, price string"


def make(spark, side, rows):
    return spark.createDataFrame([(f"{side}_{i}", r.get("title"), r.get("category"), r.get("brand"), r.get("modelno"), r.get("price")) for i, r in enumerate(rows)], RECORD)


def pairs(df):
    return {(r[0], r[1]) for r in df.select(A.LEFT, A.RIGHT).collect()}


def scores(spark, rows):
    return spark.createDataFrame([(a, b, float(x)) for a, b, x in rows], "unique_id_l string, unique_id_r string, bits double")


def outcome(spark, rows):
    return {r[0]: r["outcome"] for r in H.outcomes(scores(spark, rows)).collect()}


# Sources


def test_csv_cells_and_ids(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title,price\n1,"say ""hi"", ok",\n2,NA,null\n')
    got = [tuple(r) for r in A.read_catalogue(spark, f"{tmp_path}/a.csv", "A").orderBy("unique_id").collect()]
    assert got == [("A_1", 'say "hi", ok', None), ("A_2", "NA", "null")]
    (tmp_path / "b.csv").write_text("id,title\n1,x\n1,y\n")
    with pytest.raises(ValueError, match="repeated"):
        A.read_catalogue(spark, f"{tmp_path}/b.csv", "B")
    with pytest.raises(ValueError, match="columns differ"):
        (tmp_path / "c.csv").write_text("id,other\n1,x\n")
        A.read_pair(spark, f"{tmp_path}/a.csv", f"{tmp_path}/c.csv")
    with pytest.raises(KeyError, match="products"):
        A.dataset_folder({"products": "x"}, "y")


def test_labels_are_locked(spark, tmp_path):
    (tmp_path / "valid.csv").write_text("ltable_id,rtable_id,label\n1,2,1\n")
    with pytest.raises(PermissionError):
        A.read_labels(spark, str(tmp_path), "valid")
    with pytest.raises(ValueError):
        A.read_labels(spark, str(tmp_path), "other", unlocked=True)
    assert [tuple(r) for r in A.read_labels(spark, str(tmp_path), "valid", unlocked=True).collect()] == [("A_1", "B_2", 1)]


def test_sinks_and_logs(spark, tmp_path):
    c = spark.createDataFrame([("A_1", "B_2", "R1+R5")], A.CANDIDATES)
    A.save_pairs(c, f"{tmp_path}/c")
    assert A.read_candidates(spark, f"{tmp_path}/c").collect() == c.collect()
    for n, x in ((1, "old"), (2, "new")):
        A.append_log(spark.createDataFrame([("k", n, x)], "key string, seq int, value string"), f"{tmp_path}/log")
    assert A.read_log(spark, f"{tmp_path}/log", "key string, seq int, value string", "key", "seq").collect()[0]["value"] == "new"
    assert A.snapshot_differences(c, c).isEmpty()


# Blocking


def test_brand_rule_needs_two_more_words(spark):
    a = make(spark, "A", [{"title": "acme alpha beta", "brand": "acme"}])
    b = make(spark, "B", [{"title": "acme zeta"}, {"title": "acme alpha"}, {"title": "acme alpha beta"}])
    assert pairs(ClassicalBlocker().rule_brand(a, b)) == {("A_0", "B_2")}


def test_brand_is_found_in_the_title(spark):
    a, b = make(spark, "A", [{"title": "acme widget xl"}, {"title": "x", "brand": "HP!"}]), make(spark, "B", [{"title": "widget", "brand": "acme"}])
    got = {tuple(r) for r in D.brand_harvest(a, D.tokenised(a), D.brand_vocabulary(a, b)).collect()}
    assert got == {("A_0", "acme"), ("A_1", "hp!")}


def test_rescue_is_silent_where_rules_fire_and_capped_elsewhere(spark):
    a = make(spark, "A", [{"title": "zq81b55tt keyboard"}])
    got = ClassicalBlocker().generate_candidates(a, make(spark, "B", [{"title": "zq81b55tt keyboard"}])).collect()
    assert len(got) == 1 and "R4" not in got[0]["rules"] and "R2" in got[0]["rules"]
    many = make(spark, "B", [{"title": "gadget"}] * 125)
    by_rule = ClassicalBlocker(Settings()).candidates_by_rule(make(spark, "A", [{"title": "gadget"}]), many)
    assert by_rule.filter("rule = 'R4'").count() == 100


def test_short_sequences_rescue(spark):
    a, b = make(spark, "A", [{"title": "tall oven mitt in grey"}]), make(spark, "B", [{"title": "newoven tall mit oven"}, {"title": "mitto"}])
    settings = Settings(rare_word=0, rare_ngram=0, brand_words=9)
    got = ClassicalBlocker(settings).candidates_by_rule(a, b)
    assert {(r["unique_id_r"], r["rule"]) for r in got.collect()} == {("B_0", "R4-short"), ("B_1", "R4-short")}


def test_nearest_breaks_ties_by_larger_id(spark):
    g = lambda rows: spark.createDataFrame(rows, "unique_id string, grams array<string>")
    got = nearest(g([("q", ["a", "b"])]), g([("t1", ["a"]), ("t2", ["a"]), ("t3", ["z"])]), 5).orderBy("place").collect()
    assert [r["t"] for r in got] == ["t2", "t1"]


def test_provenance_report_and_map(spark):
    c = spark.createDataFrame([("A_0", "B_0", "R1+R5"), ("A_0", "B_1", "R1")], A.CANDIDATES)
    report = {r["rule"]: (r["n_pairs"], r["n_unique"], r["n_left"]) for r in rule_report(c).collect()}
    assert report == {"R1": (2, 1, 1), "R5": (1, 0, 1)}
    a = make(spark, "A", [{}, {}])
    assert {r[0]: r[1] for r in candidate_map(c, a).collect()} == {"A_0": ["B_0", "B_1"], "A_1": []}


def test_blocking_never_compares_all_pairs(spark):
    a, b = make(spark, "A", [{"title": "x y"}]), make(spark, "B", [{"title": "x z"}])
    blocker = ClassicalBlocker()
    for rule in (blocker.rule_word, blocker.rule_identifier, blocker.rule_brand, blocker.rule_ngram):
        plan = rule(a, b)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


# Features


def test_features_without_evidence_are_null(spark):
    a = make(spark, "A", [{"title": "---"}, {"title": "widget rr7788vv 1080p", "brand": "sony", "price": "0"}])
    b = make(spark, "B", [{"title": "widget 1080p"}] * 6)
    fa, _ = D.features_of(a, b)
    got = {r["unique_id"]: r for r in fa.collect()}
    assert all(got["A_0"][c] is None for c in [*D.FEATURES, "price_value"])
    assert got["A_1"]["rare_identifier_tokens"] == ["rr7788vv"] and got["A_1"]["common_identifier_tokens"] == ["1080p"] and got["A_1"]["brand_terms"] == ["sony"]


# Contracts


def test_contract_violations_raise(spark):
    a, b = make(spark, "A", [{}]), make(spark, "B", [{}])
    ok = spark.createDataFrame([("A_0", "B_0", "R1")], A.CANDIDATES)
    assert C.validate_candidates(ok, a, b) is ok
    bad = [spark.createDataFrame(x, A.CANDIDATES) for x in ([("B_0", "A_0", "R1")], [("A_0", "B_0", "R1")] * 2, [("A_9", "B_0", "R1")], [])]
    for df in [*bad, ok.drop("rules")]:
        with pytest.raises(C.ContractError):
            C.validate_candidates(df, a, b)
    for rows in ([("A_0", "B_0", 0.5)] * 2, [("A_0", "B_1", 0.5)], [], [("A_0", "B_0", None)], [("A_0", "B_0", 1.5)]):
        with pytest.raises(C.ContractError):
            C.validate_scores(spark.createDataFrame(rows, A.SCORES), ok)


def test_answers_are_found_at_any_depth(spark):
    leaking = spark.createDataFrame([], "id int, Gold string, shown array<struct<m: map<string, struct<y: int, year: int>>>>")
    assert C.answer_fields(leaking) == ["Gold", "shown.m.y"]
    with pytest.raises(C.ContractError, match="shown.m.y"):
        C.without_answers(leaking)
    fine = spark.createDataFrame([("truth",)], "labelled string")
    assert C.without_answers(fine) is fine


# Scoring


def test_levels(spark):
    rows = [(["a", "b"], ["b", "a"]), (["a", "b", "c"], ["b", "c", "d"]), (["a"], ["b"]), (None, ["a"])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(G.title_level(F.col("a"), F.col("b")), G.overlap_level(F.col("a"), F.col("b"), (2, 1))).collect()
    assert [tuple(r) for r in got] == [(4, 2), (2, 2), (0, 0), (-1, -1)]
    prices = [(10.0, 10.0), (100.0, 98.0), (100.0, 90.0), (100.0, 80.0), (100.0, 50.0), (None, 1.0)]
    got = spark.createDataFrame(prices, "a double, b double").select(G.price_level(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [4, 3, 2, 1, 0, -1]


def test_training_ranks_the_same_record_first(spark):
    names = ["red lamp alpha", "blue desk beta", "green chair gamma", "white shelf delta", "black stool omega"]
    a = make(spark, "A", [{"title": t, "brand": "acme", "price": str(i + 1)} for i, t in enumerate(names)])
    b = make(spark, "B", [{"title": t, "brand": "acme", "price": str(i + 1)} for i, t in enumerate(reversed(names))])
    fa, fb = D.features_of(a, b)
    model, _ = T.train(fa, fb, G.Model(prior=0.01), ruled=T.same_title_pairs(a, b))
    every = a.select(F.col("unique_id").alias(A.LEFT)).crossJoin(b.select(F.col("unique_id").alias(A.RIGHT)))
    scored = G.FellegiSunterMatcher(model).score(every, fa, fb)
    best = {r[A.LEFT]: r["best_candidate"] for r in H.outcomes(scored).collect()}
    assert best == {f"A_{i}": f"B_{4 - i}" for i in range(5)}
    assert all(0 <= r[0] <= 1 for r in scored.select("match_probability").collect())
    assert all(0.9 < sum(x.values()) < 1.1 for x in model.u.values())


def test_pair_keys_explode_to_the_candidates(spark):
    c = spark.createDataFrame([("A_0", "B_0", "R1"), ("A_0", "B_1", "R1")], A.CANDIDATES)
    assert pairs(G.exploded_keys(c, make(spark, "A", [{}, {}]), make(spark, "B", [{}, {}]))) == {("A_0", "B_0"), ("A_0", "B_1")}


# Decisions


@pytest.mark.parametrize(
    "bits,expected",
    [((8, 2), "accept"), ((8, 7.5), "review_tied"), ((3, -1), "review_unsure"), ((-9, -12), "confidently_different"), ((6, 0), "accept"), ((8, 7), "review_tied"), ((-3.5, -9), "review_unsure"), ((9,), "accept")],
)
def test_outcomes(spark, bits, expected):
    assert outcome(spark, [("A_0", f"B_{i}", x) for i, x in enumerate(bits)]) == {"A_0": expected}


def test_reciprocity(spark):
    s = scores(spark, [("A_0", "B_0", 20), ("A_1", "B_0", 12)])
    assert pairs(H.reciprocal_best(s)) == {("A_0", "B_0")}
    final = {r[0]: r["outcome"] for r in H.reciprocity_veto(H.outcomes(s), H.reciprocal_best(s)).collect()}
    assert final == {"A_0": "accept", "A_1": "review_not_reciprocal"}
    assert pairs(H.reciprocal_best(scores(spark, [("A_0", "B_0", 9), ("A_1", "B_0", 9)]))) == set()


@pytest.mark.parametrize("values,groups", [([10, 9.975, 5], [0, 0, 1]), ([10, 9.96, 9.92, 9.88], [0, 0, 1, 1]), ([10, 9.95], [0, 0]), ([], [])])
def test_tie_groups_compare_with_the_leader(spark, values, groups):
    df = spark.createDataFrame([([float(v) for v in values],)], "v array<double>")
    assert df.select(H.tie_groups(F.col("v"))).first()[0] == groups


def test_review_items(spark):
    a, b = make(spark, "A", [{"title": "x"}] * 2), make(spark, "B", [{"title": f"t{i}"} for i in range(26)])
    s = scores(spark, [("A_0", f"B_{i}", 7.0) for i in range(25)] + [("A_1", "B_0", 3.0)] + [("A_1", f"B_{i}", 1.0) for i in range(1, 26)] + [("A_1", "B_25", -9.0)])
    s = s.dropDuplicates(["unique_id_l", "unique_id_r"])
    items = {r[A.LEFT]: r for r in H.review_items(s, H.outcomes(s), a, b).collect()}
    assert [(x["shown"], x["true_size"], x["truncated"]) for x in items["A_0"]["candidate_blocks"]] == [(25, 25, False)]
    assert [(x["shown"], x["truncated"]) for x in items["A_1"]["candidate_blocks"]] == [(1, False), (10, True)]
    assert not C.answer_fields(H.review_items(s, H.outcomes(s), a, b))
    prompt = L.render_prompt(H.review_items(s, H.outcomes(s), a, b), ["title"]).filter("unique_id_l = 'A_1'").first()["prompt"]
    assert "10 of 2" in prompt and "3.0" not in prompt


def test_quantity_veto_touches_accepted_only(spark):
    q = lambda side, texts: spark.createDataFrame([(f"{side}_{i}", t) for i, t in enumerate(texts)], "unique_id string, t string").select("unique_id", X.quantities(F.col("t")).alias("quantities"))
    d = H.outcomes(scores(spark, [("A_0", "B_0", 9), ("A_1", "B_1", 9), ("A_2", "B_0", 1)]))
    got = {r[0]: r["outcome"] for r in H.quantity_veto(d, q("A", ["512mb", "1tb", "512mb"]), q("B", ["32gb", "1024gb"])).collect()}
    assert got == {"A_0": "review_quantity_conflict", "A_1": "accept", "A_2": "review_unsure"}


# Evaluation


def test_recall_counts_pairs(spark):
    chosen = scores(spark, [("A_0", "B_0", 1)])
    e = I.evaluate_pairs(chosen, scores(spark, [("A_0", "B_0", 1), ("A_0", "B_1", 1)])).first()
    assert (e["tp"], e["fp"], e["fn"], e["recall"]) == (1, 0, 1, 0.5)
    none = I.evaluate_pairs(chosen.limit(0), chosen.limit(0)).first()
    assert none["f1"] == 0.0


def test_top_one_breaks_ties_by_smaller_id(spark):
    s = spark.createDataFrame([("A_0", f"B_{i}", 0.5) for i in (2, 0, 1)] + [("A_1", "B_0", 0.33)], "unique_id_l string, unique_id_r string, similarity double")
    assert pairs(I.top_one(s)) == {("A_0", "B_0")} == pairs(I.top_one(s.orderBy(F.col("unique_id_r").desc())))


def test_acquisition_and_budget(spark):
    s = spark.createDataFrame([("A", f"B{i}", float(b), y) for i, (b, y) in enumerate(zip([9, 1, 8, 2], [0, 1, 0, 1], strict=True))], "unique_id_l string, unique_id_r string, bits double, label int")
    acquired = I.acquisition(s)
    assert [r["label"] for r in acquired.orderBy("cost").collect()] == [0, 0, 1, 1]
    assert [tuple(r) for r in I.budget(acquired, [0, 2, 99]).orderBy("k").collect()] == [(0, 0, False), (2, 4, False), (99, 4, True)]
    assert I.best_threshold(s).first()["threshold"] == 1.0 and I.best_threshold(s.withColumn("label", F.lit(0))).first()["threshold"] == 0.0


def test_bootstrap(spark):
    same = spark.createDataFrame([(i, 1, 0, 0) for i in range(5)], "nth long, tp int, fp int, fn int")
    r = I.percentile_interval(I.bootstrap(same, 50)).first()
    assert (r["low"], r["high"], r["kept"], r["dropped"]) == (100.0, 100.0, 50, 0)
    none = I.percentile_interval(I.bootstrap(same.withColumn("tp", F.lit(0)), 50)).first()
    assert none["kept"] + none["dropped"] == 50 and none["kept"] == 0
    assert not I.paired_difference(I.bootstrap(same, 20), I.bootstrap(same, 20)).first()["significant"]


# Windows and streams


def test_windows(spark):
    s = scores(spark, [("A_2", "B_0", 20), ("A_10", "B_0", 12), ("A_1", "B_1", 9)])
    assert [r[0] for r in K.arrival(s).orderBy("nth").collect()] == ["A_1", "A_10", "A_2"]
    d = H.outcomes(s)
    count = lambda n: H.accepted(K.windowed_reciprocity(s, d, n)).count()
    assert (count(1), count(2), count(3)) == (3, 3, 2)


def test_stream_decides_each_batch(spark, tmp_path):
    scores(spark, [("A_0", "B_0", 20), ("A_1", "B_0", 12)]).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema("unique_id_l string, unique_id_r string, bits double").parquet(f"{tmp_path}/in")
    q = K.stream_decisions(stream, lambda df, n: seen.append((n, [tuple(r) for r in df.collect()])), f"{tmp_path}/checkpoint")
    q.awaitTermination()
    assert [x for _, x in seen] == [[("A_0", "B_0", 20.0)]]


# Judges


def test_replies(spark):
    rows = [('I think {"decision": "match", "id": "B_1", "reasoning": "same size"}.',), ('{"decision": "cannot_tell", "id": "B_1"}',), ("no",), ('{"decision": "yes"}',), ('{"decision": "match"}',), ("{broken}",), (None,)]
    frame = spark.createDataFrame(rows, "reply string")
    got = L.parsed_replies(frame, "reply").collect()
    assert [(r["decision"], r["id"], r["problem"]) for r in got] == [
        ("match", "B_1", None), ("cannot_tell", None, None), (None, None, "no object"), (None, None, "unknown decision"),
        (None, None, "match without id"), (None, None, "unknown decision"), (None, None, "no object"),
    ]
    assert L.usable_replies(frame.limit(2), "reply").columns == ["reply", "decision", "id", "reasoning"]
    with pytest.raises(ValueError, match="no object"):
        L.usable_replies(frame, "reply")
    with pytest.raises(RuntimeError):
        L.require_key("NO_SUCH_KEY")
    assert [L.parse_choice(x, 3) for x in ("2", "4", "n", "u", "?")] == ["2", None, "none_of_these", "cannot_tell", None]


def test_embedding_and_shortlist(spark):
    df = make(spark, "A", [{"title": "abc"}, {"title": "d"}])
    out = {r[0]: r[1] for r in L.embed(df, ["title"], lambda texts: [[float(len(t)), 0.0] for t in texts]).collect()}
    assert out == {"A_0": [1.0, 0.0], "A_1": [1.0, 0.0]}
    v = lambda rows: spark.createDataFrame(rows, "unique_id string, vec array<double>")
    c = spark.createDataFrame([("A_0", f"B_{i}", "R1") for i in range(3)], A.CANDIDATES)
    got = L.shortlist(c, v([("A_0", [1.0, 0.0])]), v([("B_0", [0.0, 1.0]), ("B_1", [1.0, 1.0]), ("B_2", [1.0, 0.0]), ("B_3", [1.0, 0.0])]), 2)
    assert [r[1] for r in got.orderBy("rank").collect()] == ["B_2", "B_1"]


def test_samples_and_sessions(spark):
    items = spark.createDataFrame([(i, "A" if i % 2 else "B", "xyz"[i % 3]) for i in range(60)], "item int, stratum string, bucket string")
    got = L.stratified_sample(items, "item", "stratum", "bucket", 10).groupBy("stratum").count().collect()
    assert {r[1] for r in got} == {10}
    asked = L.with_repeats(items.limit(5), "item", 2)
    assert asked.count() == 7 and asked.filter("repeat_of is not null").count() == 2
    assert L.pending(asked, asked.filter("seq <= 3").select("seq")).count() == 4
    kept = L.truncated(asked.withColumn("stratum", F.lit("A")), "stratum", 2, asked.filter("seq > 4").select("seq"))
    assert kept.count() == 3


def test_ledger_stops_before_the_limit(spark):
    calls = spark.createDataFrame([("r", i, 2.0) for i in range(5)], "run string, seq int, cost double")
    assert [r["made"] for r in L.ledger(calls, ["run"], "seq", "cost", 6.0, 2.0).orderBy("seq").collect()] == [True, True, True, False, False]


def test_one_to_one_variants_and_threshold_churn(spark):
    """B_0 is a tie of A_0 and A_1, B_1 is A_2's alone, B_2 prefers A_3 to A_4."""
    scores = spark.createDataFrame([("A_0", "B_0", 9.0), ("A_1", "B_0", 9.0), ("A_2", "B_1", 8.0), ("A_3", "B_2", 7.0), ("A_4", "B_2", 6.25)], "unique_id_l string, unique_id_r string, bits double")
    truth = spark.createDataFrame([("A_0", "B_0"), ("A_2", "B_1"), ("A_4", "B_2")], "unique_id_l string, unique_id_r string")
    got = {r["variant"]: (r["tp"], r["np"]) for r in I.one_to_one_variants(scores, scores, truth).collect()}
    assert got == {"unconstrained": (3, 5), "symmetric": (2, 4), "unique": (1, 2)}
    moved = {r["move"]: (r["gained"], r["lost"]) for r in I.threshold_churn(H.outcomes(scores), 6.5, 1.0).collect()}
    assert moved == {-0.5: (1, 0), 0.5: (0, 0)}
    assert I.threshold_churn(H.outcomes(scores.limit(0)), 6.0, 1.0).count() == 0


def test_em_params_reads_the_texts(spark, data):
    """u of titles is the share of all pairs by the words of their texts (smoothed), not by their languages."""
    from linkwright.plans.trained import em_params
    from linkwright.sources.views import catalogue

    rows = [(r["side"], frozenset(re.findall("[a-z0-9]+", (r["title"] or "").lower()))) for r in catalogue(spark, data).select("side", "title").collect()]
    pairs = [len(x & y) / len(x | y) for a, x in rows if a == "A" for b, y in rows if b == "B" and x and y]
    got = {r["level"]: r["u"] for r in em_params(spark, data).collect() if r["comparison"] == "title_tokens"}
    spark.catalog.clearCache()
    assert abs(got[0] - sum(j < 0.2 for j in pairs) / len(pairs)) < 0.005 and abs(got[4] - sum(j == 1 for j in pairs) / len(pairs)) < 0.005
