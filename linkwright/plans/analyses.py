"""Analyses of linkage on real candidates: losses, risk, prior, absences; rates by stratum; ties that chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkwright.functions import sets as S
from linkwright.functions import text as X
from linkwright.operators import analyses as N
from linkwright.operators import classes as E
from linkwright.operators import decide as H
from linkwright.operators import evaluate as I
from linkwright.operators import features as D
from linkwright.operators import scoring as G
from linkwright.operators.blocking import ClassicalBlocker
from linkwright.plans import queries as base
from linkwright.plans import sql as Q
from linkwright.plans import trained
from linkwright.plans.registry import query
from linkwright.sources.shared import kept
from linkwright.sources.tables import ATTRIBUTES, ID, LEFT, RIGHT
from linkwright.sources.views import catalogue, sides

_DECIDED = f"{trained._SC6}, {Q.OUTCOMES}"
_FIRST_TRUE = "ft1 AS (SELECT unique_id_l, min(rank) AS rank FROM (SELECT unique_id_l, unique_id_r, row_number() OVER (PARTITION BY unique_id_l ORDER BY bits DESC, unique_id_r) - 1 AS rank FROM sc) k JOIN cat a ON a.unique_id = unique_id_l JOIN cat b ON b.unique_id = unique_id_r WHERE a.title = b.title GROUP BY unique_id_l)"


def _keys(spark, sf):
    """Documents of both sides with the digest of their whole text: equal texts are true matches."""
    return sides(catalogue(spark, sf).select(ID, "side", F.sha2("title", 256).alias("key")))


@query(
    f"{_DECIDED}, {Q.MUTUAL}, {Q.FINAL}, {_FIRST_TRUE}, st AS (SELECT CASE WHEN rank IS NULL THEN 'not_a_candidate' WHEN rank > 0 THEN 'outranked' WHEN outcome = 'accept' THEN 'found' ELSE outcome END AS stage, rank FROM (SELECT unique_id AS unique_id_l FROM cat WHERE side = 'A' AND title IN (SELECT title FROM cat WHERE side = 'B')) h LEFT JOIN ft1 USING (unique_id_l) LEFT JOIN fin USING (unique_id_l))"
    " SELECT stage, n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 9) AS share, worst_rank FROM (SELECT stage, count(*) AS n, max(rank) AS worst_rank FROM st GROUP BY stage)"
)
def loss_stages(spark, sf):
    """Documents that have an exact copy on the other side, by what becomes of it."""
    scores = kept(trained._candidate_scores(spark, sf))
    decided = H.reciprocity_veto(H.outcomes(scores), H.reciprocal_best(scores))
    return N.loss_stages(scores, decided, *_keys(spark, sf))


@query(f"{_DECIDED}, {_FIRST_TRUE}, ta AS (SELECT best_bits, count(*) AS n, count(*) FILTER (rank IS NULL OR rank > 0) AS w FROM outc LEFT JOIN ft1 USING (unique_id_l) GROUP BY best_bits), ri AS (SELECT n, w, CAST(sum(w) OVER d AS DOUBLE) / sum(n) OVER d AS risk FROM ta WINDOW d AS (ORDER BY best_bits DESC)) SELECT CAST(sum(n) AS BIGINT) AS records, CAST(sum(w) AS BIGINT) AS wrong, round(sum(n * risk) / sum(n), 9) AS aurc FROM ri")
def risk_area(spark, sf):
    """The area under the risk-coverage curve of documents' best candidates."""
    scores = kept(trained._candidate_scores(spark, sf))
    return N.risk_area(H.outcomes(scores), N.first_true(scores, *_keys(spark, sf)))


PRIORS = (1e-5, 2e-5, 4e-5, trained.PRIOR)


@query(f"{_DECIDED}, mv AS (SELECT p AS prior, best_bits + log2(p / (1 - p)) - CAST({trained.PRIOR_BITS} AS DOUBLE) AS bits, margin_bits FROM outc, (SELECT unnest([{', '.join(f'CAST({p!r} AS DOUBLE)' for p in PRIORS)}]) AS p)) SELECT prior, CASE WHEN bits >= 6 AND margin_bits > 1 THEN 'accept' WHEN bits >= 6 THEN 'review_tied' WHEN bits >= -3.5 THEN 'review_unsure' ELSE 'confidently_different' END AS outcome, count(*) AS n FROM mv GROUP BY ALL")
def prior_outcomes(spark, sf):
    """Outcomes of documents under four priors; under the last one they are as scored."""
    # Pairs become counts by record and value where they are scored: no pair is stored or shuffled.
    values = trained._candidate_scores(spark, sf).select(LEFT, "bits", F.lit(1).alias("n"), F.col(RIGHT).alias("best"))
    top = E.highest(values, LEFT).withColumn("next", F.when(F.col("n") > 1, F.col("bits")).otherwise(F.col("next")))
    return N.prior_outcomes(H.decided(top.withColumnRenamed("best", RIGHT)), trained.PRIOR_BITS, PRIORS)


def _absent(c: str) -> str:
    l, r = f"a.{c} IS NULL", f"b.{c} IS NULL"
    both = f"NOT ({l}) AND NOT ({r})"
    cases = {"agree": f"{both} AND gamma_{c} > 0", "disagree": f"{both} AND gamma_{c} = 0", "left_absent": f"({l}) AND NOT ({r})", "right_absent": f"NOT ({l}) AND ({r})", "both_absent": f"({l}) AND ({r})"}
    return f"SELECT '{c}' AS comparison, " + ", ".join(f"count(*) FILTER ({x}) AS {k}" for k, x in cases.items()) + " FROM lev6 JOIN ft a ON a.unique_id = unique_id_l JOIN ft b ON b.unique_id = unique_id_r"


@query(f"{trained._SIX} " + " UNION ALL ".join(_absent(c) for c in G.COMPARISONS))
def absences(spark, sf):
    """How often documents' candidates agree, disagree, or state nothing, by comparison."""
    a, b = sides(catalogue(spark, sf))
    return N.absences(ClassicalBlocker(base.DOCUMENTS).compared_candidates(a, b, *(kept(d) for d in D.features_of(a, b))))


@query(
    Q.with_(*Q.DECIDING, Q.TRUTH, base._BB, base._SIM, base._BASE)
    + "SELECT outcome AS stratum, count(*) AS answers, count(*) FILTER (has) AS with_partner, count(c) AS matched, round(CASE WHEN count(*) FILTER (has) > 0 THEN CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) FILTER (has) ELSE 0.0 END, 9) AS recall, round(CASE WHEN count(c) > 0 THEN CAST(count(c) - count(*) FILTER (hit) AS DOUBLE) / count(c) ELSE 0.0 END, 9) AS false_match FROM (SELECT outcome, base.unique_id_r AS c, t.unique_id_r IS NOT NULL AS hit, fin.unique_id_l IN (SELECT unique_id_l FROM tru) AS has FROM fin LEFT JOIN base ON base.unique_id_l = fin.unique_id_l LEFT JOIN tru t ON t.unique_id_l = base.unique_id_l AND t.unique_id_r = base.unique_id_r) GROUP BY outcome"
)
def rates_by_stratum(spark, sf):
    """What the baseline answers for products, by the outcome that the model gives them."""
    answers = base._baseline(spark, sf).select(LEFT, F.col(RIGHT).alias("choice"))
    strata = base._final(spark, sf).select(LEFT, F.col("outcome").alias("stratum"))
    return N.rates_by_stratum(strata.join(answers, LEFT, "left"), base._truth(spark, sf))


_WIDTH = 0.02


@query(
    "WITH RECURSIVE e AS MATERIALIZED (SELECT l AS unique_id_l, rank, cosine FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY cosine DESC, r) - 1 AS rank FROM (SELECT 'A_' || a.vec_id AS l, 'B_' || b.vec_id AS r, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 7 = 0 AND b.vec_id % 7 <> 0)) WHERE rank < 30),"
    " g AS (SELECT unique_id_l, rank, cosine AS leader, 0 AS place FROM e WHERE rank = 0 UNION ALL SELECT e.unique_id_l, e.rank, CASE WHEN leader - cosine > @ THEN cosine ELSE leader END, CASE WHEN leader - cosine > @ THEN place + 1 ELSE place END FROM g JOIN e ON e.unique_id_l = g.unique_id_l AND e.rank = g.rank + 1)"
    " SELECT unique_id_l, CAST(place AS INTEGER) AS \"group\", count(*) AS n, round(max(leader), 9) AS leader FROM g GROUP BY unique_id_l, place".replace("@", f"{_WIDTH} + 1e-9")
)
def tie_groups_chained(spark, sf):
    """Tie groups of shortlisted vectors: near values chain, but a group ends where its first value is left behind."""
    scores = base.shortlist_topk(spark, sf).select(LEFT, RIGHT, F.col("cosine").alias("bits"))
    rows = H.grouped_candidates(scores, -2.0, _WIDTH)
    return rows.groupBy(LEFT, "group").agg(F.count("*").alias("n"), F.max("bits").alias("leader"))


@query(Q.with_(Q.PROD, base._STATED, trained._STATED_TITLE, f"qs AS (SELECT unique_id, {trained._said('title')} FROM sp)") + "SELECT unique_id, " + ", ".join(f"array_to_string({k}, ' ') AS {k}" for k in base._FAMILIES) + " FROM qs")
def record_quantities(spark, sf):
    """Quantities that products state in any attribute."""
    rows = trained._stated_products(spark, sf)
    said = rows.select(ID, X.quantities(X.record_text([c for c in ATTRIBUTES if c in rows.columns])).alias("q"))
    return said.select(ID, *[F.coalesce(F.array_join(F.transform(F.col("q")[k], lambda v: v.cast("long").cast("string")), " "), F.lit("")).alias(k) for k in base._FAMILIES])


@query(Q.with_(base._QUALITY) + f"SELECT doc_id, round(log2(p / (1 - p)), 6) AS bits FROM (SELECT doc_id, greatest({S.EPSILON!r}, least(1 - {S.EPSILON!r}, score)) AS p FROM ql)")
def clipped_bits(spark, sf):
    """Scores of labelled documents as bits; scores of 0 and 1 are kept off both ends."""
    return base._quality(spark, sf).select("doc_id", F.round(S.match_bits(F.col("score")), 6).alias("bits"))
