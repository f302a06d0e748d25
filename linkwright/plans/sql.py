"""Pieces of the SQL that the linkage queries match."""

from __future__ import annotations

from linkwright.sources.views import CATALOGUE_SQL, PRODUCTS_SQL

RECORD = "lower(concat_ws(' ', title, category, brand, modelno, price))"
SHORT_RECORD = "lower(title)"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def token_set(x: str) -> str:
    return f"list_distinct({tokens(x)})"


def segments(x: str) -> str:
    digit_left = "'([0-9])[^a-z0-9]+([a-z0-9])'"
    out = f"lower({x})"
    for pattern in (digit_left, digit_left, "'([a-z])[^a-z0-9]+([0-9])'", digit_left, digit_left):
        out = f"regexp_replace({out}, {pattern}, '\\1\\2', 'g')"
    return f"regexp_extract_all({out}, '[a-z0-9]+')"


def ngrams(x: str, n: int) -> str:
    return f"list_distinct(flatten(list_transform(list_filter({segments(x)}, lambda s: length(s) >= {n}), lambda s: list_transform(range(1, length(s) - {n} + 2), lambda i: substr(s, i, {n})))))"


def joined(x: str) -> str:
    """A list as one sorted text."""
    return f"array_to_string(list_sort({x}), ' ')"


def jaccard(a: str, b: str) -> str:
    n = f"len(list_intersect({a}, {b}))"
    return f"(CAST({n} AS DOUBLE) / nullif(len({a}) + len({b}) - {n}, 0))"


def price(x: str) -> str:
    number = "'^\\s*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$'"
    return f"(CASE WHEN regexp_matches({x}, {number}) AND try_cast({x} AS DOUBLE) > 0 THEN try_cast({x} AS DOUBLE) END)"


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


CAT, PROD = CATALOGUE_SQL, PRODUCTS_SQL
#: Postings of the catalogue and of the products (title), and n-gram postings.
TOK = f"tok AS (SELECT side, unique_id, unnest({token_set(RECORD)}) AS item FROM cat)"
GRAM = f"gram AS (SELECT side, unique_id, unnest({ngrams(RECORD, 5)}) AS item FROM cat)"
PTOK = f"tok AS (SELECT side, unique_id, unnest({token_set(SHORT_RECORD)}) AS item FROM prod)"


def pairs_sharing(index: str, cutoff: int | None, where: str = "TRUE") -> str:
    rare = f" AND a.item IN (SELECT item FROM {index} WHERE side = 'B' GROUP BY item HAVING count(*) <= {cutoff})" if cutoff else ""
    return f"SELECT DISTINCT a.unique_id AS unique_id_l, b.unique_id AS unique_id_r FROM {index} a JOIN {index} b ON a.item = b.item WHERE a.side = 'A' AND b.side = 'B' AND {where.replace('@', 'a.item')}{rare}"


IDENTIFIER = "length(@) >= 5 AND regexp_matches(@, '[a-z]') AND regexp_matches(@, '[0-9]')"
VOCABULARY = f"vocab AS (SELECT DISTINCT lower(brand) AS brand FROM cat WHERE len({token_set('brand')}) = 1)"
HARVEST = f"harvest AS (SELECT side, unique_id, lower(brand) AS item FROM cat WHERE len({token_set('brand')}) = 1 UNION SELECT side, unique_id, item FROM tok WHERE item IN (SELECT brand FROM vocab))"
BRAND_PAIRS = f"""bp AS (SELECT DISTINCT a.unique_id AS l, b.unique_id AS r FROM harvest a JOIN harvest b ON a.item = b.item WHERE a.side = 'A' AND b.side = 'B'),
 own AS (SELECT unique_id, list(DISTINCT item) AS brands FROM harvest WHERE side = 'A' GROUP BY unique_id),
 words AS (SELECT unique_id, {token_set(RECORD)} AS t FROM cat)"""
BRAND_RULE = "SELECT l AS unique_id_l, r AS unique_id_r FROM bp JOIN own ON own.unique_id = l JOIN words a ON a.unique_id = l JOIN words b ON b.unique_id = r WHERE len(list_filter(list_intersect(a.t, b.t), lambda x: NOT list_contains(brands, x))) >= 2"


def grams_of(n: int) -> str:
    return f"g{n} AS (SELECT side, unique_id, {ngrams(SHORT_RECORD, n)} AS grams FROM prod)"


def nearest(name: str, query: str, target: str, n: int, k: int = 100) -> str:
    """query and target select unique_id; both sides take their n-grams from g<n>."""
    return f"""{name} AS (SELECT q, t FROM (SELECT q, t, row_number() OVER (PARTITION BY q ORDER BY CAST(c AS DOUBLE) / (nq + nt - c) DESC, t DESC) AS place FROM (
 SELECT q, t, count(*) AS c, any_value(nq) AS nq, any_value(nt) AS nt FROM (SELECT unique_id AS q, len(grams) AS nq, unnest(grams) AS x FROM g{n} WHERE unique_id IN ({query})) JOIN
 (SELECT unique_id AS t, len(grams) AS nt, unnest(grams) AS x FROM g{n} WHERE unique_id IN ({target})) USING (x) GROUP BY q, t)) WHERE place <= {k})"""


# Rescue rules over the products: no earlier rule reaches a record, so that all of the left side is stranded.
PA, PB = "SELECT unique_id FROM prod WHERE side = 'A'", "SELECT unique_id FROM prod WHERE side = 'B'"
FIRST = f"first AS ({pairs_sharing('tok', 100)} UNION SELECT l, r FROM (SELECT a.unique_id AS l, b.unique_id AS r FROM (SELECT side, unique_id, unnest(grams) AS item FROM g5) a JOIN (SELECT side, unique_id, unnest(grams) AS item FROM g5) b ON a.item = b.item WHERE a.side = 'A' AND b.side = 'B' AND a.item IN (SELECT item FROM (SELECT unnest(grams) AS item FROM g5 WHERE side = 'B') GROUP BY item HAVING count(*) <= 50)))"
R4 = nearest("r4", f"{PA} AND unique_id NOT IN (SELECT unique_id_l FROM first)", PB, 5)
R4S = nearest("r4s", f"{PB} AND unique_id NOT IN (SELECT unique_id_r FROM first UNION SELECT t FROM r4)", PA, 5)
LEFT_OVER = f"{PB} AND unique_id NOT IN (SELECT unique_id_r FROM first UNION SELECT t FROM r4 UNION SELECT q FROM r4s)"
S4 = nearest("s4", LEFT_OVER, PA, 4)
S3 = nearest("s3", f"{LEFT_OVER} AND unique_id NOT IN (SELECT q FROM s4)", PA, 3)
RESCUE = (PROD, PTOK, grams_of(5), FIRST, R4, R4S, grams_of(4), S4, grams_of(3), S3)

# Scored pairs: products of one brand, with weights that doubles hold exactly, so that ties are ties.
TITLE_WEIGHTS, CATEGORY_WEIGHTS, PRICE_WEIGHTS, PRIOR_BITS = {4: 6.5, 3: 4.25, 2: 2.5, 1: 0.75, 0: -2.0}, {1: 1.5, 0: -1.25}, {4: 5.0, 3: 2.5, 2: 1.25, 1: 0.5, 0: -0.75}, -1.0
LEVELS = f"""lev AS (SELECT l, r, lt, rt, CASE WHEN list_sort(lt) = list_sort(rt) THEN 4 WHEN j >= 0.6 THEN 3 WHEN j >= 0.35 THEN 2 WHEN j >= 0.2 THEN 1 ELSE 0 END AS gt, CASE WHEN lc = rc THEN 1 ELSE 0 END AS gc,
 CASE WHEN lp = rp THEN 4 WHEN abs(lp - rp) / greatest(lp, rp) <= 0.02 THEN 3 WHEN abs(lp - rp) / greatest(lp, rp) <= 0.1 THEN 2 WHEN abs(lp - rp) / greatest(lp, rp) <= 0.2 THEN 1 ELSE 0 END AS gp FROM
 (SELECT *, {jaccard('lt', 'rt')} AS j FROM (SELECT a.unique_id AS l, b.unique_id AS r, {token_set('a.title')} AS lt, {token_set('b.title')} AS rt, a.category AS lc, b.category AS rc, CAST(a.price AS DOUBLE) AS lp, CAST(b.price AS DOUBLE) AS rp FROM prod a JOIN prod b ON a.brand = b.brand WHERE a.side = 'A' AND b.side = 'B')))"""


def case(column: str, weights: dict[int, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN CAST({v} AS DOUBLE)" for k, v in weights.items()) + " END"


SCORED = f"sc AS (SELECT l AS unique_id_l, r AS unique_id_r, CAST({PRIOR_BITS} AS DOUBLE) + {case('gt', TITLE_WEIGHTS)} + {case('gc', CATEGORY_WEIGHTS)} + {case('gp', PRICE_WEIGHTS)} AS bits FROM lev)"
OUTCOMES = """outc AS (SELECT unique_id_l, unique_id_r AS best_candidate, bits AS best_bits, coalesce(bits - nxt, CAST('inf' AS DOUBLE)) AS margin_bits,
 CASE WHEN bits >= 6 AND coalesce(bits - nxt, CAST('inf' AS DOUBLE)) > 1 THEN 'accept' WHEN bits >= 6 THEN 'review_tied' WHEN bits >= -3.5 THEN 'review_unsure' ELSE 'confidently_different' END AS outcome FROM
 (SELECT *, row_number() OVER w AS n, lead(bits) OVER w AS nxt FROM sc WINDOW w AS (PARTITION BY unique_id_l ORDER BY bits DESC, unique_id_r)) WHERE n = 1)"""
MUTUAL = """mut AS (SELECT unique_id_l, unique_id_r FROM (SELECT *, row_number() OVER (PARTITION BY unique_id_l ORDER BY bits DESC, unique_id_r) AS n, max(bits) OVER (PARTITION BY unique_id_r) AS top FROM sc)
 WHERE n = 1 AND bits = top AND unique_id_r IN (SELECT unique_id_r FROM (SELECT unique_id_r, bits, max(bits) OVER (PARTITION BY unique_id_r) AS top FROM sc) WHERE bits = top GROUP BY unique_id_r HAVING count(*) = 1))"""
FINAL = "fin AS (SELECT outc.* EXCLUDE (outcome), CASE WHEN outcome = 'accept' AND mut.unique_id_l IS NULL THEN 'review_not_reciprocal' ELSE outcome END AS outcome FROM outc LEFT JOIN mut ON outc.unique_id_l = mut.unique_id_l)"
TRUTH = "tru AS (SELECT a.unique_id AS unique_id_l, b.unique_id AS unique_id_r FROM prod a JOIN prod b ON a.title = b.title AND a.category = b.category AND a.brand = b.brand WHERE a.side = 'A' AND b.side = 'B')"
LABELLED = "lab AS (SELECT sc.*, CASE WHEN tru.unique_id_l IS NULL THEN 0 ELSE 1 END AS label FROM sc LEFT JOIN tru USING (unique_id_l, unique_id_r))"
SCORING = (PROD, LEVELS, SCORED)
DECIDING = (*SCORING, OUTCOMES, MUTUAL, FINAL)


def rates(tp: str, predicted: str, actual: str) -> str:
    p = f"(CASE WHEN {predicted} > 0 THEN CAST({tp} AS DOUBLE) / {predicted} ELSE 0.0 END)"
    r = f"(CASE WHEN {actual} > 0 THEN CAST({tp} AS DOUBLE) / {actual} ELSE 0.0 END)"
    return f"round({p}, 9) AS precision, round({r}, 9) AS recall, round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END, 9) AS f1"
