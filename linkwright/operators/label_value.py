"""What labels are worth: the same model with m from k labelled matches, for many k and many draws at once.

Pairs with one pattern of levels have equal bits under every model, so pairs are read once, into counts of patterns; all
models score all patterns as one product of matrices. What reaches the driver are patterns (at most 5,184) by k and draw.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.operators.scoring import MISSING
from linkwright.sources.tables import LEFT, RIGHT

KS, DRAWS, UNTAUGHT = (0, 10, 20, 40, 80, 160, 320, 576), 20, 6.0
#: m of the highest level that no label taught; the others of a comparison share the rest.
DEFAULT_TOP = 0.95
RESULT = "k int, found long, spent long, threshold double, f1 double, draws int, median double, low double, high double"


def best_threshold(bits: np.ndarray, predicted: np.ndarray, matches: np.ndarray) -> float:
    """The rounded value of bits that gives the highest F1 as a threshold (the lowest on ties); 0.0 without a match.

    One entry for each pattern: its bits, pairs and matches.
    """
    best, best_f1 = 0.0, -1.0
    for t in np.unique(np.round(bits[predicted > 0], 2)):
        over = bits >= t
        tp = matches[over].sum()
        if tp and (f1 := 2 * tp / (predicted[over].sum() + matches.sum())) > best_f1:
            best, best_f1 = float(t), f1
    return best


def f1_at(bits: np.ndarray, predicted: np.ndarray, matches: np.ndarray, threshold: float) -> float:
    over = bits >= threshold
    whole = predicted[over].sum() + matches.sum()
    return float(200.0 * matches[over].sum() / whole) if whole else 0.0


def taught_m(levels: np.ndarray, counts: np.ndarray, tops: list[int]) -> list[np.ndarray]:
    """m of each comparison from labelled matches (their patterns and counts); levels that none shows keep their default."""
    out = []
    for i, top in enumerate(tops):
        m = np.full(top + 1, (1 - DEFAULT_TOP) / max(1, top))
        m[top] = DEFAULT_TOP
        known = levels[:, i] != MISSING
        seen = np.bincount(levels[known, i], counts[known], minlength=top + 1)
        if seen.sum():
            m[seen > 0] = (seen / seen.sum())[seen > 0]
        out.append(m)
    return out


def all_bits(levels: np.ndarray, ms: list[list[np.ndarray]], u: list[np.ndarray], prior_bits: float) -> np.ndarray:
    """Bits of every pattern (rows) under every model (columns): a row for each pattern of which levels it shows, times a column of weights for each model."""
    width = np.cumsum([0, *[len(x) for x in u]])
    shows = np.zeros((len(levels), width[-1]))
    for i in range(len(u)):
        known = np.flatnonzero(levels[:, i] != MISSING)
        shows[known, width[i] + levels[known, i]] = 1.0
    weights = np.stack([np.concatenate([np.log2(m / x) for m, x in zip(model, u, strict=True)]) for model in ms], axis=1)
    return prior_bits + shows @ weights


def drawn(matches: DataFrame, draws: int, most: int, seed: int) -> DataFrame:
    """(draw, nth, columns of matches): for each draw the first ``most`` matches in an order that a hash gives. Each task keeps its own first ``most`` of a draw before any move."""
    order = F.md5(F.concat_ws("#", F.lit(str(seed)), "draw", LEFT, RIGHT))
    rows = matches.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__o", order)
    nth = F.row_number().over(Window.partitionBy("draw").orderBy("__o", LEFT, RIGHT))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most).drop("__o")


def sweep(train: DataFrame, test: DataFrame, names: list[str], u: list[list[float]], prior_bits: float, ks: tuple[int, ...] = KS, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """k, found, spent, threshold, f1 (percent) with the first k matches that a reader of train finds, best-scored first; and draws,
    median, low and high (2.5 and 97.5 percent) of F1 over random draws of k matches.

    train: ids, levels (names), label, bits of the label-free model, by which the reader goes (ties by ids). test: levels and
    label. A threshold comes from the pairs that were read, and from nothing else; none was read for k = 0, where it is 6.0 and
    all m are defaults. Where there are fewer than k matches, the reader reads all of train, and there are no draws.
    """
    label = F.col("label") == 1
    stops = stops_of(train.filter(label), ks)

    def read(k: int):
        if k == 0:
            return F.lit(False)
        if (stop := stops[k]) is None:
            return F.lit(True)
        tie = (F.col(LEFT) < stop[LEFT]) | ((F.col(LEFT) == stop[LEFT]) & (F.col(RIGHT) <= stop[RIGHT]))
        return (F.col("bits") > stop["bits"]) | ((F.col("bits") == stop["bits"]) & tie)

    seen = train.groupBy(*names, label.alias("y")).agg(F.count("*").alias("n"), *[F.count_if(read(k)).alias(f"k{k}") for k in stops]).collect()
    tested = test.groupBy(*names, label.alias("y")).agg(F.count("*").alias("n")).collect()
    return swept(train.filter(label), seen, tested, names, u, prior_bits, ks, draws, seed)


def stops_of(matches: DataFrame, ks: tuple[int, ...] = KS) -> dict:
    """By k: bits and ids of the k-th match in the reader's order, None where there are fewer; as many rows as the largest k."""
    places = matches.orderBy(F.col("bits").desc(), LEFT, RIGHT).select("bits", LEFT, RIGHT).limit(max(ks)).collect()
    return {k: places[k - 1] if 0 < k <= len(places) else None for k in sorted(ks)}


def swept(matches: DataFrame, seen: list, tested: list, names: list[str], u: list[list[float]], prior_bits: float, ks: tuple[int, ...] = KS, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """sweep() from the matches of train and counts by pattern and label (y): of train (n, and k<k>, which are read for k), and of test (n)."""
    ks = tuple(sorted(ks))
    tops = [len(x) - 1 for x in u]
    total = sum(r["n"] for r in seen if r["y"])
    nth = [k for k in ks if 0 < k < total]
    taken = drawn(matches, draws, max(nth), seed).groupBy("draw", *names).agg(*[F.count_if(F.col("nth") <= k).alias(f"k{k}") for k in nth]).collect() if nth else []

    patterns = sorted({tuple(r[g] for g in names) for r in [*seen, *tested, *taken]})
    at = {p: i for i, p in enumerate(patterns)}
    levels = np.array(patterns, np.int64).reshape(-1, len(names))

    def counts(rows, column: str, when=lambda r: True) -> np.ndarray:
        out = np.zeros(len(patterns))
        for r in rows:
            if when(r):
                out[at[tuple(r[g] for g in names)]] += r[column]
        return out

    yes = lambda r: r["y"]
    inspected = {k: (counts(seen, f"k{k}"), counts(seen, f"k{k}", yes)) for k in ks}
    by_draw = {(k, d): counts(taken, f"k{k}", lambda r, d=d: r["draw"] == d) for k in nth for d in range(draws)}
    models = [taught_m(levels, inspected[k][1], tops) for k in ks] + [taught_m(levels, x, tops) for x in by_draw.values()]
    bits = all_bits(levels, models, [np.array(x) for x in u], prior_bits)
    of_test = counts(tested, "n"), counts(tested, "n", yes)

    rows = []
    for j, k in enumerate(ks):
        n, m = inspected[k]
        threshold = best_threshold(bits[:, j], n, m) if m.sum() else UNTAUGHT
        scores = []
        for c, ((kk, _), x) in enumerate(by_draw.items(), len(ks)):
            if kk == k:
                scores.append(f1_at(bits[:, c], *of_test, best_threshold(bits[:, c], x, x)))
        low, middle, high = (np.percentile(scores, q) if scores else None for q in (2.5, 50, 97.5))
        whole = lambda x: None if x is None else round(float(x), 6)
        rows.append((k, int(m.sum()), int(n.sum()), threshold, round(f1_at(bits[:, j], *of_test, threshold), 6), len(scores), whole(middle), whole(low), whole(high)))
    return matches.sparkSession.createDataFrame(rows, RESULT)
