"""Fellegi-Sunter scoring: comparison levels, pattern counts, m from labels, match weights."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial, reduce
from math import ceil, log2
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions import sets as S
from linkwright.sources.shared import kept
from linkwright.sources.tables import ID, LEFT, RIGHT

#: Characters of features of each side, and pairs, that one cell of pair_counts() has; few pairs are dealt into up to so many smaller cells.
CELL_CHARS, CELL_PAIRS, CELLS = 48_000_000, 2_000_000, 64
#: Level of missing evidence; it weighs nothing.
MISSING = -1
TITLE, PRICE = (0.6, 0.35, 0.2), (0.02, 0.10, 0.20)


class Matcher(Protocol):
    def score(self, candidates: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame: ...


def title_level_of(j: Column) -> Column:
    """4 for the same set, 3, 2, 1 by Jaccard, 0 else."""
    level = F.when(j == 1, 4)
    for k, t in zip((3, 2, 1), TITLE, strict=True):
        level = level.when(j >= t, k)
    return level.otherwise(0)


def title_level(a: Column, b: Column) -> Column:
    """The level of the Jaccard of two arrays that hold nothing twice."""
    # Two empty sets have no Jaccard, but they are the same.
    j = F.coalesce(S.jaccard_of_sets(a, b), F.lit(1.0))
    return F.when(a.isNull() | b.isNull(), MISSING).otherwise(S.once(j, title_level_of))


def overlap_level_of(n: Column, sizes: tuple[int, ...]) -> Column:
    """len(sizes) for at least sizes[0] shared members, and so on down to 0."""
    level = F.when(n >= sizes[0], len(sizes))
    for k, size in enumerate(sizes[1:], 1):
        level = level.when(n >= size, len(sizes) - k)
    return level.otherwise(0)


def overlap_level(a: Column, b: Column, sizes: tuple[int, ...]) -> Column:
    return F.when(a.isNull() | b.isNull(), MISSING).otherwise(S.once(S.shared(a, b), lambda n: overlap_level_of(n, sizes)))


def price_level(a: Column, b: Column) -> Column:
    """4 equal, 3, 2, 1 by relative difference, 0 else."""
    gap = S.price_gap(a, b)
    level = F.when(a.isNull() | b.isNull(), MISSING).when(a == b, 4)
    for k, t in zip((3, 2, 1), PRICE, strict=True):
        level = level.when(gap <= t, k)
    return level.otherwise(0)


#: Numbers of shared members that make a level of an array comparison, the highest level first.
ARRAYS = {"rare_identifier_tokens": (1,), "common_identifier_tokens": (1,), "brand_terms": (2, 1), "rare_tokens": (2, 1)}
#: Name, highest level, and level expression from the columns l and r of a feature.
COMPARISONS = {
    "title_tokens": (4, title_level),
    **{c: (len(sizes), partial(overlap_level, sizes=sizes)) for c, sizes in ARRAYS.items()},
    "price_value": (4, price_level),
}
GAMMAS = [f"gamma_{k}" for k in COMPARISONS]


@dataclass
class Model:
    """Probabilities of each level among matches and others, by comparison; the prior odds' probability."""

    prior: float = 2.0e-05
    m: dict[str, dict[int, float]] = field(default_factory=dict)
    u: dict[str, dict[int, float]] = field(default_factory=dict)
    max_rounds: int = 25
    tolerance: float = 1e-4

    def weight(self, name: str, level: int) -> float:
        return log2(self.m[name][level] / self.u[name][level])

    def rows(self, spark) -> DataFrame:
        rows = [(c, k, self.m.get(c, {}).get(k), self.u.get(c, {}).get(k)) for c, (top, _) in COMPARISONS.items() for k in range(top + 1)]
        return spark.createDataFrame(rows, "comparison string, level int, m double, u double")


def pair_features(candidates: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidates with the features of both records, as l_* and r_*."""
    left = a.select(F.col(ID).alias(LEFT), *[F.col(c).alias(f"l_{c}") for c in COMPARISONS])
    right = b.select(F.col(ID).alias(RIGHT), *[F.col(c).alias(f"r_{c}") for c in COMPARISONS])
    return candidates.select(LEFT, RIGHT).join(left, LEFT).join(right, RIGHT)


def gammas(pairs: DataFrame) -> DataFrame:
    return pairs.select(LEFT, RIGHT, *[level(F.col(f"l_{c}"), F.col(f"r_{c}")).alias(f"gamma_{c}") for c, (_, level) in COMPARISONS.items()])


def _shared_counts(left: np.ndarray, right: np.ndarray, lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of places in lists that hold nothing twice: members in common; and the size of each list, nulls as -1."""
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy().astype(np.int64)
    lengths = np.maximum(sizes, 0)
    starts = np.cumsum(lengths) - lengths
    words = lists.combine_chunks().flatten() if len(lists) else pa.array([], pa.string())
    codes = words.dictionary_encode()
    flags, codes = np.zeros(len(codes.dictionary) + 1, bool), codes.indices.to_numpy(zero_copy_only=False)
    shared = np.zeros(len(left), np.int64)
    order = np.argsort(left, kind="stable")
    bounds = np.flatnonzero(np.diff(left[order], prepend=-1))
    for i, j in zip(bounds, [*bounds[1:], len(order)][: len(bounds)], strict=True):  # a cell may have records and no pairs
        one, rows = left[order[i]], order[i:j]
        mine = codes[starts[one] : starts[one] + lengths[one]]
        rows = rows[lengths[right[rows]] > 0]
        if not len(mine) or not len(rows):
            continue
        flags[mine] = True
        n, at = lengths[right[rows]], starts[right[rows]]
        ends = np.cumsum(n)
        hits = np.cumsum(flags[codes[np.repeat(at - (ends - n), n) + np.arange(ends[-1])]])
        shared[rows] = np.diff(hits[ends - 1], prepend=0)
        flags[mine] = False
    return shared, sizes


def pair_counts(candidates: DataFrame, a: DataFrame, b: DataFrame, arrays: list[str] | None = None, plain: list[str] | None = None) -> DataFrame:
    """Candidates with what comparisons need of both records: sizes (l_*, r_*, null without evidence) and shared members (n_*) of arrays; plain columns of both. Unless they are named, these are the arrays and the price of COMPARISONS.

    The features of a record are far larger than a pair. They don't travel with each pair: records of each side are dealt into
    blocks, a cell is a block of either side, and a record goes once into each cell of its block.
    """
    arrays = arrays or [c for c in COMPARISONS if c != "price_value"]
    plain = ["price_value"] if plain is None else plain
    pairs = kept(candidates.select(LEFT, RIGHT))
    size = lambda d: d.agg(F.coalesce(F.sum(sum((F.coalesce(F.length(F.array_join(c, " ")), F.lit(0)) for c in arrays), F.lit(64))), F.lit(0))).first()[0]
    across = max(1, ceil(size(b) / CELL_CHARS))
    n = pairs.count()
    down = max(1, ceil(size(a) / CELL_CHARS), ceil(max(n / CELL_PAIRS, min(8 * n / CELL_PAIRS, CELLS)) / across))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    record = [F.col(ID).alias("id"), *[F.col(c) for c in [*arrays, *plain]]]
    left = a.select(block(ID, down).alias("row"), every(across).alias("column"), F.lit(True).alias("is_left"), *record)
    right = b.select(every(down).alias("row"), block(ID, across).alias("column"), F.lit(False).alias("is_left"), *record)
    dealt = pairs.select(block(LEFT, down).alias("row"), block(RIGHT, across).alias("column"), LEFT, RIGHT)
    kinds = dict(a.dtypes)
    out = [f"{LEFT} {dict(pairs.dtypes)[LEFT]}", f"{RIGHT} {dict(pairs.dtypes)[RIGHT]}", *[f"{k}_{c} int" for c in arrays for k in "lrn"], *[f"{k}_{c} {kinds[c]}" for c in plain for k in "lr"]]

    def compare(cell: pa.Table, records: pa.Table) -> pa.Table:
        is_left = records["is_left"].to_numpy()
        places = [pa.array(np.flatnonzero(x)) for x in (is_left, ~is_left)]
        found = [pc.index_in(cell[c], records["id"].take(p)) for c, p in ((LEFT, places[0]), (RIGHT, places[1]))]
        # As in a join, a pair with an unknown record is none.
        known = pc.and_(pc.is_valid(found[0]), pc.is_valid(found[1]))
        cell = cell.filter(known)
        l, r = (p.to_numpy()[np.asarray(x.filter(known).to_numpy(), np.int64)] for p, x in zip(places, found, strict=True))
        columns = [cell[LEFT], cell[RIGHT]]
        for c in arrays:
            shared, sizes = _shared_counts(l, r, records[c])
            columns += [pa.array(x, pa.int32(), mask=m) for x, m in ((sizes[l], sizes[l] < 0), (sizes[r], sizes[r] < 0), (shared, (sizes[l] < 0) | (sizes[r] < 0)))]
        columns += [records[c].take(pa.array(x)) for c in plain for x in (l, r)]
        return pa.table(columns, names=[x.split(" ")[0] for x in out])

    keys = ["row", "column"]
    return dealt.groupBy(*keys).cogroup(left.unionByName(right).groupBy(*keys)).applyInArrow(compare, ", ".join(out))


def shared_members(pairs: DataFrame, a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(left, right, n) of pairs: members that both records have in an array that holds nothing twice."""
    return pair_counts(pairs, a, b, [column], []).select(LEFT, RIGHT, F.col(f"n_{column}").alias("n"))


def counted_level(c: str) -> Column:
    """The level of a comparison from the columns of pair_counts()."""
    l, r, n = (F.col(f"{k}_{c}") for k in "lrn")
    if c == "price_value":
        return price_level(l, r)
    if c == "title_tokens":
        return F.when(n.isNull(), MISSING).otherwise(S.once(F.coalesce(n.cast("double") / F.nullif(l + r - n, F.lit(0)), F.lit(1.0)), title_level_of))
    return F.when(n.isNull(), MISSING).otherwise(overlap_level_of(n, ARRAYS[c]))


def pair_levels(candidates: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """gammas() of candidates, by pair_counts()."""
    return counted_levels(pair_counts(candidates, a, b))


def counted_levels(counts: DataFrame) -> DataFrame:
    """gammas() from what pair_counts() gives."""
    return counts.select(LEFT, RIGHT, *[counted_level(c).alias(f"gamma_{c}") for c in COMPARISONS])


def pattern_counts(levels: DataFrame, names: list[str] | None = None) -> DataFrame:
    """How many pairs show each combination of levels: all that EM needs, whatever the number of pairs."""
    return levels.groupBy(*(names or GAMMAS)).agg(F.count("*").alias("n"))


def level_shares(levels: DataFrame, names: list[str] | None = None) -> DataFrame:
    """comparison, level, n, share among pairs with evidence."""
    names = names or GAMMAS
    rows = levels.select(F.explode(F.array(*[F.struct(F.lit(g.removeprefix("gamma_")).alias("comparison"), F.col(g).alias("level")) for g in names])).alias("x")).select("x.*").filter(F.col("level") >= 0)
    counts = rows.groupBy("comparison", "level").agg(F.count("*").alias("n"))
    total = counts.groupBy("comparison").agg(F.sum("n").alias("total"))
    return counts.join(total, "comparison").select("comparison", "level", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


def m_from_matches(levels: DataFrame, names: list[str] | None = None) -> DataFrame:
    """m by comparison and level, from labelled matches alone."""
    return level_shares(levels, names).withColumnRenamed("share", "m").select("comparison", "level", "n", "m")


def weighted(levels: DataFrame, weights: dict[str, dict[int, float]], prior: float) -> DataFrame:
    """bits and match_probability: the prior's log odds and the weights in a fixed order; missing evidence adds 0."""
    terms = [F.lit(float(prior))]
    for c, by_level in weights.items():
        case = reduce(lambda w, kv: w.when(F.col(f"gamma_{c}") == kv[0], F.lit(float(kv[1]))), by_level.items(), F.when(F.col(f"gamma_{c}") == MISSING, F.lit(0.0)))
        terms.append(case.otherwise(F.lit(0.0)))
    bits = reduce(lambda x, y: x + y, terms)
    return levels.withColumn("bits", bits).withColumn("match_probability", S.probability(F.col("bits")))


class FellegiSunterMatcher:
    """Predicts with a trained model."""

    def __init__(self, model: Model):
        self.model = model

    def score(self, candidates: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
        return scored(pair_levels(candidates, a, b), self.model)


def scored(levels: DataFrame, model: Model) -> DataFrame:
    """bits and match_probability of pairs whose levels are known."""
    weights = {c: {k: model.weight(c, k) for k in model.u[c]} for c in COMPARISONS}
    return weighted(levels, weights, log2(model.prior / (1 - model.prior))).select(LEFT, RIGHT, "bits", "match_probability")


def density_shift(scores: DataFrame, trained: float, given: float) -> DataFrame:
    """Scores for pairs of which a share ``given`` match, from a model for pairs of which ``trained`` do: the log odds move, the evidence stays."""
    move = log2(given / (1 - given)) - log2(trained / (1 - trained))
    bits = F.col("bits") + F.lit(move)
    return scores.withColumn("bits", bits).withColumn("match_probability", S.probability(F.col("bits")))


def exploded_keys(candidates: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The candidates again, from an array of pair keys on each record; a record without candidates has an empty one."""
    key = F.concat(LEFT, F.lit("|"), RIGHT)
    keys = lambda d, c: d.select(ID).join(candidates.groupBy(F.col(c).alias(ID)).agg(F.collect_set(key).alias("keys")), ID, "left").select(ID, F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))
    left = keys(a, LEFT).select(F.col(ID).alias(LEFT), F.explode("keys").alias("key"))
    right = keys(b, RIGHT).select(F.col(ID).alias(RIGHT), F.explode("keys").alias("key"))
    return left.join(right, "key").select(LEFT, RIGHT)
