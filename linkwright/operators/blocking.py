"""Candidate generation. Every rule is an equi-join of inverted indexes; no rule compares all pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions import text as X
from linkwright.operators import features as D
from linkwright.operators import scoring as G
from linkwright.operators.cells import found
from linkwright.sources.shared import kept
from linkwright.sources.tables import ATTRIBUTES, ID, LEFT, RIGHT

#: Words in a signature (a long has that many bits), and shares of the left records of a brand.
SIGNATURE, SALTS = 63, 16
#: Records that one row of chunks() holds at most.
CHUNK = 1024
RULES = ("R1", "R2", "R3", "R5", "R4", "R4-sym", "R4-short")
#: What a rule sets in the flags of a pair.
BITS = {r: 1 << i for i, r in enumerate(RULES)}


@dataclass(frozen=True)
class Settings:
    """Cutoffs count records of the right side."""

    rare_word: int = 100
    rare_ngram: int = 50
    brand_words: int = 2
    ngram: int = 5
    neighbours: int = 100
    short: tuple[int, ...] = (4, 3)
    columns: tuple[str, ...] = tuple(ATTRIBUTES)


class Blocker(Protocol):
    name: str

    def generate_candidates(self, a: DataFrame, b: DataFrame) -> DataFrame: ...


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows by these columns over several tasks a core: what meets there is far larger than what comes in, by which Spark would choose fewer."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def meetings(left: DataFrame, right: DataFrame, item: str = "item") -> DataFrame:
    """Pairs of records that share an item, once for each: the equi-join form of an array-overlap predicate."""
    r = right.select(F.col(ID).alias(RIGHT), item)
    return left.select(F.col(ID).alias(LEFT), item).join(r, item).select(LEFT, RIGHT)


def chunks(df: DataFrame, on: list[str], item: str = ID) -> DataFrame:
    """(on, chunk, items): the items of records that are equal in ``on`` (nulls are equal), at most CHUNK in a row; an item may be null."""
    nth = F.row_number().over(Window.partitionBy(*on).orderBy(item))
    nulls = F.array_repeat(F.lit(None).cast(df.schema[item].dataType), F.count_if(F.col("items").isNull()).cast("int"))
    return df.select(*on, F.floor((nth - 1) / CHUNK).alias("chunk"), F.col(item).alias("items")).groupBy(*on, "chunk").agg(F.concat(F.collect_list("items"), nulls).alias("items"))


def met_chunks(left: DataFrame, right: DataFrame, on: list[str], by: str) -> DataFrame:
    """left and right (records or chunks; their other columns have different names) where they are equal in ``on``.

    The left rows of a group are dealt by a salt from ``by``, so that a large group is not one task. What depends on chunks is computed
    behind this, once for each pair of chunks; listed() then gives pairs of records, which are not shuffled.
    """
    salted = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    every = right.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return dealt(salted, *on, "salt").join(dealt(every, *on, "salt"), [*on, "salt"]).drop("salt")


def listed(met: DataFrame, left: str, right: str) -> DataFrame:
    """met with a row for each pair of members of the arrays left and right."""
    others = [c for c in met.columns if c not in (left, right)]
    return met.select(F.explode(left).alias(left), right, *others).select(left, F.explode(right).alias(right), *others)


def rare(index: DataFrame, cutoff: int, item: str = "item") -> DataFrame:
    """Postings of items that at most cutoff records hold: lists are cut by meaning, before any join.

    A window counts an item where its postings meet, so that they are made and dealt once.
    """
    held = F.count("*").over(Window.partitionBy(item))
    return index.withColumn("__df", held).filter(F.col(item).isNotNull() & (F.col("__df") <= cutoff)).drop("__df")


def nearest(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """The k targets of each query by n-gram Jaccard, ties to the larger id; targets that share nothing never appear.

    Both hold (unique_id, grams). Records of one side with equal grams are one class. Classes meet, not records: a query class
    keeps the values of similarity that hold its first k targets, and of a target class no more than its k largest ids.
    """
    q, t = (d.select(ID, F.array_sort("grams").alias("grams")).filter(F.size("grams") > 0) for d in (queries, targets))
    cq, ct = (kept(d.groupBy("grams").agg(F.min(ID).alias("class"), F.count("*").alias("n"))) for d in (q, t))
    postings = lambda d, c, n: d.select(F.col("class").alias(c), F.size("grams").alias(n), F.explode("grams").alias("gram"))
    common = postings(cq, "q", "nq").join(postings(ct, "t", "nt"), "gram").groupBy("q", "t").agg(F.count("*").alias("n"), F.first("nq").alias("nq"), F.first("nt").alias("nt"))
    scored = common.select("q", "t", (F.col("n") / (F.col("nq") + F.col("nt") - F.col("n"))).alias("similarity"))
    sized = scored.join(ct.select(F.col("class").alias("t"), F.col("n").alias("size")), "t")
    level = Window.partitionBy("q").orderBy(F.col("similarity").desc()).rowsBetween(Window.unboundedPreceding, -1)
    held = sized.groupBy("q", "similarity").agg(F.sum("size").alias("size"), F.collect_list("t").alias("ts"))
    near = held.withColumn("ahead", F.coalesce(F.sum("size").over(level), F.lit(0))).filter(F.col("ahead") < k).select("q", "similarity", F.explode("ts").alias("class"))
    first = Window.partitionBy("class").orderBy(F.col(ID).desc())
    largest = _classed(t, ct).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k).select("class", F.col(ID).alias("t"))
    best = Window.partitionBy("q").orderBy(F.col("similarity").desc(), F.col("t").desc())
    places = near.join(largest, "class").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    lists = places.groupBy(F.col("q").alias("class")).agg(F.collect_list(F.struct("t", "similarity", "place")).alias("found"))  # k at most
    rows = _classed(q, cq).join(lists, "class").select(F.col(ID).alias("q"), F.explode("found").alias("x"))
    return rows.select("q", "x.t", "x.similarity", "x.place")


def _classed(records: DataFrame, classes: DataFrame) -> DataFrame:
    """(unique_id, class) of records by their grams."""
    return records.join(classes.select("grams", "class"), "grams").select(ID, "class")


def frequent_words(tokens: DataFrame, most: int = SIGNATURE) -> DataFrame:
    """One row with the words that most records hold, ties by word."""
    held = D.document_frequency(D.postings(tokens, "tokens")).orderBy(F.col("df").desc(), "item").limit(most)
    return held.agg(F.array_sort(F.collect_list("item")).alias("frequent"))


def with_signature(words: DataFrame, frequent: list[str]) -> DataFrame:
    """(unique_id, signature): a bit for each of the frequent words, set where a record has it among its words."""
    listed = F.array(*[F.lit(w) for w in frequent]).cast("array<string>")
    bits = "aggregate(array_intersect(words, frequent), 0L, (s, w) -> s + shiftleft(1L, cast(array_position(frequent, w) - 1 as int)))"
    return words.withColumn("frequent", listed).select(ID, F.expr(bits).alias("signature"))


def _named(found: str) -> Column:
    """The sorted names of rules, joined by '+', from their bits."""
    return F.concat_ws("+", *[F.when(F.col(found).bitwiseAND(F.lit(BITS[r])) > 0, r) for r in sorted(BITS)])


class ClassicalBlocker:
    """The seven rules; the rescue rules work on what earlier ones leave."""

    name = "classical"

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()

    def rule_word(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """R1: a shared token that few right records hold."""
        return self._met_word(self._tokenised(a), self._tokenised(b)).distinct()

    def _met_word(self, ta: DataFrame, tb: DataFrame) -> DataFrame:
        return meetings(dealt(D.postings(ta, "tokens"), "item"), rare(dealt(D.postings(tb, "tokens"), "item"), self.settings.rare_word))

    def rule_identifier(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """R2: a shared part number at any frequency."""
        return self._met_identifier(self._tokenised(a), self._tokenised(b))

    def _met_identifier(self, ta: DataFrame, tb: DataFrame) -> DataFrame:
        held = lambda d, side, name: d.select(F.col(ID).alias(side), F.filter("tokens", X.is_identifier_like).alias(name)).withColumn("item", F.explode(name))
        # A pair is told by the smallest of its common items, so that pairs need no shuffle to become distinct.
        met = dealt(held(ta, LEFT, "held_l"), "item").join(dealt(held(tb, RIGHT, "held_r"), "item"), "item")
        return met.filter(F.col("item") == F.array_min(F.array_intersect("held_l", "held_r"))).select(LEFT, RIGHT)

    def rule_brand(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """R3: a shared brand and enough other shared tokens that are no brand of the left record.

        Pairs of a brand are compared and given in cells. Most share words that very many records hold: signatures of those
        words tell that, in a few bytes a pair; only the other pairs compare all their words.
        """
        ta, tb = (kept(self._tokenised(t)) for t in (a, b))
        return self._in_cells(a, b, ta, tb, None, False).select(LEFT, RIGHT)

    def _in_cells(self, a: DataFrame, b: DataFrame, ta: DataFrame, tb: DataFrame, rare: DataFrame | None, items: bool = True, features: tuple[DataFrame, DataFrame] | None = None, counted: bool = False) -> DataFrame:
        """cells.found() of R2 (where items), R3 and rare pairs; ta and tb are tokens that were kept, of all records or of some."""
        vocabulary = D.brand_vocabulary(a, b)
        none = F.array().cast("array<string>")
        identifiers = F.filter("tokens", X.is_identifier_like) if items else none
        sides = []
        for d, t in ((a, ta), (b, tb)):
            brands = D.brand_harvest(d, t, vocabulary).groupBy(ID).agg(F.collect_set("brand").alias("brands"))
            words = F.array_except("tokens", "brands") if d is a else F.col("tokens")
            sides.append(t.join(brands, ID, "left").withColumn("brands", F.coalesce("brands", none)).select(ID, "brands", identifiers.alias("items"), words.alias("words")))
        if not features:
            return found(*sides, rare, self.settings.brand_words, (BITS["R2"], BITS["R3"]), counted=counted)
        sides = [d.join(f, ID) for d, f in zip(sides, features, strict=True)]
        return found(*sides, rare, self.settings.brand_words, (BITS["R2"], BITS["R3"]), tuple(c for c in G.COMPARISONS if c != "price_value"), ("price_value",))

    def rule_ngram(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """R5: a shared n-gram that few right records hold."""
        return self._met_ngram(a, b).distinct()

    def _met_ngram(self, a: DataFrame, b: DataFrame, only: DataFrame | None = None) -> DataFrame:
        ga, gb = (dealt(D.postings(self._grams(t), "grams"), "item") for t in (a, b))
        few = rare(gb, self.settings.rare_ngram)
        return meetings(ga, few if only is None else few.join(only.select(ID), ID, "left_semi"))

    def _met_rare(self, a: DataFrame, b: DataFrame, ta: DataFrame, tb: DataFrame, only: DataFrame | None = None) -> DataFrame:
        """(left, right, found) of R1 and R5, as often as they find a pair; of the right records in ``only``, where it is given, under the frequencies of all."""
        words = rare(dealt(D.postings(tb, "tokens"), "item"), self.settings.rare_word)
        words = words if only is None else words.join(only.select(ID), ID, "left_semi")
        met = {"R1": meetings(dealt(D.postings(ta, "tokens"), "item"), words), "R5": self._met_ngram(a, b, only)}
        return reduce(DataFrame.unionByName, [d.select(LEFT, RIGHT, F.lit(BITS[k]).alias("found")) for k, d in met.items()])

    def first_rules(self, a: DataFrame, b: DataFrame, tokens: tuple[DataFrame, DataFrame] | None = None, features: tuple[DataFrame, DataFrame] | None = None, counted: bool = False) -> DataFrame:
        """(unique_id_l, unique_id_r, found) of the rules that don't depend on others: one row for each pair, and a bit for each rule.

        Pairs that share something rare meet by it; pairs of a brand or a part number are found in cells, behind which no pair
        is shuffled. features and counted as in _in_cells().
        """
        ta, tb = tokens or [kept(self._tokenised(t)) for t in (a, b)]
        return self._in_cells(a, b, ta, tb, self._met_rare(a, b, ta, tb), True, features, counted)

    def candidates_by_rule(self, a: DataFrame, b: DataFrame, last: str = "R4-short") -> DataFrame:
        """(unique_id_l, unique_id_r, rule) of all rules, or of those up to a rescue rule: later ones are not computed."""
        rules = F.explode(F.array_compact(F.array(*[F.when(F.col("found").bitwiseAND(F.lit(k)) > 0, r) for r, k in BITS.items()])))
        return self._found(a, b, last).select(LEFT, RIGHT, rules.alias("rule"))

    def _found(self, a: DataFrame, b: DataFrame, last: str = RULES[-1]) -> DataFrame:
        """first_rules() and what the rescue rules add, which is pairs of records that no earlier rule reached."""
        tokens = [kept(self._tokenised(t)) for t in (a, b)]
        added = self._rescues(a, b, lambda side: self._unreached(a, b, tokens, side), last)
        return reduce(DataFrame.unionByName, added, self.first_rules(a, b, tokens))

    def _unreached(self, a: DataFrame, b: DataFrame, tokens: list[DataFrame], side: str) -> DataFrame:
        """Records of one side that first_rules() don't reach. Part numbers are looked up first: pairs are found for the other records only."""
        mine, (ta, tb) = (a if side == LEFT else b), tokens
        items = [D.postings(t.select(ID, F.filter("tokens", X.is_identifier_like).alias("items")), "items") for t in (ta, tb)]
        own, other = items if side == LEFT else items[::-1]
        told = own.join(other.select("item").distinct(), "item", "left_semi").select(ID).distinct()
        rest = kept(mine.join(told, ID, "left_anti"))
        if rest.isEmpty():
            return rest
        of_rest = (ta if side == LEFT else tb).join(rest.select(ID).distinct(), ID, "left_semi")
        if side == LEFT:
            met = self._in_cells(a, b, of_rest, tb, self._met_rare(rest, b, of_rest, tb), True, counted=True)
        else:
            met = self._in_cells(a, b, ta, of_rest, self._met_rare(a, b, ta, tb, rest), True, counted=True)
        return kept(rest.join(met.select(F.col(side).alias(ID)).distinct(), ID, "left_anti"))

    def _rescues(self, a: DataFrame, b: DataFrame, unreached: Callable[[str], DataFrame], last: str = RULES[-1]) -> list[DataFrame]:
        """(left, right, found) of each rescue rule that finds something to do; unreached gives what the first rules leave of a side."""
        near = self._rescued("R4", unreached(LEFT), b, self.settings.ngram)
        if last == "R4":
            return near
        stranded = unreached(RIGHT)
        for rule, n in (("R4-sym", self.settings.ngram), *[("R4-short", n) for n in self.settings.short]):
            rest = reduce(lambda d, x: d.join(x.select(F.col(RIGHT).alias(ID)).distinct(), ID, "left_anti"), near, stranded).persist()
            near = near + self._rescued(rule, rest, a, n)
            if rule == last == "R4-sym":
                break
        return near

    def counted_candidates(self, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(left, rules, n): how many candidates a left record has of these rules; and (unique_id) of the right records that are one's candidate. No pair of the first rules is listed."""
        met = self.first_rules(a, b, counted=True).groupBy(LEFT, RIGHT, "found").agg(F.sum("n").alias("n"))
        met = kept(met)
        by_left, right = met.filter("found is not null").select(LEFT, "found", "n"), met.filter("found is null").select(F.col(RIGHT).alias(ID))
        reached = {LEFT: by_left.select(F.col(LEFT).alias(ID)), RIGHT: right}
        for near in self._rescues(a, b, lambda side: (a if side == LEFT else b).join(reached[side].distinct(), ID, "left_anti").persist()):
            by_left = by_left.unionByName(near.groupBy(LEFT, "found").agg(F.count("*").alias("n")))
            right = right.unionByName(near.select(F.col(RIGHT).alias(ID)))
        return by_left.select(LEFT, _named("found").alias("rules"), "n"), right.distinct()

    def compared_candidates(self, a: DataFrame, b: DataFrame, fa: DataFrame, fb: DataFrame) -> DataFrame:
        """scoring.pair_counts() of all candidates, from the cells that find them."""
        tokens = [kept(self._tokenised(t)) for t in (a, b)]
        first = self.first_rules(a, b, tokens, (fa, fb)).drop("found")
        near = self._rescues(a, b, lambda side: self._unreached(a, b, tokens, side))
        return reduce(DataFrame.unionByName, [G.pair_counts(d, fa, fb) for d in near], first)

    def _rescued(self, rule: str, stranded: DataFrame, others: DataFrame, n: int) -> list[DataFrame]:
        """The pairs of stranded records; where no record is stranded, the others' n-grams are not read."""
        if stranded.isEmpty():
            return []
        near = nearest(self._grams(stranded, n), self._grams(others, n), self.settings.neighbours)
        ids = (LEFT, RIGHT) if rule == "R4" else (RIGHT, LEFT)
        return [near.select(F.col("q").alias(ids[0]), F.col("t").alias(ids[1]), F.lit(BITS[rule]).alias("found")).select(LEFT, RIGHT, "found").persist()]

    def generate_candidates(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """One row for each pair with the sorted names of its rules joined by '+'."""
        return self._found(a, b).select(LEFT, RIGHT, _named("found").alias("rules"))

    def _tokenised(self, df: DataFrame) -> DataFrame:
        return D.tokenised(df, list(self.settings.columns))

    def _grams(self, df: DataFrame, n: int | None = None) -> DataFrame:
        grams = X.char_ngrams(X.record_text(list(self.settings.columns)), n or self.settings.ngram)
        return df.select(ID, grams.alias("grams"))


def candidate_map(candidates: DataFrame, a: DataFrame) -> DataFrame:
    """Every left record with its sorted candidates, possibly none."""
    lists = candidates.groupBy(LEFT).agg(F.array_sort(F.collect_set(RIGHT)).alias("found"))
    return a.select(F.col(ID).alias(LEFT)).join(lists, LEFT, "left").select(LEFT, F.coalesce("found", F.array().cast("array<string>")).alias("candidates"))


def rule_report(candidates: DataFrame) -> DataFrame:
    """By rule: pairs, pairs that only it found, left records that it reaches."""
    # Pairs are counted by left record and combination first: what is dealt to rules are these, not pairs.
    return counted_report(candidates.groupBy(LEFT, "rules").agg(F.count("*").alias("n")))


def counted_report(held: DataFrame) -> DataFrame:
    """rule_report() from (left, rules, n)."""
    rows = held.select(LEFT, F.explode(F.split("rules", r"\+")).alias("rule"), "rules", "n")
    by_left = rows.groupBy("rule", LEFT).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("rule") == F.col("rules"), F.col("n")).otherwise(0)).alias("alone"))
    return by_left.groupBy("rule").agg(F.sum("n").alias("n_pairs"), F.sum("alone").alias("n_unique"), F.count("*").alias("n_left"))


def per_left_counts(candidates: DataFrame, a: DataFrame) -> DataFrame:
    return counted_per_left(candidates.select(LEFT, F.lit(1).alias("n")), a)


def counted_per_left(held: DataFrame, a: DataFrame) -> DataFrame:
    """per_left_counts() from (left, n), of which a left record may have several."""
    counts = held.groupBy(F.col(LEFT).alias(ID)).agg(F.sum("n").alias("n"))
    return a.select(ID).join(counts, ID, "left").select(ID, F.coalesce("n", F.lit(0)).alias("n"))


def ranked_quantiles(values: DataFrame, column: str) -> DataFrame:
    """minimum, median (upper), p99 and maximum of a column by position in sorted order, without interpolation.

    Equal values are counted before they are ordered, so that one task sees distinct values only.
    """
    tally = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    upto = tally.select("v", F.sum("c").over(Window.orderBy("v")).alias("upto"), F.sum("c").over(Window.partitionBy(F.lit(1))).alias("n"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    return upto.agg(F.min("v").alias("minimum"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(F.col("n") * 0.99)).alias("p99"), F.max("v").alias("maximum"))


def grouped_counts(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """per_left_counts() of the pairs that are equal in ``on``, from sizes of groups: no pair is listed."""
    sizes = b.groupBy(*on).agg(F.count("*").alias("n"))
    return a.select(ID, *on).join(sizes, on, "left").select(ID, F.coalesce("n", F.lit(0)).alias("n"))


def grouped_keys(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """exploded_keys() of the pairs that are equal in ``on``: an array holds the records that share a key, so that a key is not one pair's and no pair is shuffled."""
    left, right = (chunks(d, on).select(*on, F.col("items").alias(n)) for d, n in ((a, LEFT), (b, RIGHT)))
    return listed(met_chunks(left, right, on, LEFT).select(LEFT, RIGHT), LEFT, RIGHT)


def grouped_totals(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """totals() of the pairs that are equal in ``on``, from sizes of groups."""
    ga, gb = (d.groupBy(*on).agg(F.count("*").alias(n)) for d, n in ((a, "x"), (b, "y")))
    every = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    one = ga.join(gb, on, "full").agg(
        every(F.col("x"), "na"), every(F.col("y"), "nb"), every(F.col("x") * F.col("y"), "kept"),
        every(F.when(F.col("y").isNull(), F.col("x")), "orphans"), every(F.when(F.col("x").isNull(), F.col("y")), "unreachable"),
    )
    return _reduction(one)


def _reduction(one: DataFrame) -> DataFrame:
    possible = F.col("na") * F.col("nb")
    return one.select(possible.alias("possible"), "kept", (possible - F.col("kept")).alias("discarded"), F.round(100.0 * (possible - F.col("kept")) / possible, 6).alias("reduction"), "orphans", "unreachable")


def totals(candidates: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """possible, kept, discarded, reduction (percent), orphans and unreachable right records, in one row."""
    size = lambda d, name: d.agg(F.count("*").alias(name))
    reach = lambda d, c, name: size(d.select(ID).join(candidates.select(F.col(c).alias(ID)).distinct(), ID, "left_anti"), name)
    one = size(a, "na").crossJoin(size(b, "nb")).crossJoin(size(candidates, "kept")).crossJoin(reach(a, LEFT, "orphans")).crossJoin(reach(b, RIGHT, "unreachable"))
    return _reduction(one)


def counted_totals(held: DataFrame, right: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """totals() from (left, n), of which a left record may have several, and the right records (unique_id) that are in a pair."""
    size = lambda d, name: d.agg(F.count("*").alias(name))
    reach = lambda d, found, name: size(d.select(ID).join(found.distinct(), ID, "left_anti"), name)
    one = size(a, "na").crossJoin(size(b, "nb")).crossJoin(held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept")))
    return _reduction(one.crossJoin(reach(a, held.select(F.col(LEFT).alias(ID)), "orphans")).crossJoin(reach(b, right, "unreachable")))
