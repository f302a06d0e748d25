"""Planted probes: copies of accepted records with one change that makes them another product, or with less text about the same one.

A change is a Column expression: of the rules, in their order, the first that applies. Copies are scored under the model and
the frequencies that are there already; nothing is trained or blocked again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions import sets as S
from linkwright.functions import text as X
from linkwright.operators import decide as H
from linkwright.operators.scoring import FellegiSunterMatcher
from linkwright.sources.tables import ID, LEFT, RIGHT

# Colours, each of which becomes the next one.
COLOURS = ("black", "white", "blue", "red", "green", "silver", "grey", "gray", "pink", "purple")
RULES = ("capacity", "dimension", "model_number", "colour")
_CAPACITY = r"(?is)^(.*?)\b(\d+)(\s?)(kb|mb|gb|tb)\b(.*)$"
_DIMENSION = r"(?is)^(.*?)(\d+)(\s?(?:inch\b|in\b|\").*)$"
_COLOUR = rf"(?is)^(.*?)\b({'|'.join(COLOURS)})\b(.*)$"
_UNIT = r"(?is)^(.*?\b\d+\s?)(kb|mb|gb|tb)\b(.*)$"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _capacity(text: Column) -> Column:
    """The first capacity times 4, or times 8 where the text has that value already."""
    number, unit = _part(text, _CAPACITY, 2), F.lower(_part(text, _CAPACITY, 4))
    n = number.try_cast("decimal(38,0)")
    stated = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\b(\d+)\s?(kb|mb|gb|tb)\b"), F.lit(0)), lambda x: F.regexp_replace(x, r"\s", ""))
    times = lambda k: (n * k).cast("decimal(38,0)").cast("string")
    new = F.when(F.array_contains(stated, F.concat(times(4), unit)), times(8)).otherwise(times(4))
    return F.concat(_part(text, _CAPACITY, 1), new, _part(text, _CAPACITY, 3), _part(text, _CAPACITY, 4), _part(text, _CAPACITY, 5))


def _dimension(text: Column) -> Column:
    n = _part(text, _DIMENSION, 2).try_cast("decimal(38,0)")
    return F.concat(_part(text, _DIMENSION, 1), (n + 2).cast("decimal(38,0)").cast("string"), _part(text, _DIMENSION, 3))


def _numbered(text: Column) -> Column:
    """The first token of five characters or more with a letter and a digit; null without one."""
    tokens = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.get(F.filter(tokens, lambda t: (F.length(t) >= 5) & t.rlike("[A-Za-z]") & t.rlike("[0-9]")), F.lit(0))


def _model_number(text: Column) -> Column:
    """That token with its last digit one higher, 9 becoming 0, at its first place as a token."""
    token = _numbered(text)
    digit = F.regexp_extract(token, "([0-9])[A-Za-z]*$", 1).cast("int")
    new = F.concat(F.regexp_extract(token, "^(.*)[0-9][A-Za-z]*$", 1), ((digit + 1) % 10).cast("string"), F.regexp_extract(token, "[0-9]([A-Za-z]*)$", 1))
    parts = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    place = F.array_position(parts, token)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i + 1 == place, new).otherwise(p)), "")


def _colour(text: Column) -> Column:
    following = F.create_map(*[F.lit(x) for i, c in enumerate(COLOURS) for x in (c, COLOURS[(i + 1) % len(COLOURS)])])
    return F.concat(_part(text, _COLOUR, 1), following[F.lower(_part(text, _COLOUR, 2))], _part(text, _COLOUR, 3))


def near_miss(text: Column) -> tuple[Column, Column]:
    """(rule, changed text): the first rule that applies changes one thing; both null where none does."""
    applies = {"capacity": text.rlike(_CAPACITY), "dimension": text.rlike(_DIMENSION), "model_number": _numbered(text).isNotNull(), "colour": text.rlike(_COLOUR)}
    changed = {"capacity": _capacity, "dimension": _dimension, "model_number": _model_number, "colour": _colour}
    rule = out = None
    for name in RULES:
        rule = F.when(applies[name], name) if rule is None else rule.when(applies[name], name)
        out = F.when(applies[name], changed[name](text)) if out is None else out.when(applies[name], changed[name](text))
    return rule, out


def benign(text: Column, key: Column) -> Column:
    """The text's tokens (parts between white space) without every fifth of them, rounded down: those whose hashed places come first."""
    tokens = F.split(F.trim(text), r"\s+")
    order = F.array_sort(F.transform(tokens, lambda t, i: F.struct(F.md5(F.concat_ws("#", key, i)).alias("h"), i.alias("i"))))
    gone = F.transform(F.slice(order, F.lit(1), F.greatest(F.lit(0), F.floor(F.size(tokens) / 5).cast("int"))), lambda x: x["i"])
    return F.array_join(F.filter(tokens, lambda t, i: ~F.array_contains(gone, i)), " ")


def swapped_unit(text: Column) -> Column:
    """The first capacity with the next larger unit (tb with gb), its number left alone; null without one."""
    following = F.create_map(*[F.lit(x) for x in ("kb", "mb", "mb", "gb", "gb", "tb", "tb", "gb")])
    return F.when(text.rlike(_UNIT), F.concat(_part(text, _UNIT, 1), following[F.lower(_part(text, _UNIT, 2))], _part(text, _UNIT, 3)))


def swapped_colour(text: Column) -> Column:
    return F.when(text.rlike(_COLOUR), _colour(text))


def planted(accepted: DataFrame, right: DataFrame) -> DataFrame:
    """Two copies of the right record of each accepted pair: (left, partner, kind, rule, columns of right).

    kind near_miss has one change in its title and a rule; where no rule applies, its rule is null and its title too.
    kind benign has fewer words in its title. Their ids are the partner's with ~near and ~benign behind it.
    """
    rule, changed = near_miss(F.col("title"))
    others = [c for c in right.columns if c not in (ID, "title")]
    base = accepted.select(LEFT, F.col(RIGHT).alias("partner")).join(right.select(F.col(ID).alias("partner"), "title", *others), "partner")
    kinds = F.array(
        F.struct(F.lit("near_miss").alias("kind"), rule.alias("rule"), changed.alias("text"), F.concat("partner", F.lit("~near")).alias(ID)),
        F.struct(F.lit("benign").alias("kind"), F.lit(None).cast("string").alias("rule"), benign(F.col("title"), F.col("partner")).alias("text"), F.concat("partner", F.lit("~benign")).alias(ID)),
    )
    return base.withColumn("x", F.explode(kinds)).select(LEFT, "partner", "x.kind", "x.rule", f"x.{ID}", F.col("x.text").alias("title"), *others)


def probe_rates(scored: DataFrame, accept: float = H.ACCEPT_BITS) -> DataFrame:
    """One row of rates from (kind, rule, bits of the copy, partner_bits): usurped (near misses strictly above the true partner),
    tied_or_beat, would_be_accepted, retained (benign copies at the accept threshold), skipped (accepted pairs that no rule changes)."""
    near, made = F.col("kind") == "near_miss", F.col("rule").isNotNull()
    one = scored.agg(
        F.count_if(near).alias("pairs"), F.count_if(near & made).alias("planted"), F.count_if(near & made & (F.col("bits") > F.col("partner_bits"))).alias("usurped"),
        F.count_if(near & made & (F.col("bits") >= F.col("partner_bits"))).alias("tied_or_beat"), F.count_if(near & made & (F.col("bits") >= accept)).alias("would_be_accepted"),
        F.count_if(~near).alias("benign"), F.count_if(~near & (F.col("bits") >= accept)).alias("retained"),
    )
    rate = lambda part, whole: F.round(S.ratio(F.col(part), F.col(whole)), 9).alias(f"{part}_rate")
    return one.select("pairs", "planted", "benign", *[rate(c, "planted") for c in ("usurped", "tied_or_beat", "would_be_accepted")], rate("retained", "benign"), F.round(S.ratio(F.col("pairs") - F.col("planted"), F.col("pairs")), 9).alias("skip_rate"))


def veto_tests(accepted: DataFrame, left: DataFrame, right: DataFrame, other: str = "modelno") -> DataFrame:
    """test, made, fired, rate: how often the quantity veto refuses copies of accepted pairs' right records.

    outside_title: the first capacity moves, four times as large, from the title to another attribute. unit: the same number
    in another unit. colour: a control, which must not fire. none: the accepted pairs as they are. Values are read from all attributes.
    """
    attributes = [c for c in right.columns if c != ID]
    said = lambda d: X.quantities(F.concat_ws(" ", *[F.col(c) for c in d.columns if c not in (ID, LEFT, RIGHT)]))
    own = left.select(F.col(ID).alias(LEFT), said(left).alias("ql"))
    base = accepted.select(LEFT, RIGHT).join(own, LEFT).join(right.select(F.col(ID).alias(RIGHT), *attributes), RIGHT)
    title = F.col("title")
    has = title.rlike(_CAPACITY)
    moved = F.concat(_part(title, _CAPACITY, 1), _part(title, _CAPACITY, 5))
    stated = F.regexp_extract(_capacity(title), _CAPACITY, 2)
    # Texts of each attribute in each test; a test that can't change a record has null for its title.
    rest = {c: F.col(c).cast("string") for c in attributes if c != "title"}
    cases = {
        "outside_title": (F.when(has, moved), {other: F.concat_ws(" ", rest.get(other, F.lit(None).cast("string")), F.concat(stated, _part(title, _CAPACITY, 4)))}),
        "unit": (swapped_unit(title), {}),
        "colour": (swapped_colour(title), {}),
        "none": (title, {}),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("test"), t.isNotNull().alias("made"), X.quantities(F.concat_ws(" ", t, *(rest | more).values())).alias("qr")) for k, (t, more) in cases.items()])
    told = base.select("ql", F.explode(rows).alias("x")).filter("x.made")
    fired = F.coalesce(S.quantities_conflict(F.col("ql"), F.col("x.qr")), F.lit(False))
    counts = told.groupBy("x.test").agg(F.count("*").alias("made"), F.count_if(fired).alias("fired"))
    return counts.select("test", "made", "fired", F.round(F.col("fired") / F.col("made"), 9).alias("rate"))


def rescored(accepted: DataFrame, left: DataFrame, right: DataFrame, score: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(left, partner, kind, rule, bits, partner_bits) of the copies of accepted pairs (left, right, bits).

    score gives (left, right, bits) of pairs of a left record and a copy; it must not learn from copies. Copies that no rule
    makes have null bits.
    """
    copies = planted(accepted, right)
    made = copies.filter("title is not null")
    records = made.select(ID, *[c for c in right.columns if c != ID]).dropDuplicates([ID])
    scores = score(made.select(LEFT, F.col(ID).alias(RIGHT)).distinct(), left, records).select(LEFT, F.col(RIGHT).alias(ID), "bits")
    partner = accepted.select(LEFT, F.col(RIGHT).alias("partner"), F.col("bits").alias("partner_bits"))
    return copies.select(LEFT, "partner", ID, "kind", "rule").join(partner, [LEFT, "partner"]).join(scores, [LEFT, ID], "left").drop(ID)


def by_stored_model(stored) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """score of rescored(): a stored model, with features under its own frequencies, which copies don't change."""
    return lambda pairs, left, records: FellegiSunterMatcher(stored.model).score(pairs, stored.features(left), stored.features(records))
