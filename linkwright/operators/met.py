"""What classes of equal records score against all records of their brand, without pairs of classes: none is listed, shuffled or stored.

A class meets the other side by what that side has in common: per title and category the records of a brand become counts by
evidence and price, and a price of the class cuts those into a few ranges. Cells, which are a block of classes and a block of
the other side's, are worked on alone; what they give is a few rows for each class, which are merged.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.operators.blocking import dealt
from linkwright.operators.scoring import MISSING, PRICE, TITLE
from linkwright.sources.tables import ID

#: Classes of one brand that a cell has of the side that asks, and of the side that is asked; parts of a brand at least.
ASKING, ASKED, PARTS = 16_384, 65_536, 4
_KEYS = ["brand", "row", "column"]


def _cells(x: DataFrame, y: DataFrame):
    """x and y dealt into cells of a brand: blocks of x in rows, blocks of y in columns."""
    x, y = x.filter("brand is not null"), y.filter("brand is not null")
    most = lambda d, size: ceil((d.groupBy("brand").count().agg(F.max("count")).first()[0] or 0) / size)
    down, across = max(PARTS, most(x, ASKING)), max(1, most(y, ASKED))
    block = lambda n: F.pmod(F.xxhash64(ID), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = x.withColumn("row", block(down)).withColumn("column", every(across)), y.withColumn("column", block(across)).withColumn("row", every(down))
    # Both sides may be parts of one frame: columns of one origin on either side of a cogroup would be taken for each other.
    grouped = lambda d, side: dealt(d.select(*[F.col(c).alias(side + c) for c in d.columns]), *[side + c for c in _KEYS]).groupBy(*[side + c for c in _KEYS])
    return grouped(left, "x_").cogroup(grouped(right, "y_"))


def _codes(x: pa.Table, y: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of both as numbers, equal where the values are; nulls are -1."""
    both = pa.chunked_array([*x[column].chunks, *y[column].chunks], x[column].type).combine_chunks().dictionary_encode()
    codes = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return codes[: len(x)], codes[len(x) :]


def _lists(column: pa.ChunkedArray, vocabulary: dict) -> list[np.ndarray | None]:
    """Each list as numbers of its words."""
    return [None if v is None else np.array([vocabulary.setdefault(w, len(vocabulary)) for w in v], np.int64) for v in column.to_pylist()]


def _firsts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first row of each code, and the number of its code for each row."""
    _, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
    return first, inverse


def _overlaps(words: np.ndarray, flat: np.ndarray, starts: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """How many of these words each list has; lists lie behind each other in flat, a dummy between them."""
    flags[words] = 1
    found = np.add.reduceat(flags[flat], starts) if len(starts) else np.zeros(0, np.int64)
    flags[words] = 0
    return found


def _flat(lists: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists behind each other, each with a dummy (0) first; where they start; their sizes, nulls as -1."""
    sizes = np.array([-1 if v is None else len(v) for v in lists], np.int64)
    lengths = np.maximum(sizes, 0) + 1
    starts = np.cumsum(lengths) - lengths
    flat = np.zeros(lengths.sum(), np.int64)
    for at, v in zip(starts, lists, strict=True):
        if v is not None:
            flat[at + 1 : at + 1 + len(v)] = v
    return flat, starts, sizes


def _title_levels(words: np.ndarray | None, shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """scoring.title_level() of one set against others, of which shared and sizes are known."""
    levels = np.zeros(len(sizes), np.int64)
    if words is None:
        return np.full(len(sizes), MISSING)
    union = len(words) + sizes - shared
    j = np.where(union > 0, shared / np.maximum(union, 1), 1.0)
    for k, t in zip((1, 2, 3), TITLE[::-1], strict=True):
        levels[j >= t] = k
    levels[j == 1] = 4
    levels[sizes < 0] = MISSING
    return levels


def _price_levels(price: float | None, others: np.ndarray) -> np.ndarray:
    """scoring.price_level() of one price against others, of which the last is null."""
    levels = np.zeros(len(others) + 1, np.int64)
    if price is None:
        return np.full(len(levels), MISSING)
    with np.errstate(all="ignore"):
        most = np.maximum(price, others)
        gap = np.abs(price - others) / np.where(most == 0, np.nan, most)
    for k, t in zip((1, 2, 3), PRICE[::-1], strict=True):
        levels[:-1][gap <= t] = k
    levels[:-1][others == price] = 4
    levels[-1] = MISSING
    return levels


def values(x: DataFrame, y: DataFrame, weights: dict[str, dict[int, float]], prior: float, most: int | None = 2) -> DataFrame:
    """(unique_id, bits, n, best, m): for each class of x the values that records of its brand in y score, how many do, their
    smallest class, and how many of them have the title and category of x.

    x and y hold classes (unique_id, brand, title, category, t, p, n). Only the ``most`` highest values of a cell are given, all where it
    is None; rows of one class and value come from several cells and are to be added up.
    """
    names = [("title", range(MISSING, 5)), ("category", range(2)), ("price", range(MISSING, 5))]
    wt, wc, wp = (np.array([float(weights[c].get(k, 0.0)) if k != MISSING else 0.0 for k in levels]) for c, levels in names)

    def compare(xs: pa.Table, ys: pa.Table) -> pa.Table:
        xs, ys = (d.rename_columns([c.removeprefix(side) for c in d.column_names]) for d, side in ((xs, "x_"), (ys, "y_")))
        if not len(xs) or not len(ys):
            return pa.table({"unique_id": [], "bits": [], "n": [], "best": [], "m": []}, schema)
        ys = ys.take(pc.sort_indices(ys, [(ID, "ascending")], null_placement="at_end"))  # a smaller place is a smaller id
        (xt, yt), (xc, yc) = (_codes(xs, ys, c) for c in ("title", "category"))
        (first_x, xt_at), (first_y, yt_at) = _firsts(xt), _firsts(yt)
        vocabulary = {None: 0}
        mine, theirs = (_lists(d["t"].take(pa.array(f)), vocabulary) for d, f in ((xs, first_x), (ys, first_y)))
        flat, starts, sizes = _flat(theirs)
        flags = np.zeros(len(vocabulary), np.int64)
        n = ys["n"].to_numpy()
        given = ys["p"].combine_chunks()
        prices = np.unique(given.drop_null().to_numpy())
        yp = np.where(given.is_null().to_numpy(zero_copy_only=False), len(prices), np.searchsorted(prices, given.fill_null(0).to_numpy(zero_copy_only=False)))
        width, nobody = len(prices) + 1, len(ys)
        places = np.arange(len(ys) - 1, -1, -1)
        xp = xs["p"].to_pylist()
        cuts = {}
        for p in set(xp):
            levels = _price_levels(p, prices)
            at = np.concatenate([[0], np.flatnonzero(np.diff(levels)) + 1])
            cuts[p] = at, wp[levels[at] - MISSING]
        out = [[], [], [], [], []]
        heads = np.lexsort((xc, xt_at))
        bounds = np.flatnonzero(np.diff(xt_at[heads], prepend=-9) | np.diff(xc[heads], prepend=-9))
        title = None
        for lo, hi in zip(bounds, [*bounds[1:], len(heads)], strict=True):
            one = heads[lo]
            if title != xt_at[one]:
                title = xt_at[one]
                words = mine[title]
                shared = _overlaps(words, flat, starts, flags) if words is not None else np.zeros(len(sizes), np.int64)
                level = (_title_levels(words, shared, sizes) - MISSING)[yt_at]
            same = (yc == xc[one]) & (xc[one] >= 0)
            kinds, kind = np.unique(level * 2 + same, return_inverse=True)
            base = (prior + wt[kinds // 2]) + wc[kinds % 2]
            key = kind * width + yp
            cells = len(kinds) * width
            counts = np.bincount(key, n, cells).astype(np.int64).reshape(-1, width)
            least = np.full(cells, nobody)
            least[key[::-1]] = places  # the last that is written is the smallest
            least = least.reshape(-1, width)
            if most is None:
                true = same & (yt == xt[one]) if xt[one] >= 0 else np.zeros(len(ys), bool)
                true = np.bincount(key[true], n[true], cells).astype(np.int64).reshape(-1, width)
            for row in heads[lo:hi]:
                at, weight = cuts[xp[row]]
                number = np.add.reduceat(counts, at, axis=1).ravel()
                some = np.flatnonzero(number)
                bits = (base[:, None] + weight).ravel()[some]
                number, smallest = number[some], np.minimum.reduceat(least, at, axis=1).ravel()[some]
                matches = np.add.reduceat(true, at, axis=1).ravel()[some] if most is None else None
                left = bits
                for _ in range(len(bits) if most is None else most):
                    if not len(left):
                        break
                    top = left.max()
                    hit = bits == top
                    out[0].append(row)
                    out[1].append(top)
                    out[2].append(number[hit].sum())
                    out[3].append(smallest[hit].min())
                    out[4].append(matches[hit].sum() if most is None else 0)
                    left = left[left < top]
        ids = ys[ID].take(pa.array(np.array(out[3], np.int64)))
        return pa.table([xs[ID].take(pa.array(np.array(out[0], np.int64))).cast("string"), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int64()), ids.cast("string"), pa.array(out[4], pa.int64())], schema=schema)

    schema = pa.schema([(ID, pa.string()), ("bits", pa.float64()), ("n", pa.int64()), ("best", pa.string()), ("m", pa.int64())])
    columns = [ID, "brand", "title", "category", "t", "p", "n"]
    return _cells(x.select(*columns), y.select(*columns)).applyInArrow(compare, f"{ID} string, bits double, n long, best string, m long")


def nearest_sets(x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    """(unique_id, best, similarity): the class of its brand in y whose tokens have the highest Jaccard with those of each class of x, ties to the smaller id, where it reaches threshold.

    x and y hold classes (unique_id, brand, tokens, head); head are tokens that many classes have in common: what they share is
    counted once for those. A class that several cells know has a row from each.
    """

    def compare(xs: pa.Table, ys: pa.Table) -> pa.Table:
        xs, ys = (d.rename_columns([c.removeprefix(side) for c in d.column_names]) for d, side in ((xs, "x_"), (ys, "y_")))
        if not len(xs) or not len(ys):
            return pa.table({ID: [], "best": [], "similarity": []}, schema)
        ys = ys.take(pc.sort_indices(ys, [(ID, "ascending")], null_placement="at_end"))
        vocabulary = {None: 0}
        flat, starts, sizes = _flat(_lists(ys["tokens"], vocabulary))
        sizes = np.maximum(sizes, 0)
        mine, heads = _lists(xs["tokens"], vocabulary), _lists(xs["head"], vocabulary)
        flags = np.zeros(len(vocabulary), np.int64)
        rows_of = np.repeat(np.arange(len(ys)), np.diff(np.append(starts, len(flat))))
        order = np.argsort(flat, kind="stable")
        ends = np.searchsorted(flat[order], np.arange(len(vocabulary) + 1))
        held = rows_of[order]  # rows that have a word lie together
        met = {}
        out = [[], [], []]
        at = {}
        for row, (words, head) in enumerate(zip(mine, heads, strict=True)):
            if words is not None and len(words):
                at.setdefault(tuple(np.intersect1d(words, head)) if head is not None else (), []).append(row)
        for head, rows in at.items():
            head = np.array(head, np.int64)
            shared = _overlaps(head, flat, starts, flags)
            whole = {}
            for row in rows:
                size = len(mine[row])
                if size not in whole:
                    j = shared / (size + sizes - shared)
                    whole[size] = (first := int(np.argmax(j))), j[first]
                best, top = whole[size]  # without the words that are not in its head: less than the truth for who has one
                more = tuple(np.setdiff1d(mine[row], head))
                if more not in met:
                    met[more] = np.unique(np.concatenate([held[ends[w] : ends[w + 1]] for w in more]) if more else np.zeros(0, np.int64), return_counts=True)
                some, n = met[more]
                if len(some):
                    n = n + shared[some]
                    j = n / (size + sizes[some] - n)
                    k = int(np.argmax(j))
                    if j[k] > top or (j[k] == top and some[k] < best):
                        best, top = some[k], j[k]
                if top >= threshold:
                    out[0].append(row)
                    out[1].append(best)
                    out[2].append(top)
        ids = [d[ID].take(pa.array(np.array(i, np.int64))).cast("string") for d, i in ((xs, out[0]), (ys, out[1]))]
        return pa.table([*ids, pa.array(out[2], pa.float64())], schema=schema)

    schema = pa.schema([(ID, pa.string()), ("best", pa.string()), ("similarity", pa.float64())])
    columns = [ID, "brand", "tokens", "head"]
    return _cells(x.select(*columns), y.select(*columns)).applyInArrow(compare, f"{ID} string, best string, similarity double")
