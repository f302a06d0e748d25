"""Candidates in cells: a block of left records and one of right records, which a task compares and gives in slices. Pairs of a brand or a part number, most by far, are never shuffled or stored.

What is shuffled are the records, once for each block of the other side, and the pairs that share something rare.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.operators.scoring import CELL_CHARS
from linkwright.sources.tables import ID, LEFT, RIGHT

#: Words of a signature; pairs of a slice; parts of each side at least.
WORDS, SLICE, PARTS = 128, 100_000, (4, 8)
_PAIR, _LEFT, _RIGHT = range(3)


def _listed(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of all lists behind each other as codes, where each list starts, and sizes (-1 for null)."""
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy().astype(np.int64)
    lengths = np.maximum(sizes, 0)
    words = lists.combine_chunks().flatten().dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(lengths) - lengths, sizes


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all members of the lists that start there."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Lists:
    """Lists of left records and of right ones with common codes."""

    def __init__(self, left: pa.ChunkedArray, right: pa.ChunkedArray):
        both = pa.chunked_array([*left.chunks, *right.chunks], left.type)
        self.codes, starts, sizes = _listed(both)
        self.starts, self.sizes, n = starts, sizes, len(left)
        self.lengths = np.maximum(sizes, 0)
        self.of_right = starts[n:], self.lengths[n:]
        self.flags = np.zeros(int(self.codes.max(initial=-1)) + 1, np.uint8)
        self.n = n

    def of(self, i: int) -> np.ndarray:
        return self.codes[self.starts[i] : self.starts[i] + self.lengths[i]]

    def shared(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Members that left record i has in common with each of these right ones."""
        out = np.zeros(len(rows), np.int64)
        mine, (starts, lengths) = self.of(i), self.of_right
        some = np.flatnonzero(lengths[rows])
        if not len(mine) or not len(some):
            return out
        self.flags[mine] = 1
        n = lengths[rows[some]]
        out[some] = np.add.reduceat(self.flags[self.codes[_ranges(starts[rows[some]], n)]], np.cumsum(n) - n, dtype=np.int64)
        self.flags[mine] = 0
        return out

    def holders(self) -> dict[int, np.ndarray]:
        """Right records that hold a code, in order."""
        starts, lengths = self.of_right
        codes, rows = self.codes[_ranges(starts, lengths)], np.repeat(np.arange(len(starts)), lengths)
        order = np.argsort(codes, kind="stable")
        kinds, first = np.unique(codes[order], return_index=True)
        return dict(zip(kinds.tolist(), np.split(rows[order], first[1:]), strict=True)) if len(kinds) else {}


def _first_of(ids: pa.Array) -> np.ndarray:
    """For each id the place of the first equal one."""
    codes = pc.fill_null(ids.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    _, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
    return first[inverse]


def _signatures(words: _Lists) -> np.ndarray:
    """A bit for each of the words that most right records of the cell hold, for left records and then right ones."""
    starts, lengths = words.of_right
    held = np.bincount(words.codes[_ranges(starts, lengths)], minlength=len(words.flags))
    common = np.argsort(-held, kind="stable")[:WORDS]
    place = np.full(len(held), -1)
    place[common] = np.arange(len(common))
    bits = np.zeros((len(words.starts), WORDS), bool)
    at, rows = place[words.codes], np.repeat(np.arange(len(words.starts)), words.lengths)
    bits[rows[at >= 0], at[at >= 0]] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def found(a: DataFrame, b: DataFrame, rare: DataFrame | None, brand_words: int, bits: tuple[int, int], arrays: tuple[str, ...] = (), plain: tuple[str, ...] = (), counted: bool = False) -> DataFrame:
    """(left, right, found): pairs of rare (left, right, found), which may repeat; of records with a common item (bits[0]); and of
    records with a common brand and at least brand_words common words (bits[1]). found is the union of bits of a pair.

    a and b hold (unique_id, brands, items, words), arrays without repeats. arrays and plain are further columns of theirs: a
    pair then has what scoring.pair_counts() gives of them. counted gives (left, right, found, n) instead: how many pairs of a
    left record have these bits, with a null right; and each right record that is in some pair, with a null left. A record has
    such rows from several cells.
    """
    size = lambda d: d.agg(F.coalesce(F.sum(sum((F.coalesce(F.length(F.array_join(c, " ")), F.lit(0)) for c in ("words", *arrays)), F.lit(64))), F.lit(0))).first()[0]
    down, across = (max(n, ceil(size(d) / CELL_CHARS)) for n, d in zip(PARTS, (a, b), strict=True))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = dict(a.dtypes)
    lists = ("brands", "items", "words", *arrays)

    def record(d: DataFrame, kind: int) -> DataFrame:
        row, column = (block(ID, down), every(across)) if kind == _LEFT else (every(down), block(ID, across))
        return d.select(row.alias("row"), column.alias("column"), F.lit(kind).alias("kind"), F.col(ID).alias("id"), F.lit(None).cast("array<string>").alias("others"), F.lit(0).alias("found"), *lists, *plain)

    rows = record(a, _LEFT).unionByName(record(b, _RIGHT))
    if rare is not None:
        nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in (*lists, *plain)]
        # A row for each left record of a cell: as rows of their own, pairs would take most of the time on their way to the task.
        met = rare.groupBy(block(LEFT, down).alias("row"), block(RIGHT, across).alias("column"), F.col(LEFT).alias("id"), "found").agg(F.collect_set(RIGHT).alias("others"))
        rows = rows.unionByName(met.select("row", "column", F.lit(_PAIR).alias("kind"), "id", "others", "found", *nothing))
    out = [f"{LEFT} string", f"{RIGHT} string", "found int", *(["n long"] if counted else [])]
    out += [f"{k}_{c} int" for c in arrays for k in "lrn"] + [f"{k}_{c} {kinds[c]}" for c in plain for k in "lr"]
    names = [x.split(" ")[0] for x in out]
    of_item, of_brand = bits

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        kind = t["kind"].to_numpy()
        pairs, left, right = (t.filter(pa.array(kind == k)) for k in (_PAIR, _LEFT, _RIGHT))
        del t
        if not len(left) or not len(right):
            return
        words, brands, items = (_Lists(left[c], right[c]) for c in ("words", "brands", "items"))
        features = {c: _Lists(left[c], right[c]) for c in arrays}
        each = pc.list_value_length(pairs["others"]).to_numpy().astype(np.int64)
        l, r = (pc.fill_null(pc.index_in(x, d["id"].combine_chunks()), -1).to_numpy(zero_copy_only=False).astype(np.int64) for x, d in ((pairs["id"].combine_chunks(), left), (pairs["others"].combine_chunks().flatten(), right)))
        l, f = np.repeat(l, each), np.repeat(pairs["found"].to_numpy().astype(np.uint8), each)
        known = (l >= 0) & (r >= 0)
        l, r, f = l[known], r[known], f[known]
        order = np.argsort(l, kind="stable")
        r, f = r[order], f[order]
        bounds = np.searchsorted(l[order], np.arange(len(left) + 1))
        del pairs, l, order
        mates, holders = brands.holders(), items.holders()
        signatures = _signatures(words)
        own, others = signatures[: len(left)], signatures[len(left) :]
        told_of = {k: others[rows] for k, rows in mates.items()}
        ids = left["id"].combine_chunks(), right["id"].combine_chunks()
        # Rows of one id are one record: the first of them stands for all.
        one_left, one_right = (_first_of(x) for x in ids)
        marks, reached = np.zeros(len(right), np.uint8), np.zeros(len(right), bool)
        some, size = [], 0

        def given():
            who, rows, marked = np.repeat([s[0] for s in some], [len(s[1]) for s in some]), np.concatenate([s[1] for s in some]), np.concatenate([s[2] for s in some])
            columns = [ids[0].take(pa.array(who)), ids[1].take(pa.array(rows)), pa.array(marked.astype(np.int32))]
            for k, c in enumerate(arrays):
                mine, theirs = features[c].sizes[who], features[c].sizes[len(left) + rows]
                shared = np.concatenate([s[3][k] for s in some])
                columns += [pa.array(x, pa.int32(), mask=m) for x, m in ((mine, mine < 0), (theirs, theirs < 0), (shared, (mine < 0) | (theirs < 0)))]
            columns += [d[c].combine_chunks().take(pa.array(x)) for c in plain for d, x in ((left, who), (right, rows))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        order = np.argsort(one_left, kind="stable")
        last = np.append(one_left[order][1:] != one_left[order][:-1], True)
        hit = False
        for i, whole in zip(order.tolist(), last.tolist(), strict=True):
            for code in items.of(i).tolist():
                if (rows := holders.get(code)) is not None:
                    marks[one_right[rows]] |= of_item
                    hit = True
            for code in brands.of(i).tolist():
                if (rows := mates.get(code)) is None:
                    continue
                told = np.bitwise_count(told_of[code] & own[i]).sum(axis=1) >= brand_words
                rest = rows[~told]
                rest = rest[words.shared(i, rest) >= brand_words] if len(rest) else rest
                marks[one_right[rows[told]]] |= of_brand
                marks[one_right[rest]] |= of_brand
                hit = True
            lo, hi = bounds[i], bounds[i + 1]
            if hi > lo:
                for bit in np.unique(f[lo:hi]):
                    marks[r[lo:hi][f[lo:hi] == bit]] |= bit
                hit = True
            if not hit or not whole:
                continue
            hit, i = False, int(one_left[i])
            rows = np.flatnonzero(marks)
            marked = marks[rows]
            marks[rows] = 0
            if not len(rows):
                continue
            if counted:
                reached[rows] = True
                numbers = np.bincount(marked)
                some += [(i, k, numbers[k]) for k in np.flatnonzero(numbers)]
                continue
            for at in range(0, len(rows), SLICE):
                part = rows[at : at + SLICE]
                some.append((i, part, marked[at : at + SLICE], [features[c].shared(i, part) for c in arrays]))
                size += len(part)
                if size >= SLICE:
                    yield given()
                    some, size = [], 0
        if counted:
            who, k, n = (np.array([s[j] for s in some], np.int64) for j in range(3))
            hit = np.flatnonzero(reached)
            none = lambda size, kind: pa.nulls(size, kind)
            columns = [[ids[0].take(pa.array(who)), none(len(who), pa.string()), pa.array(k, pa.int32()), pa.array(n)], [none(len(hit), pa.string()), ids[1].take(pa.array(hit)), none(len(hit), pa.int32()), none(len(hit), pa.int64())]]
            for c in columns:
                yield pa.RecordBatch.from_arrays([x.cast(kind) for x, kind in zip(c, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=names)
        elif some:
            yield given()

    spark = a.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, down * across)
    return rows.repartition(parts, "row", "column").groupBy("row", "column").applyInArrow(compare, ", ".join(out))
