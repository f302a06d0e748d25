"""Anchors: the few places of texts by which tasks find windows that repeat, and how texts and findings are dealt out.

A text is a sequence of tokens (bytes or words). In every window of ``window`` tokens the n-gram with the least hash is
an anchor. Equal windows have equal anchors at equal offsets, so only texts that share an anchor can share a window, and
one token in about (window - gram) / 2 is an anchor. The context of an anchor holds all windows around it, or only those
whose anchor it is.

Texts lie in parts of bounded size, dealt by row key; anchors lie in groups, dealt by hash. There are as many groups as
parts, and as many tasks: their number follows the size of the corpus. Arrays travel packed in binary values. Anchors
only say where to look; what repeats is for the operators to find.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import RID, modest_batches, pack, parts_for, slices
from .hashing import _powers, blocks, mix, prefix, span

ROWS = "kind int, key long, blob binary, payload binary"
_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("blob", pa.binary()), ("payload", pa.binary())])
BLOCK_BYTES, BATCH_BYTES = 1 << 18, 1 << 19


@dataclass(frozen=True)
class Kind:
    """What tokens are."""

    window: int
    gram: int
    #: (texts with row keys) -> codes, offset of each piece, row key, first token and all tokens of its text, and the
    #: range of window starts (in codes) that the piece answers for.
    codes: Callable[[list[tuple[int, bytes]]], tuple]
    #: (text, first tokens, last tokens) -> payload of each context.
    cut: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]]
    #: Whether contexts hold only the windows whose anchor theirs is.
    own: bool = False


def _slide(a: np.ndarray, width: int, reduce) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = reduce(a[:-size], a[size:])
        size *= 2
    return a if size == width else reduce(a[: -(width - size)], a[width - size :])


def anchors(codes: np.ndarray, low: np.ndarray, high: np.ndarray, window: int, gram: int):
    """(places of anchors, their hashes, prefix sums, a function for how far before each the first and the last of its windows start).

    Window starts from low to high (exclusive) of each piece count.
    """
    sums = prefix(codes)
    if len(codes) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64), sums, lambda: (np.empty(0, np.int64), np.empty(0, np.int64))
    hashes = mix((sums[gram:] - sums[:-gram]) * _powers("down", len(sums))[: len(codes) - gram + 1])
    order = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    width = window - gram + 1
    least = _slide(order, width, np.minimum)
    edge = np.zeros(len(least) + 1, np.int32)
    some = high > low
    np.add.at(edge, low[some], 1)
    np.add.at(edge, high[some], -1)
    least = np.where(np.cumsum(edge[:-1]) > 0, least, np.uint32(0))
    pad = np.zeros(width - 1, np.uint32)
    chosen = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == order)

    def reach():
        start = chosen[:, None] - np.arange(width)
        own = (least[np.clip(start, 0, len(least) - 1)] == order[chosen][:, None]) & (start >= 0) & (start < len(least))
        return width - 1 - own[:, ::-1].argmax(axis=1), own.argmax(axis=1)

    return chosen, hashes[chosen], sums, reach


def contexts(kind: Kind, rids: list[int], texts: list[bytes]):
    """(anchor hash, context hash, row key, first token and number of tokens of the context) of the anchors of texts.

    Sorted, and each once: two anchors of a short text can have all of it as context.
    """
    held = []
    for block in blocks(zip(rids, texts, strict=True), lambda x: len(x[1]), BLOCK_BYTES):
        codes, offset, rid, begin, total, low, high = kind.codes(block)
        at, h, sums, reach = anchors(codes, low, high, kind.window, kind.gram)
        piece = np.searchsorted(offset, at, "right") - 1
        pos = at - offset[piece] + begin[piece]
        if kind.own:
            left, last = reach()
            right = kind.window - last
        else:
            left, right = np.minimum(kind.window - kind.gram, pos), np.minimum(kind.window, total[piece] - pos)
        held.append((h, span(sums, at - left, at + right), rid[piece], pos - left, left + right))
    if not held:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    fields = tuple(np.concatenate(x) for x in zip(*held, strict=True))
    return sorted_once(*fields)


def sorted_once(*fields: np.ndarray) -> tuple[np.ndarray, ...]:
    """Fields sorted by the first, then the second and so on, equal entries (in the first four) once."""
    order = np.lexsort(fields[3::-1])
    fields = tuple(x[order] for x in fields)
    return tuple(x[new_among(*fields[:4])] for x in fields)


def new_among(*fields: np.ndarray) -> np.ndarray:
    """Whether each entry differs from the one before it."""
    out = np.ones(len(fields[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([f[1:] != f[:-1] for f in fields])
    return out


def merged(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs that ranges cover in each text."""
    if not len(rid):
        return rid, start, end
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order].astype(np.int64), end[order].astype(np.int64)
    shift = np.cumsum(np.concatenate([[0], (rid[1:] != rid[:-1]).astype(np.int64)])) << 36
    reach = np.maximum.accumulate(end + shift)
    first = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(rid) - 1]])
    return rid[first], start[first], reach[last] - shift[last]


def runs_by_row(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    for r, s, e in zip(*(x.tolist() for x in merged(rid, start, end)), strict=True):
        out.setdefault(r, []).append((s, e))
    return out


def rows_of(kind: int, keys: np.ndarray, fields: tuple, dtypes: tuple) -> list[tuple]:
    return [(kind, int(k), pack(*[f[i].astype(t) for f, t in zip(fields, dtypes, strict=True)]), None) for k, i in slices(keys)]


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "key", "blob", "payload"])


def arrow(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], _ARROW)


def batches_by(h: np.ndarray, n: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[np.ndarray]:
    """Indexes in batches of about limit tokens that never part entries of one anchor."""
    order = np.argsort(h, kind="stable")
    total, new = np.cumsum(n[order].astype(np.int64)), np.flatnonzero(new_among(h[order]))[1:]
    cuts, last = [], 0
    for c in new.tolist():
        if total[c - 1] - last >= limit:
            cuts.append(c)
            last = total[c - 1]
    yield from (x for x in np.split(order, cuts) if len(x))


class Dealt:
    """docs (RID unique, text, columns to carry) in parts: column key; each part is one group, moved to its task once."""

    def __init__(self, docs: DataFrame, carry: list[str], part_bytes: int):
        size = modest_batches(docs).agg(F.sum(F.octet_length("text"))).first()[0]
        self.parts, self.carry = parts_for(size, part_bytes), carry
        self._types = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
        texts = docs.select(F.pmod(F.col(RID), F.lit(self.parts)).cast("long").alias("key"), F.col(RID).alias("rid"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
        self.texts = texts.repartition(self.parts, "key").groupBy("key")

    def grouped(self, rows: DataFrame):
        """rows by key, in as many tasks as there are parts."""
        return rows.repartition(self.parts, "key").groupBy("key")

    def finish(self, rows: DataFrame, schema: str, results: Callable[[list, list, pa.Table], list[tuple]]) -> DataFrame:
        """The carried columns and those of results(row keys, texts as bytes, the part's rows) of every row."""
        own = T.StructType.fromDDL(schema)
        fields, types, carried = T.StructType([*self._types, *own.fields]), [to_arrow_type(f.dataType) for f in own], len(self.carry)

        def last(d: pa.Table, found: pa.Table) -> pa.Table:
            out = results(d["rid"].to_pylist(), [None if x is None else x.encode() for x in d["text"].to_pylist()], found)
            columns = list(zip(*out, strict=True)) or [[]] * len(types)
            made = [pa.array(list(x), t) for x, t in zip(columns, types, strict=True)]
            return pa.Table.from_arrays([*[d[f"c{i}"].combine_chunks() for i in range(carried)], *made], names=[f.name for f in fields])

        done = self.texts.cogroup(self.grouped(rows)).applyInArrow(last, fields)
        return done.toDF(*self.carry, *[f.name for f in own])
