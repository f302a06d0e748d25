"""Removing repeated byte strings: suffix-array dedup by bucket-pointer refinement.

Suffixes start in buckets of equal q-grams. A bucket is refined by sorting on the identifiers of the buckets that its
members reach further on; the identifiers that come of it are written back, and the next refinement, twice as deep, reads
them, until buckets stand for ``length`` bytes. Members alone in a bucket drop out, with all that would point at them.
Whatever is removed is a member of a last bucket other than its first.

Anchors (see anchors) keep this to suffixes that can share a bucket. Three steps use the same refinement:

1. Every part refines the contexts of anchors that it holds twice. A context of which all windows repeat goes no further,
   so a passage in a third of all rows is one entry of each part afterwards.
2. What is left is grouped by anchor. Equal contexts are one context with several members: its text is fetched once, and
   its suffixes count as often as it has members.
3. Groups refine the contexts of each shared anchor; covered ranges go to their texts.

An anchor with more than HEAVY different contexts (a stock phrase) is too large a batch. Its buckets are spread over
groups: each part refines its own contexts of it and sends those members that are first there, with the name of their last
bucket. Names come of the same refinement, with hashes that tasks agree on in place of numbers. The first of all members stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import BATCH_BYTES, ROWS, Dealt, Kind, arrow, batches_by, contexts, frame, merged, new_among, rows_of, runs_by_row, sorted_once
from .common import release, sheltered, slices, table, unpack, with_rid
from .hashing import BYTE_CODES, mix, prefix, span

LENGTH, GRAM, SEGMENT = 100, 32, 1 << 20
#: Contexts of an anchor that are resolved together at most.
HEAVY = 1 << 14
ENTRY, COVERED, REQUEST, MEMBER, CONTEXT, BUCKET = range(6)
_ENTRY = ("<u4", "<u8", "<i8", "<i4", "<u2")
_RANGE = ("<i8", "<i4", "<i4")
_WANTED = ("<u4", "<u4", "<i8", "<i4", "<u2", "u1")
_MEMBER = ("<u4", "<i8", "<i4")
_LAST = ("<u8", "<i8", "<i4")


def _codes(length: int, gram: int):
    def codes(block):
        parts, rid, begin, total, low, high = [], [], [], [], [], []
        at = 0
        for r, text in block:
            n = len(text)
            for s in range(0, max(1, n), SEGMENT):
                lo, hi = max(0, s - (length - gram)), min(n, s + SEGMENT + 2 * length)
                parts.append(text[lo:hi])
                rid.append(r)
                begin.append(lo)
                total.append(n)
                low.append(at + s - lo)
                high.append(at + max(s, min(s + SEGMENT, n - length + 1)) - lo)
                at += hi - lo
        offset = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1].astype(np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        return (BYTE_CODES[data], offset, *(np.array(x, np.int64) for x in (rid, begin, total, low, high)))

    return codes


def _cut(text: bytes, low: np.ndarray, high: np.ndarray) -> list[bytes]:
    return [text[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]


def refine(ids: np.ndarray, places: np.ndarray, room: np.ndarray, times: np.ndarray, depth: int, length: int) -> np.ndarray:
    """Places whose buckets of ``length`` bytes have several members; ids[place] becomes that bucket (else -1).

    ids holds buckets of depth bytes, -1 where a place is alone. A place is its own bucket with the bucket ``step`` bytes
    on, which together reach depth + step bytes; the new identifiers are written to ids and refined in turn. times says
    how often each place counts, room how many bytes follow it in its context.
    """
    if depth >= length or not len(places):
        return places
    step = min(depth, length - depth)
    places = places[room[places] >= depth + step]
    places = places[ids[places + step] >= 0]
    key = ids[places] * np.int64(len(ids)) + ids[places + step]
    _, bucket = np.unique(key, return_inverse=True)
    shared = np.bincount(bucket, times[places])[bucket] > 1 if len(places) else np.empty(0, bool)
    ids.fill(-1)
    ids[places[shared]] = bucket[shared]
    return refine(ids, places[shared], room, times, depth + step, length)


def deepen(names: np.ndarray, depth: int, length: int) -> np.ndarray:
    """The refinement of all places with names that tasks agree on: a hash of both bucket names in place of a number."""
    if depth >= length:
        return names
    step = min(depth, length - depth)
    return deepen(mix(names[:-step] * np.uint64(0x9E3779B97F4A7C15) + names[step:]), depth + step, length)


def later(bucket: np.ndarray, rid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each member of a bucket is another place than the bucket's first (by row key, then start)."""
    order = np.lexsort((start, rid, bucket))
    b, r, s = bucket[order], rid[order], start[order]
    first = np.flatnonzero(new_among(b))[np.cumsum(new_among(b)) - 1] if len(b) else np.empty(0, np.int64)
    out = np.empty(len(b), bool)
    out[order] = (r != r[first]) | (s != s[first])
    return out


def repeated(payloads: list[bytes], owner: np.ndarray, rid: np.ndarray, low: np.ndarray, length: int):
    """What repeats in contexts: (row keys, starts, ends) of covered ranges, and the members of which all windows repeat.

    Member m is the context payloads[owner[m]] of row rid[m] from byte low[m]. Members of a context are different places,
    sorted; every context has one.
    """
    q = -(-length // 4)
    data, sizes = np.frombuffer(b"".join(payloads), np.uint8), np.array([len(p) for p in payloads], np.int64)
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(payloads)), sizes)
    offset = np.arange(len(data)) - (ends - sizes)[of]
    room = sizes[of] - offset
    times = np.bincount(owner, minlength=len(payloads))[of]
    places = np.flatnonzero(room >= q)
    _, bucket = np.unique(span(prefix(BYTE_CODES[data]), places, places + q), return_inverse=True)
    shared = np.bincount(bucket, times[places])[bucket] > 1 if len(places) else np.empty(0, bool)
    ids = np.full(len(data) + length, -1, np.int64)
    ids[places[shared]] = bucket[shared]
    places = np.sort(refine(ids, places[shared], room, times, q, length))
    order = np.argsort(owner, kind="stable")
    lead = order[np.searchsorted(owner[order], np.arange(len(payloads)))]
    mine, start = lead[of[places]], low[lead[of[places]]] + offset[places]
    over = later(ids[places], rid[mine], start)
    windows = np.maximum(sizes - length + 1, 0)
    # Other members than the lead repeat wherever a place of their context is left.
    edge = new_among(of[places], offset[places] - np.arange(len(places)))
    run, until = np.flatnonzero(edge), np.append(np.flatnonzero(edge)[1:], len(places)) - 1
    copies = np.ones(len(owner), bool)
    copies[lead] = False
    copies = np.flatnonzero(copies)
    per = np.bincount(of[places[run]], minlength=len(payloads)) if len(run) else np.zeros(len(payloads), np.int64)
    base = np.cumsum(per) - per
    many = per[owner[copies]]
    which = np.repeat(base[owner[copies]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    who = np.repeat(copies, many)
    r = np.concatenate([rid[mine[over]], rid[who]])
    s = np.concatenate([start[over], low[who] + (offset[places[run[which]]] if len(which) else 0)])
    e = np.concatenate([start[over] + length, low[who] + (offset[places[until[which]]] + length if len(which) else 0)])
    left, gone = np.bincount(of[places], minlength=len(payloads)), np.bincount(of[places[over]], minlength=len(payloads))
    whole = (left == windows)[owner] & (windows > 0)[owner]
    whole[lead] = (gone == windows) & (windows > 0)
    return merged(r, s, e), whole


def kind(length: int = LENGTH, gram: int = GRAM) -> Kind:
    if length < 4 or gram > length:
        raise ValueError("length must be 4 or more and not below gram")
    return Kind(length, gram, _codes(length, gram), _cut)


def _several(h: np.ndarray) -> np.ndarray:
    """Whether each entry (sorted by h) shares its anchor with another one."""
    run = np.cumsum(new_among(h)) - 1
    return (np.bincount(run) > 1)[run] if len(h) else np.empty(0, bool)


def _spans(docs: DataFrame, length: int, finish, schema: str, carry: list[str], part_bytes: int = 8 << 20, heavy: int = HEAVY) -> DataFrame:
    """The columns ``carry`` and those of finish(text, covered byte ranges) of every row of docs (RID unique, text)."""
    k = kind(length, min(GRAM, length))
    dealt = Dealt(docs, carry, part_bytes)
    parts = dealt.parts

    def covered(rid, start, end) -> list[tuple]:
        rid, start, end = merged(rid, start, end)
        return rows_of(COVERED, np.mod(rid, parts), (rid, start, end), _RANGE)

    def members(h, c, rid, low, n, text_of):
        """Batches of (payloads, owner, indexes of entries) of sorted entries; a batch never parts a context."""
        new = new_among(h, c)
        number, first = np.cumsum(new) - 1, np.flatnonzero(new)
        cuts = np.flatnonzero(np.diff(np.cumsum(n[first]) // BATCH_BYTES)) + 1
        for batch in np.split(np.arange(len(first)), cuts):
            if len(batch):
                payloads = [text_of[int(r)][a : a + b] for r, a, b in zip(rid[first[batch]], low[first[batch]].tolist(), n[first[batch]].tolist(), strict=True)]
                some = np.arange(first[batch[0]], first[batch[-1] + 1] if batch[-1] + 1 < len(first) else len(h))
                yield payloads, number[some] - batch[0], some

    def collect(d: pa.Table) -> pa.Table:
        text_of = {r: (x or "").encode() for r, x in zip(d["rid"].to_pylist(), d["text"].to_pylist(), strict=True)}
        h, c, rid, low, n = contexts(k, list(text_of), list(text_of.values()))
        out, stay, shared = [], np.ones(len(h), bool), np.flatnonzero(_several(h))
        for payloads, owner, some in members(h[shared], c[shared], rid[shared], low[shared], n[shared], text_of):
            ranges, whole = repeated(payloads, owner, rid[shared[some]], low[shared[some]], length)
            out += covered(*ranges)
            stay[shared[some]] = ~whole
        group = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)[stay]
        out += rows_of(ENTRY, group, tuple(x[stay] for x in (h & np.uint64(0xFFFFFFFF), c, rid, low, n)), _ENTRY)
        release()
        return arrow(out)

    def through(t: pd.DataFrame) -> list[tuple]:
        gone = t.blob[t.kind == COVERED]
        return covered(*unpack(gone, *_RANGE)) if len(gone) else []

    def decide(t: pd.DataFrame) -> pd.DataFrame:
        out, mine = through(t), t[t.kind == ENTRY]
        for key, blobs in mine.groupby("key").blob:
            h, c, rid, low, n = sorted_once(*unpack(blobs, *_ENTRY))
            some = _several(h)
            h, c, rid, low, n = (x[some] for x in (h, c, rid, low, n))
            new = new_among(h, c)
            cls, anchor = np.cumsum(new) - 1, np.cumsum(new_among(h)) - 1
            many = (np.bincount(anchor, new) > heavy)[anchor] if len(h) else new
            ask = new | many
            for p, i in slices(np.mod(rid[ask], parts)):
                fields = tuple(x[ask][i].astype(kind_) for x, kind_ in zip((h, cls, rid, low, n, many), _WANTED, strict=True))
                out.append((REQUEST, int(p), b"".join(np.ascontiguousarray(f).tobytes() for f in fields) + np.int64(key).tobytes(), None))
            if (~ask).any():
                out += rows_of(MEMBER, np.full((~ask).sum(), key), (cls[~ask], rid[~ask], low[~ask]), _MEMBER)
        return frame(out)

    def fetch(d: pa.Table, found: pa.Table) -> pa.Table:
        t = found.to_pandas()
        out, asked = through(t), t.blob[t.kind == REQUEST]
        out += [(MEMBER, int(key), blob, None) for key, blob in zip(t["key"][t.kind == MEMBER], t.blob[t.kind == MEMBER], strict=True)]
        if not len(asked):
            return arrow(out)
        width = sum(np.dtype(x).itemsize for x in _WANTED)
        groups = np.concatenate([np.full((len(b) - 8) // width, int(np.frombuffer(b[-8:], np.int64)[0])) for b in asked])
        h, cls, rid, low, n, many = unpack([b[:-8] for b in asked], *_WANTED)
        wanted = set(rid.tolist())
        text_of = {r: (x or "").encode() for r, x in zip(d["rid"].to_pylist(), d["text"].to_pylist(), strict=True) if r in wanted}
        low, n = low.astype(np.int64), n.astype(np.int64)
        for g, at in slices(groups[many == 0]):
            at = np.flatnonzero(many == 0)[at]
            payloads = [text_of[int(r)][a : a + b] for r, a, b in zip(rid[at], low[at].tolist(), n[at].tolist(), strict=True)]
            fields = (cls[at].astype("<u4"), h[at].astype("<u4"), rid[at].astype("<i8"), low[at].astype("<i4"), n[at].astype("<u2"))
            out.append((CONTEXT, int(g), b"".join(np.ascontiguousarray(f).tobytes() for f in fields), b"".join(payloads)))
        if many.any():
            out += spread(np.flatnonzero(many), rid, low, n, text_of)
        release()
        return arrow(out)

    def spread(at, rid, low, n, text_of) -> list[tuple]:
        """Covered ranges, and the last buckets of members that are first in this part, of contexts of heavy anchors."""
        out, held = [], []
        for some in np.split(at, np.flatnonzero(np.diff(np.cumsum(n[at]) // BATCH_BYTES)) + 1):
            if not len(some):
                continue
            payloads = [text_of[int(r)][a : a + b] for r, a, b in zip(rid[some], low[some].tolist(), n[some].tolist(), strict=True)]
            ranges, whole = repeated(payloads, np.arange(len(some)), rid[some], low[some], length)
            out += covered(*ranges)
            some = some[~whole]
            data = b"".join(p for p, w in zip(payloads, whole, strict=True) if not w)
            windows, begin = np.maximum(n[some] - length + 1, 0), np.cumsum(n[some]) - n[some]
            place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            at_byte = np.repeat(begin, windows) + place
            sums = prefix(BYTE_CODES[np.frombuffer(data, np.uint8)])
            q = -(-length // 4)
            starts = np.arange(max(0, len(data) - q + 1))
            bucket = deepen(span(sums, starts, starts + q), q, length)[at_byte] if len(at_byte) else np.empty(0, np.uint64)
            held.append((bucket, np.repeat(rid[some], windows), np.repeat(low[some], windows) + place))
        bucket, r, s = (np.concatenate(x) for x in zip(*held, strict=True))
        over = later(bucket, r, s)
        out += covered(r[over], s[over], s[over] + length)
        new = new_among(*(first := sorted_once(bucket[~over], r[~over], s[~over], r[~over]))[:1])
        bucket, r, s = (x[new] for x in first[:3])
        return out + rows_of(BUCKET, ((bucket >> np.uint64(17)) % np.uint64(parts)).astype(np.int64), (bucket, r, s), _LAST)

    def resolve(t: pd.DataFrame) -> pd.DataFrame:
        out, last = through(t), t.blob[t.kind == BUCKET]
        if len(last):
            bucket, r, s = unpack(last, *_LAST)
            over, s = later(bucket, r, s.astype(np.int64)), s.astype(np.int64)
            out += covered(r[over], s[over], s[over] + length)
        some = t[t.kind == CONTEXT]
        if len(some):
            cls, h, rid, low, n = unpack(some.blob, "<u4", "<u4", "<i8", "<i4", "<u2")
            copy, copy_rid, copy_low = unpack(t.blob[t.kind == MEMBER], *_MEMBER)
            order = np.argsort(copy, kind="stable")
            copy, copy_rid, copy_low = copy[order], copy_rid[order], copy_low[order].astype(np.int64)
            whole, end = b"".join(some.payload), np.cumsum(n.astype(np.int64))
            for at in batches_by(h, n):
                payloads = [whole[e - m : e] for e, m in zip(end[at].tolist(), n[at].tolist(), strict=True)]
                lo, hi = np.searchsorted(copy, cls[at]), np.searchsorted(copy, cls[at], "right")
                more = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                owner = np.concatenate([np.arange(len(at)), np.repeat(np.arange(len(at)), hi - lo)])
                ranges, _ = repeated(payloads, owner, np.concatenate([rid[at], copy_rid[more]]), np.concatenate([low[at].astype(np.int64), copy_low[more]]), length)
                out += covered(*ranges)
        release()
        return frame(out)

    def results(rids, texts, found: pa.Table) -> list[tuple]:
        runs = runs_by_row(*(x.astype(np.int64) for x in unpack(found["blob"].to_pylist(), *_RANGE)))
        return [finish(x, runs.get(r, [])) for r, x in zip(rids, texts, strict=True)]

    found = dealt.texts.applyInArrow(collect, ROWS)
    found = dealt.grouped(found).applyInPandas(decide, ROWS)
    found = dealt.texts.cogroup(dealt.grouped(found)).applyInArrow(fetch, ROWS)
    found = dealt.grouped(found).applyInPandas(resolve, ROWS)
    return dealt.finish(found, schema, results)


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of text behind and between runs."""
    out, at = [], 0
    for s, e in runs:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows of docs with text free of bytes in strings of ``length`` bytes that start earlier in the corpus.

    Order is by doc_id (null first; rows that repeat one by a hash of text), then by place. Where a cut splits a character,
    its remaining bytes go too. A null text stays null; n_chars, if present, follows the text. Other columns stay.
    """
    inner, back = sheltered(docs, ("doc_id", "text", "n_chars"))

    def kept(text, runs):
        return (None if text is None else without(text, runs).decode("utf-8", "ignore"),)

    out = _spans(with_rid(inner, "doc_id", "text"), length, kept, "text string", [c for c in inner.columns if c != "text"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back(out)


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and removed, array<struct<start, end>> in bytes, of each row of docs: what remove_repeats() takes out."""

    def row(text, runs):
        return ([{"start": s, "end": e} for s, e in runs],)

    return _spans(with_rid(docs, "doc_id", "text"), length, row, "removed array<struct<start:bigint,end:bigint>>", ["doc_id"])


def digests(docs: DataFrame, length: int = LENGTH, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs (RID unique)."""

    def row(text, runs):
        text = text or b""
        return len(text), sum(e - s for s, e in runs), len(runs), hashlib.sha256(without(text, runs)).hexdigest()

    return _spans(docs, length, row, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["doc_id"], **limits)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of each document. Null texts count as empty; rows that repeat or lack a doc_id are ordered by a hash of text."""
    return digests(with_rid(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text"))
