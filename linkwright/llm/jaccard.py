"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal shingle sets form a class at once; only one document of a class goes on. MinHash bands bring
classes into buckets (of pairs at the threshold, a band misses (1 - 0.8^5)^36 = 6e-7 if MinHash values were independent).
The pairs of a bucket compare some MinHash values and are dropped where the posterior probability that their similarity
reaches the threshold is below the tolerance; those left join documents into clusters. Within a cluster, pairs compare
their values a slice at a time, with the same rule after each, and the shingle sets of all others are compared exactly.
Pairs are counted where they are found and never leave their task.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RID, checkpoint, modest_batches, pack, parts_for, release, releasing, sheltered, slices, table, unpack, with_rid
from .components import components, forest, local_forest
from .hashing import ALNUM_BYTE, blocks, mix, prefix, span, words_of

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, SLICE = 36, 5, 20
#: Documents in one side of a unit of work.
BLOCK = 512
#: Members of a bucket that are compared with each other at most (beyond that the bucket is joined as it is, and its pairs
#: are compared in their cluster), and members that a batch sends of a bucket.
BUCKET, SENT = 1024, 64
_RANDOM = np.random.default_rng(914)
_FACTORS = _RANDOM.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of all runs of ``words`` lower-cased words (letters, digits, _ and non-ASCII bytes).

    A text with fewer words has one shingle of all its words; one without words has none.
    """
    hashes, first, _, _ = words_of([(x or "").lower().encode() for x in texts], ALNUM_BYTE)
    sums = prefix(hashes)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            start = np.arange(a, b - words + 1)
            out.append(np.unique(span(sums, start, start + words)))
        else:
            out.append(span(sums, np.array([a]), np.array([b])) if b > a else np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row for each set; sets must not be empty."""
    out = np.empty((len(sets), len(_FACTORS)), np.uint32)
    done = 0
    for block in blocks(sets, len, 1 << 16):
        flat = (np.concatenate(block) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in block])])[:-1]
        for j, (a, b) in enumerate(zip(_FACTORS, _TERMS, strict=True)):
            out[done : done + len(block), j] = np.minimum.reduceat(flat * a + b, starts)
        done += len(block)
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    key = np.zeros((len(sigs), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, r::ROWS])
    return key


@lru_cache(maxsize=16)
def least_matches(seen: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values among ``seen`` that leave a pair in.

    Under a uniform prior the similarity has a Beta(m + 1, seen - m + 1) posterior; it reaches t with probability
    P(Binomial(seen + 1, t) <= m).
    """
    total = 0.0
    for m in range(seen + 1):
        total += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if total >= tolerance:
            return m
    return seen


def still_possible(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float):
    """The pairs (i, j) that are left when the MinHash values a[i] and b[j] have been compared, a slice at a time.

    Values may be cut to their last byte: that makes one in 256 different values equal, and so drops no more pairs.
    """
    matches = np.zeros(len(i), np.int64)
    for s in range(0, a.shape[1], SLICE):
        if not len(i):
            break
        matches += (a[i, s : s + SLICE] == b[j, s : s + SLICE]).sum(axis=1)
        keep = matches >= least_matches(min(s + SLICE, a.shape[1]), threshold, tolerance)
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a[i] and b[j]."""
    rows, cols = np.unique(i), np.unique(j)
    if len(i) > 4 * (len(rows) + len(cols)):
        flat = np.concatenate([*(a[x] for x in rows), *(b[x] for x in cols)])
        vocabulary, place = np.unique(flat, return_inverse=True)
        size = [len(a[x]) for x in rows] + [len(b[x]) for x in cols]
        owner = np.repeat(np.arange(len(size)), size)
        both = np.zeros((len(rows), len(cols)), np.float32)
        for lo in range(0, len(vocabulary), 8192):
            inside = (place >= lo) & (place < lo + 8192)
            grid = np.zeros((len(size), min(8192, len(vocabulary) - lo)), np.float32)
            grid[owner[inside], place[inside] - lo] = 1
            both += grid[: len(rows)] @ grid[len(rows) :].T
        return both[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)
    return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)


def similar(a: list[np.ndarray], b: list[np.ndarray], sig_a: np.ndarray, sig_b: np.ndarray, threshold: float, tolerance: float, within: bool):
    """(i, j) arrays of the pairs of a and b at the threshold or above; with ``within``, a is b and i < j."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    step = max(1, 200_000 // max(1, len(b)))
    for lo in range(0, len(a), step):
        ratio = np.minimum(na[lo : lo + step, None], nb[None, :]) >= threshold * np.maximum(na[lo : lo + step, None], nb[None, :]) - 1e-9
        i, j = np.nonzero(ratio)
        i += lo
        if within:
            i, j = i[i < j], j[i < j]
        i, j = still_possible(sig_a, sig_b, i, j, threshold, tolerance)
        if len(i):
            shared = _overlaps(a, b, i, j)
            link = shared / (na[i] + nb[j] - shared) >= threshold
            if link.any():
                yield i[link], j[link]


def _link_group(rid, copies, sides, sets, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row keys with links, weighted number of links, smallest row key joined to each) of one unit."""
    order = np.argsort(rid, kind="stable")
    rid, copies, sides, sets = rid[order], copies[order], sides[order], [sets[k] for k in order]
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    within = not len(right)
    right = left if within else right
    sig = signatures(sets)
    count, links = np.zeros(len(rid), np.int64), []
    for i, j in similar([sets[k] for k in left], [sets[k] for k in right], sig[left], sig[right], threshold, tolerance, within):
        i, j = left[i], right[j]
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        cuts = np.flatnonzero(np.diff(i)) + 1
        links += [(int(x[0]), y) for x, y in zip(np.split(i, cuts), np.split(j, cuts), strict=True)]
    label = local_forest(len(rid), links)
    some = count > 0
    return rid[some], count[some], rid[label[some]]


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(rid, class_rid, n_links, component) of each row of docs (RID unique, text).

    Links are pairs of rows whose shingle sets have a Jaccard similarity of threshold or more; equal sets link. A class
    holds the rows with one set, a component those that links reach; both are named by their smallest row key. Rows
    without a word (null and empty texts) link with nothing.
    """
    texts = modest_batches(docs).select(F.col(RID).alias("rid"), F.col("text").cast("string").alias("text"))

    def sketch(batches):
        for t in batches:
            for rows in blocks(list(zip(t.rid, t.text, strict=True)), lambda x: len(x[1] or ""), 1 << 19):
                sets = shingle_sets([x for _, x in rows], words)
                full = [k for k, s in enumerate(sets) if len(s)]
                sigs = signatures([sets[k] for k in full]) if full else np.empty((0, BANDS * ROWS), np.uint32)
                bands = dict(zip(full, band_keys(sigs), strict=True))
                short = dict(zip(full, sigs.astype(np.uint8), strict=True))
                key = [(int(mix(s.copy()).sum().view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))) if len(s) else (0, int(r)) for s, (r, _) in zip(sets, rows, strict=True)]
                yield pd.DataFrame({"rid": [r for r, _ in rows], "n": [len(s) for s in sets], "k1": [k for k, _ in key], "k2": [k for _, k in key], "bands": [pack(bands[k]) if k in bands else None for k in range(len(rows))], "short": [pack(short[k]) if k in short else None for k in range(len(rows))]})

    sketched = checkpoint(texts.mapInPandas(releasing(sketch), "rid long, n long, k1 long, k2 long, bands binary, short binary"))
    classes = checkpoint(sketched.groupBy("n", "k1", "k2").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"), F.min_by(F.struct("bands", "short"), "rid").alias("s")).select("n", "k1", "k2", "rep", "copies", "s.bands", "s.short"))
    parts = parts_for(classes.count(), 1 << 14)

    def runs(band: np.ndarray, rid: np.ndarray):
        """band and rid sorted, and for each entry the size and the place of the first of its band."""
        order = np.lexsort((rid, band))
        band, rid = band[order], rid[order]
        first = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]])) if len(band) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(band)))
        return band, rid, np.repeat(size, size), np.repeat(first, size)

    def stars(rid: np.ndarray, first: np.ndarray, some: np.ndarray) -> np.ndarray:
        """(member, first member) of the entries some, but those of the first itself."""
        pairs = np.stack([rid[some], rid[first[some]]])
        return np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)

    def spread(batches):
        for t in batches:
            t = t[t.bands.notna()]
            if len(t):
                band, rid, size, first = runs(unpack(t.bands, np.uint64)[0], np.repeat(t.rep.to_numpy(), BANDS))
                large = size > SENT
                edges = stars(rid, first, large)
                yield pd.DataFrame([(k, 1, pack(*edges[:, x])) for k, x in slices(edges[0] % parts)], columns=["key", "kind", "blob"])
                stay = ~large | (first == np.arange(len(band)))
                band, rid = band[stay], rid[stay]
                group = ((band >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                yield pd.DataFrame([(k, 0, pack(band[x], rid[x])) for k, x in slices(group)], columns=["key", "kind", "blob"])

    def met(t: pd.DataFrame) -> pd.DataFrame:
        """Members (kind 0: bucket, row) of shared buckets, and pairs (kind 1) that join large ones."""
        band, rid, size, first = runs(*unpack(t.blob[t.kind == 0], np.uint64, np.int64))
        some = (size > 1) & (size <= BUCKET)
        pairs = np.concatenate([stars(rid, first, size > BUCKET), np.stack(unpack(t.blob[t.kind == 1], np.int64, np.int64))], axis=1)
        release()
        return pd.DataFrame({"kind": np.repeat([0, 1], [some.sum(), pairs.shape[1]]), "u": np.concatenate([band[some].view(np.int64), pairs[0]]), "v": np.concatenate([rid[some], pairs[1]])})

    def compared(t: pd.DataFrame) -> pd.DataFrame:
        """Members of buckets joined by pairs that may reach the threshold, with the smallest member that they reach."""
        short = np.frombuffer(b"".join(t.short), np.uint8).reshape(len(t), BANDS * ROWS)
        rid, bucket = t.v.to_numpy(), t.u.to_numpy()
        order = np.lexsort((rid, bucket))
        size = np.diff(np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]])))
        after = np.repeat(size, size) - 1 - (np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size))
        edges = [np.empty((2, 0), np.int64)]
        for some in np.split(np.arange(len(order)), np.flatnonzero(np.diff(np.cumsum(after) // 100_000)) + 1):
            i = np.repeat(some, after[some])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[some]) - after[some], after[some])
            i, j = order[i], order[j]
            i, j = still_possible(short, short, i, j, threshold, tolerance)
            edges.append(forest(rid[i], rid[j]))
        edges = forest(*np.concatenate(edges, axis=1))
        release()
        return pd.DataFrame({"u": edges[0], "v": edges[1]})

    found = checkpoint(classes.select("rep", "bands").mapInPandas(spread, "key long, kind int, blob binary").repartition(parts, "key").groupBy("key").applyInPandas(met, "kind int, u long, v long"))
    members = found.filter("kind = 0").select("u", "v").join(classes.select("rep", "short"), F.col("v") == F.col("rep")).select(F.pmod(F.col("u"), F.lit(parts)).alias("key"), "u", "v", "short")
    edges = members.repartition(parts, "key").groupBy("key").applyInPandas(compared, "u long, v long").unionByName(found.filter("kind = 1").select("u", "v"))
    clusters = components(edges)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    placed = clusters.join(sizes, "component").join(classes.select("rep", "copies"), F.col("node") == F.col("rep")).select(F.col("node").alias("at"), "component", "size", "copies")

    def deal(batches):
        for t in batches:
            for rows in blocks(list(t.itertuples(index=False)), lambda r: len(r.text or "") * -(-r.size // block), 1 << 19):  # a row goes out once for each block of its cluster
                out = []
                for r, s in zip(rows, shingle_sets([r.text for r in rows], words), strict=True):
                    nb = -(-r.size // block)
                    a = ((r.rid * 0x9E3779B97F4A7C15) % 2**64 >> 33) % nb
                    for x in range(nb):
                        unit = f"{r.component}/{min(a, x)}/{max(a, x)}" if nb > 1 else f"/{r.component % parts}"
                        out.append((unit, r.component, r.rid, r.copies, int(x < a), pack(s)))
                yield pd.DataFrame(out, columns=["unit", "cluster", "rid", "copies", "side", "shingles"])

    def unit(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        rid, copies, side = t.rid.to_numpy(), t.copies.to_numpy(), t.side.to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in t.shingles]
        name = key[0].split("/")
        apart = bool(name[0]) and name[1] != name[2]
        out = []
        for _, x in slices(t.cluster.to_numpy()):
            if len(x) > 1 and (not apart or 0 < side[x].sum() < len(x)):
                out.append(_link_group(rid[x], copies[x], side[x], [sets[k] for k in x], threshold, tolerance))
        got = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        release()
        return pd.DataFrame(dict(zip(("rid", "n", "least"), got, strict=True)))

    dealt = texts.join(placed, F.col("rid") == F.col("at")).select("rid", "text", "component", "size", "copies").mapInPandas(releasing(deal), "unit string, cluster long, rid long, copies long, side int, shingles binary")
    found = checkpoint(dealt.groupBy("unit").applyInPandas(unit, "rid long, n long, least long"))
    links = found.groupBy("rid").agg(F.sum("n").alias("n")).withColumnRenamed("rid", "__l")
    groups = components(found.select(F.col("rid").alias("u"), F.col("least").alias("v")))
    named = classes.join(links, F.col("rep") == F.col("__l"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    links_n = F.coalesce(links["n"], F.lit(0))
    named = named.select(classes["n"].alias("__n"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("rep").alias("class_rid"), (F.col("copies") - 1 + links_n).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    same = (F.col("n") == F.col("__n")) & (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2"))
    return sketched.select("rid", "n", "k1", "k2").join(named, same).select("rid", "class_rid", "n_links", "component")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of docs but those with a smaller row (by doc_id; null first, rows that repeat one by a hash of text) in their component.

    All columns stay. Rows without a word stay, as they link with nothing.
    """
    inner, back = sheltered(docs, ("doc_id", "text"))
    keyed = with_rid(inner, "doc_id", "text")
    kept = join(keyed).filter("rid = component").select("rid")
    return back(keyed.join(kept, keyed[RID] == kept["rid"], "left_semi"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, component_id, kept of each document; ids are the doc_ids of the smallest rows."""
    docs = with_rid(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    joined = join(docs)
    ids = docs.select(F.col(RID).alias("rid"), "doc_id")
    as_name = lambda k, v: ids.select(F.col("rid").alias(k), F.col("doc_id").alias(v))
    named = joined.join(ids, "rid").join(as_name("class_rid", "class_id"), "class_rid").join(as_name("component", "component_id"), "component")
    return named.select("doc_id", "class_id", "n_links", "component_id", (F.col("rid") == F.col("component")).alias("kept"))
