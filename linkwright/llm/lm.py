"""Scoring texts with a language model of subwords.

A score is the model's own log10 probability of a text; counts of words give base_score only. The model is a causal
self-attention model over the subwords of a public byte-level vocabulary; each subword carries whether it ends its word,
so that subword sequences are a prefix-free code of words. The network predicts the class of the next subword: frequent
ones are a class each, others share one with those that stand in like places. Its prior is how often classes follow the
subword before; within a class, subwords follow their counts behind that subword. All counts are over all training
documents, and the network trains on every window of every training document, in rounds: tasks train on their parts'
windows of a round from common parameters, which are then averaged for the next.

Documents are dealt into parts. A part is tokenised once: its distinct words, and its texts as numbers of those.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention as net
from .bpe import VOCABULARY, encoding
from .common import RID, checkpoint, modest_batches, pack, parts_for, release, slices, table, unpack, with_rid
from .hashing import LOWER_BYTE, joined, words_of
from .language_id import held_out

SEED = 5
#: Inputs with a subword of their own; the others share the rest by rank. Classes of one input; the others are clusters.
OWN, HEAD = net.INPUTS - 2 - 256, net.CLASSES * 3 // 4
#: Pseudo-counts of the distribution that follows the subword before, of that of all subwords, and of those in an input.
FOLLOW, EACH, RARE = 8.0, 0.5, 0.1
#: Rounds of training; each window is in one. Windows of a round that one task trains on, about; windows cut out at a time; blobs that one task adds up.
ROUNDS, SHARE, CUT, FAN = 4, 20_000, 1 << 12, 32
_PART = "key long, docs binary, words binary, hashes binary, counts binary, widths binary, subwords binary"


@lru_cache(maxsize=1)
def _byte_lengths(path: str) -> np.ndarray:
    return np.array([len(encoding(path).decode_single_token_bytes(i)) for i in range(encoding(path).n_vocab)], np.int64)


def subwords_of(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers 2 * id + (1 for the last) of the subwords of each word behind a space, how many each word has).

    Words are encoded in one text. Where subwords don't end with each word (words with white space that isn't ASCII),
    every word is encoded by itself.
    """
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    tokens = np.asarray(encoding(path).encode_to_numpy(" " + b" ".join(words).decode(), disallowed_special=())).astype(np.int32)
    reach, ends = np.cumsum(_byte_lengths(path)[tokens]), np.cumsum([len(w) + 1 for w in words])
    last = np.searchsorted(reach, ends)
    if (reach[last] != ends).any():
        each = [encoding(path).encode_ordinary(" " + w.decode()) for w in words]
        tokens, last = np.array([t for e in each for t in e], np.int32), np.cumsum([len(e) for e in each]) - 1
    tokens = tokens * 2
    tokens[last] += 1
    return tokens, np.diff(last, prepend=-1)


def prepare(key: int, rid: np.ndarray, train: np.ndarray, texts: list[bytes], path: str) -> tuple:
    """A part as one row: word 0 is the end of a text."""
    hashes, first, starts, ends = words_of(texts, lower=True)
    data = LOWER_BYTE[joined(texts)[0]].tobytes()
    sizes = np.diff(first)
    distinct, at, number = np.unique(hashes, return_index=True, return_inverse=True)
    taught = np.repeat(train, sizes)
    rank = np.empty(len(distinct), np.int64)
    rank[order := np.argsort(-np.bincount(number, minlength=len(distinct)), kind="stable")] = np.arange(len(distinct))
    distinct, at, number = distinct[order], at[order], rank[number]  # frequent words first: small numbers pack well
    counts = np.bincount(number[taught], minlength=len(distinct)).astype(np.int64)
    subwords, width = subwords_of([data[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], path)
    end = np.array([2 * encoding(path).n_vocab + 1], np.int32)
    stream = np.zeros(len(number) + len(texts), np.int32)
    place = np.ones(len(stream), bool)
    place[np.cumsum(sizes + 1) - 1] = False
    stream[place] = number + 1
    docs = pack(rid.astype(np.int64), sizes.astype(np.int64), train.astype(np.int64))
    small = zstandard.ZstdCompressor(level=1).compress
    return key, docs, small(pack(stream)), pack(distinct), small(pack(counts)), small(pack(np.concatenate([[1], width]).astype(np.int32))), small(pack(np.concatenate([end, subwords])))


def _large(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _offsets(widths: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(_large(widths, np.int32))]).astype(np.int64)


class Part:
    """A prepared part, unpacked."""

    def __init__(self, row):
        self.rid, self.sizes, self.train = unpack([row.docs], np.int64, np.int64, np.int64)
        self.stream, self.hashes = _large(row.words, np.int32), np.frombuffer(row.hashes, np.uint64)
        self.first, self.subwords = _offsets(row.widths), _large(row.subwords, np.int32)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes + 1)])

    def tokens(self, lo: int, hi: int):
        """For documents lo to hi: places of their subwords in self.subwords, offset of each document among them, offset of each word."""
        words = self.stream[self.begin[lo] : self.begin[hi]]
        width = np.diff(self.first)[words]
        ends = np.cumsum(width)
        at = np.repeat(self.first[words] - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)
        word_first = np.concatenate([[0], ends])
        return at, word_first[self.begin[lo : hi + 1] - self.begin[lo]], word_first

    def spans(self, limit: int = 1 << 16):
        """Ranges of documents with about limit words each."""
        lo = 0
        for hi in range(1, len(self.sizes) + 1):
            if hi == len(self.sizes) or self.begin[hi] - self.begin[lo] >= limit:
                yield lo, hi
                lo = hi


class Inputs:
    """The input of each subword, from the counts of all: frequent ones have their own."""

    def __init__(self, counts: np.ndarray):
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        self.of = np.where(rank < OWN, rank, OWN + rank % (net.BEGIN - OWN)).astype(np.int32)
        self.within = np.log((counts + RARE) / np.bincount(self.of, counts + RARE, net.INPUTS)[self.of])

    def before(self, subwords: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The input before each subword of words that begin at first; BEGIN before a word."""
        out = np.concatenate([[net.BEGIN], self.of[subwords[:-1]]])[: len(subwords)]
        out[first[:-1]] = net.BEGIN
        return out


def clusters(pairs: np.ndarray, head: int, number: int, seed: int = SEED, width: int = 16, sides: int = 256) -> np.ndarray:
    """The class of each input: the most frequent have their own, others share by what stands next to them in words."""
    total = pairs.sum(axis=0)
    order = np.argsort(-total, kind="stable")
    cls = np.empty(len(total), np.int64)
    cls[order[:head]] = np.arange(head)
    near, rest = order[:sides], order[head:]
    seen = np.sqrt(np.concatenate([pairs[near].T / np.maximum(total[:, None], 1), pairs[:, near] / np.maximum(pairs.sum(axis=1)[:, None], 1)], axis=1))
    _, axes = np.linalg.eigh((seen * total[:, None]).T @ seen)
    points, weight = (seen @ axes[:, -width:])[rest], np.sqrt(total[rest] + 1)
    centre = points[np.random.default_rng(seed).choice(len(rest), number, replace=False, p=weight / weight.sum())]
    for _ in range(15):
        own = ((points[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        mass = np.bincount(own, weight, number)
        sums = np.stack([np.bincount(own, weight * x, number) for x in points.T], axis=1)
        centre = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centre)
    cls[rest] = head + own
    return cls


class Subwords:
    """What counts over all training documents say of subwords: classes, and probabilities given the subword before.

    A subword's probability is that of its class (from the network) times that of its input in the class, given the
    input before it, times its share of the input. counts are of subwords, pairs of inputs next to each other in words.
    """

    def __init__(self, counts: np.ndarray, pairs: np.ndarray):
        self.inputs = Inputs(counts)
        total = pairs.sum(axis=0) + EACH
        total[net.BEGIN :] = 0
        self.cls = clusters(pairs, HEAD, net.CLASSES - HEAD).astype(np.int32)
        self.share, self.pairs = total / total.sum(), pairs.astype(np.float32)
        by_class = np.stack([np.bincount(self.cls, row, net.CLASSES) for row in pairs])
        self.by_class, self.class_share = by_class.astype(np.float32), np.bincount(self.cls, self.share, net.CLASSES)
        prior = np.log((by_class + FOLLOW * self.class_share + 1e-9) / (by_class.sum(axis=1, keepdims=True) + FOLLOW))
        ends = np.bincount(self.inputs.of, counts * (np.arange(len(counts)) % 2), net.INPUTS) > np.bincount(self.inputs.of, counts, net.INPUTS) / 2
        prior[ends] = prior[net.PAD] = prior[net.BEGIN]
        self.prior = prior.astype(np.float32)

    def given(self, subwords: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural log probability of each subword in its class, given the input before it."""
        x = self.inputs.of[subwords]
        c = self.cls[x]
        own = (self.pairs[before, x].astype(np.float64) + FOLLOW * self.share[x] / self.class_share[c]) / (self.by_class[before, c].astype(np.float64) + FOLLOW)
        return np.log(own) + self.inputs.within[subwords]


def lessons(part: Part, model: Subwords, turn: int):
    """Batches of inputs, classes and weights (0 behind a text) of the training windows of one of ROUNDS; spans of documents take turns."""
    inputs = model.inputs.of[part.subwords]
    classes = model.cls[inputs]
    for nth, (lo, hi) in enumerate(part.spans()):
        if nth % ROUNDS != turn:
            continue
        at, first, _ = part.tokens(lo, hi)
        taught = np.flatnonzero(np.repeat(part.train[lo:hi] > 0, -(-np.diff(first) // net.STRIDE)))
        taught = np.random.default_rng(SEED + turn).permutation(taught)
        x_all, y_all = inputs[at], classes[at]
        for begin in range(0, len(taught), CUT):
            x, y, real, _ = net.windows(x_all, y_all, first, taught[begin : begin + CUT])
            for k in range(0, len(x), net.BATCH):
                yield x[k : k + net.BATCH], y[k : k + net.BATCH], real[k : k + net.BATCH].astype(np.float32)


def _tally(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of n by place (below size, which the vocabulary and the model bound) over rows (place, n)."""
    found = rows.groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    return np.bincount(found["place"].to_numpy(np.int64), found["n"].to_numpy(np.float64), size)


def _sum_blobs(rows: DataFrame, tasks: int) -> np.ndarray:
    """The sum of packed vectors (task, blob), one of each task at most, by a tree: no task adds up more than FAN of a level."""

    def add(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"task": [int(t.task.iloc[0])], "blob": [pack(sum(np.frombuffer(b, np.float64) for b in t.blob))]})

    while tasks > FAN:
        tasks = -(-tasks // FAN)
        rows = rows.groupBy(F.col("task") % tasks).applyInPandas(add, "task long, blob binary")
    return sum((np.frombuffer(r["blob"], np.float64) for r in rows.select("blob").collect()), np.zeros(1))


def score(docs: DataFrame, path: str = VOCABULARY, part_bytes: int = 8 << 20) -> DataFrame:
    """(rid, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (RID unique, text, train).

    Words are runs without ASCII white space, A-Z lower-cased; a text ends with one more token. A null text is empty.
    Without training rows, base_score is 0 and score is that of the untrained network.
    """
    spark, vocabulary = docs.sparkSession, 2 * encoding(path).n_vocab + 2
    size, taught = modest_batches(docs).agg(F.sum(F.octet_length("text")), F.count(F.when(F.col("train"), 1))).first()
    n_parts = parts_for(size, part_bytes)
    dealt = docs.select(F.pmod(F.col(RID), F.lit(n_parts)).cast("long").alias("key"), F.col(RID).alias("rid"), F.col("train"), F.col("text").cast("string").alias("text"))

    def tokenise(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        release()
        row = prepare(int(key[0]), t.rid.to_numpy(), t.train.to_numpy().astype(bool), [(x or "").encode() for x in t.text], path)
        return pd.DataFrame([row], columns=[x.split()[0] for x in _PART.split(", ")])

    parts = checkpoint(dealt.repartition(n_parts, "key").groupBy("key").applyInPandas(tokenise, _PART))

    def words(batches):
        for t in batches:
            for row in t.itertuples():
                h, c = np.frombuffer(row.hashes, np.uint64), _large(row.counts, np.int64)
                bucket = ((h >> np.uint64(17)) % np.uint64(n_parts)).astype(np.int64)
                yield pd.DataFrame([(k, row.key, pack(h[x], c[x])) for k, x in slices(bucket)], columns=["bucket", "key", "blob"])

    def total(t: pd.DataFrame) -> pd.DataFrame:
        h, c = unpack(t.blob, np.uint64, np.int64)
        owner = np.repeat(t.key.to_numpy(), [len(b) // 16 for b in t.blob])
        distinct, number = np.unique(h, return_inverse=True)
        sums = np.bincount(number, c, len(distinct)).astype(np.int64)
        rows = [(k, pack(h[x], sums[number[x]]), 0, 0) for k, x in slices(owner)]
        return pd.DataFrame([*rows, (-1, None, int((sums > 0).sum()), int(sums.sum()))], columns=["key", "blob", "v", "n"])

    totals = checkpoint(parts.select("key", "hashes", "counts").mapInPandas(words, "bucket long, key long, blob binary").repartition(n_parts, "bucket").groupBy("bucket").applyInPandas(total, "key long, blob binary, v long, n long"))
    distinct, tokens = (int(x or 0) for x in totals.filter("key = -1").agg(F.sum("v"), F.sum("n")).first())
    distinct, tokens = distinct + (taught > 0), tokens + taught

    def counted(size: int, places):
        """Sums by place over the subwords of distinct words, each as often as its word in training documents."""

        def tally(batches):
            sums = np.zeros(size, np.int64)
            for t in batches:
                for row in t.itertuples():
                    sub, c, first = _large(row.subwords, np.int32), _large(row.counts, np.int64), _offsets(row.widths)
                    each = np.repeat(np.concatenate([[0], c]), np.diff(first))
                    sums += np.bincount(places(sub, first), each, size).astype(np.int64)
            some = np.flatnonzero(sums)
            yield pd.DataFrame({"place": some, "n": sums[some]})

        return _tally(parts.select("widths", "subwords", "counts").mapInPandas(tally, "place long, n long"), size)

    counts = counted(vocabulary, lambda sub, first: sub)
    counts[vocabulary - 1] += taught
    inputs = spark.sparkContext.broadcast(Inputs(counts))
    pairs = counted(net.INPUTS**2, lambda sub, first: inputs.value.before(sub, first).astype(np.int64) * net.INPUTS + inputs.value.of[sub]).reshape(net.INPUTS, net.INPUTS)
    pairs[net.BEGIN, inputs.value.of[vocabulary - 1]] += taught
    subwords = spark.sparkContext.broadcast(Subwords(counts, pairs))

    trainers = max(1, round((tokens + taught) * 2.5 / net.STRIDE / ROUNDS / SHARE))
    lines = parts.select("docs", "words", "hashes", "widths", "subwords").coalesce(trainers)

    def round_of(turn: int, start):
        def teach(batches):
            own = start.value.copy()
            seen = net.train(own, subwords.value.prior, (b for t in batches for row in t.itertuples() for b in lessons(Part(row), subwords.value, turn)))
            if seen:
                yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "blob": [pack(np.concatenate([[seen], seen * own.astype(np.float64)]))]})

        return _sum_blobs(lines.mapInPandas(teach, "task long, blob binary"), trainers)

    learnt = net.initial(SEED)
    for turn in range(ROUNDS if taught else 0):
        sums = round_of(turn, spark.sparkContext.broadcast(learnt))
        learnt = (sums[1:] / sums[0]).astype(np.float32) if sums[0] else learnt
    params = spark.sparkContext.broadcast(learnt)

    def judge(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({k: [] for k in ("rid", "n_tokens", "n_known", "base", "score")})
        part, model = Part(next(a.itertuples())), subwords.value
        h, c = unpack(b.blob, np.uint64, np.int64)
        order = np.argsort(h)
        count = np.concatenate([[taught], c[order[np.searchsorted(h[order], part.hashes)]] if len(part.hashes) else []])
        base = np.log10((count + 1) / (tokens + distinct + 1))
        given = model.given(part.subwords, model.inputs.before(part.subwords, part.first))
        machine, seen = net.Machine(params.value, model.prior), model.inputs.of[part.subwords]
        classes, out = model.cls[seen], []
        for lo, hi in part.spans():
            at, first, word_first = part.tokens(lo, hi)
            logs = given[at]
            add_classes(logs, machine, seen[at], classes[at], first)
            score = np.add.reduceat(logs, first[:-1]) / np.log(10)
            numbers = part.stream[part.begin[lo] : part.begin[hi]]
            words = part.begin[lo:hi] - part.begin[lo]
            out.append((part.rid[lo:hi], part.sizes[lo:hi] + 1, np.add.reduceat((count[numbers] > 0).astype(np.int64), words), np.add.reduceat(base[numbers], words), score))
        return pd.DataFrame(dict(zip(("rid", "n_tokens", "n_known", "base", "score"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    found = parts.repartition(n_parts, "key").groupBy("key").cogroup(totals.filter("key >= 0").select("key", "blob").repartition(n_parts, "key").groupBy("key")).applyInPandas(judge, "rid long, n_tokens long, n_known long, base double, score double")
    return found.select("rid", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def add_classes(logs: np.ndarray, machine: net.Machine, inputs: np.ndarray, classes: np.ndarray, first: np.ndarray, batch: int = 1024) -> None:
    """Adds the natural log probability of each token's class to logs; texts lie one behind the other, offsets in first."""
    for lo in range(0, total := int((-(-np.diff(first) // net.STRIDE)).sum()), batch):
        x, y, real, place = net.windows(inputs, classes, first, np.arange(lo, min(lo + batch, total)))
        logs[place[real]] += machine.log_probabilities(x, y)[real]


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_rid(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").withColumn("held_out", held_out(7, 2))
    found = score(docs.withColumn("train", ~F.col("held_out")))
    ids = docs.select(RID, "doc_id", "held_out")
    return found.join(ids, found["rid"] == ids[RID]).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
