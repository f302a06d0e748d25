"""Aligning the tokens of two tokenizers over the same texts.

Both encode a text; cumulative sums of token lengths give the bytes at which tokens end, common ends cut both sequences into
groups, and tokens of one group are linked. Documents are counted for each linked pair of ids, and each document reads the
counts of its own pairs.

Tasks gather documents into blocks of bounded size, whose distinct words are encoded, cut and linked once. A block has one table of its distinct pairs with the number of its
documents that hold each; documents point into that table. Only tables move: they are added up in two stages (first by pair
and a salt of the block, then by pair), and the counts travel back to the blocks, so that no pair has more rows in a shuffle
than there are blocks, however many documents hold it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpoint, modest_batches, release, releasing, table

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Characters of a block, words in a call of the tokenizers; links of a group above which ids are counted before they are linked.
BLOCK_BYTES, CALL_WORDS, LARGE = 8 << 20, 1 << 10, 1 << 12
SALTS = 16
#: White space other than the space, as either tokenizer may see it.
WHITE = tuple("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000 ")
_CUT = re.compile(f"(?<=[^{''.join(WHITE)}]) ")


@dataclass(frozen=True)
class Pair:
    """Both tokenizers and the bytes of each of their tokens."""

    a: tokenizers.Tokenizer
    b: sentencepiece.SentencePieceProcessor
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_size: np.ndarray
    b_size: np.ndarray
    a_text: list[str]
    b_text: list[str]
    #: What the second one makes of a lone space.
    space: list[int]


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in own]
    return {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(rest)}


@lru_cache(maxsize=2)
def loaded(path_a: str, path_b: str) -> Pair:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
    a = tokenizers.Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    with open(path_a, encoding="utf-8") as f:
        added = {t["id"] for t in json.load(f).get("added_tokens", [])}
    of = _byte_of_char()
    names_a, names_b = ([f(i) for i in range(n)] for f, n in ((a.id_to_token, a.get_vocab_size()), (b.id_to_piece, b.vocab_size())))
    a_bytes = [x.encode() if i in added else bytes(of[c] for c in x) for i, x in enumerate(names_a)]
    b_bytes = [bytes([int(x[3:-1], 16)]) if b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names_b)]
    if any("▁" in x.lstrip("▁") for i, x in enumerate(names_b) if not b.is_control(i)):
        raise ValueError(f"{path_b} has pieces with a space behind other characters")
    sizes = [np.array([len(x) for x in y], np.int64) for y in (a_bytes, b_bytes)]
    space = b.piece_to_id("▁")
    texts = [list(map(str, range(len(x)))) for x in (a_bytes, b_bytes)]
    return Pair(a, b, a_bytes, b_bytes, *sizes, *texts, [] if b.is_unknown(space) else [space])


def words_of(text: str) -> list[str]:
    """The words of a text: " " + text is a space and a word, time and again.

    A word ends where a space follows a character that isn't white space. No token of either tokenizer crosses such a place:
    the byte-level one looks for tokens from there anew, and no piece of the other has a space behind another character
    (loaded() makes sure). So each distinct word of a block is encoded once.
    """
    if not text:
        return []
    plain = text[0] != " " and not any(w + " " in text for w in WHITE)
    return text.split(" ") if plain else _CUT.split(text)


def _alone(words: list[str], pair: Pair) -> tuple[list[list[int]], list[list[int]]]:
    a = [x.ids for x in pair.a.encode_batch([f" {w}" for w in words], add_special_tokens=False)]
    return a, [y if w else pair.space for y, w in zip(pair.b.encode(words, num_threads=1), words, strict=True)]


def encoded(words: list[str], pair: Pair) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(words in the order of what follows, ids of both tokenizers one word behind the other, how many each word has,
    whether a word's joined tokens are a space and the word).

    Words go to the tokenizers in long texts, and are told apart by their bytes. Those that end in white space, and those of a
    text whose bytes differ, go by themselves, last. Words with other bytes have no ids.
    """
    known = (pair.a_bytes, pair.b_bytes)
    single = [i for i, w in enumerate(words) if not w or w[-1] in WHITE]
    apart = set(single)
    others = [i for i in range(len(words)) if i not in apart]
    order: list[int] = []
    ids: tuple[list, list] = ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
    sizes: tuple[list, list] = ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
    for lo in range(0, len(others), CALL_WORDS):
        part = others[lo : lo + CALL_WORDS]
        raws = [f" {words[i]}".encode() for i in part]
        text = " ".join([words[i] for i in part])
        both = pair.a.encode(f" {text}", add_special_tokens=False).ids, pair.b.encode(text, num_threads=1)
        raw, ends = b"".join(raws), np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
        if any(b"".join(map(own.__getitem__, x)) != raw for x, own in zip(both, known, strict=True)):
            single += part
            continue
        order += part
        for x, size, flat, n in zip(both, (pair.a_size, pair.b_size), ids, sizes, strict=True):
            flat.append(np.array(x, np.int64))
            n.append(np.diff(np.searchsorted(np.cumsum(size[flat[-1]]), ends), prepend=-1))
    good = np.ones(len(words), bool)
    for lo in range(0, len(single), CALL_WORDS):
        part = single[lo : lo + CALL_WORDS]
        both = _alone([words[i] for i in part], pair)
        for k, i in enumerate(part):
            good[i] = all(b"".join(map(own.__getitem__, x[k])) == f" {words[i]}".encode() for x, own in zip(both, known, strict=True))
        order += part
        for x, flat, n in zip(both, ids, sizes, strict=True):
            own = [y if good[i] else [] for i, y in zip(part, x, strict=True)]
            n.append(np.fromiter(map(len, own), np.int64, len(own)))
            flat.append(np.fromiter(chain.from_iterable(own), np.int64, int(n[-1].sum())))
    return np.array(order, np.int64), [np.concatenate(x) for x in ids], [np.concatenate(x) for x in sizes], good


def grouped(a: np.ndarray, b: np.ndarray, pair: Pair) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of a and of b: groups end where tokens of both end."""
    ends_a, ends_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)


def linked(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, id of a, id of b, how often) of the links. Groups number on from 0, both sequences are in their order.

    Each token of a is repeated for each token of b in its group. In groups of more than LARGE links ids are counted first,
    so that work follows distinct ids.
    """
    n = group_a[-1] + 1 if len(group_a) else 0
    na, nb = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    large = na * nb > LARGE
    each = np.where(large, 0, nb)[group_a]
    at = np.repeat(np.arange(len(a)), each)
    step = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
    group = group_a[at]
    parts = [(group, a[at], b[first_b[group] + step], np.ones(len(at), np.int64))]
    for g in np.flatnonzero(large).tolist():
        (ia, ca), (ib, cb) = (np.unique(x[s : s + k], return_counts=True) for x, s, k in ((a, first_a[g], na[g]), (b, first_b[g], nb[g])))
        parts.append((np.full(len(ia) * len(ib), g), np.repeat(ia, len(ib)), np.tile(ib, len(ia)), np.outer(ca, cb).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def rendered(words: np.ndarray, ids: list[np.ndarray], sizes: list[np.ndarray], groups: np.ndarray, group_sizes: list[np.ndarray], pair: Pair) -> list[str]:
    """Groups of each word as a1,a2|b1;a3|b2,b3. words: the word of what comes first, second and so on; the result is by word."""
    out = [""] * len(words)
    a, b = (list(map(text.__getitem__, x.tolist())) for x, text in zip(ids, (pair.a_text, pair.b_text), strict=True))
    na, nb = (x.tolist() for x in group_sizes)
    i = j = g = 0
    for w, n, k, m in zip(words.tolist(), groups.tolist(), *(x.tolist() for x in sizes), strict=True):
        if n == 1:  # all of the word
            out[w] = f"{a[i]}|{b[j]}" if k == m == 1 else f"{','.join(a[i : i + k])}|{','.join(b[j : j + m])}"
        else:
            parts, p, q = [], i, j
            for x, y in zip(na[g : g + n], nb[g : g + n], strict=True):
                parts.append(f"{a[p]}|{b[q]}" if x == y == 1 else f"{','.join(a[p : p + x])}|{','.join(b[q : q + y])}")
                p, q = p + x, q + y
            out[w] = ";".join(parts)
        i, j, g = i + k, j + m, g + n
    return out


def _sums(values: np.ndarray, places: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values[places] between cuts."""
    return np.diff(np.concatenate([[0], np.cumsum(values[places])])[cuts])


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one range behind the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _block(texts: list[str], pair: Pair, digest: bool):
    """Of some texts: (n_a, n_b, n_groups, n_links, groups) of each, and (text, code of the pair, how often) of their distinct links."""
    numbers: dict[str, int] = {}
    split = [[numbers.setdefault(w, len(numbers)) for w in words_of(t)] for t in texts]
    words = list(numbers)
    order, (a, b), sizes, good = encoded(words, pair)
    group_a, group_b = grouped(a, b, pair)
    n = int(group_a[-1]) + 1 if len(a) else 0
    word = np.zeros(n, np.int64)
    word[group_a] = np.repeat(order, sizes[0])
    na, nb = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    groups, links = (np.bincount(word, w, minlength=len(words)).astype(np.int64) for w in (None, na * nb))
    said = rendered(order, [a, b], sizes, groups[order], [na, nb], pair)
    size_a, size_b = np.zeros((2, len(words)), np.int64)
    size_a[order], size_b[order] = sizes

    # The distinct pairs of each word.
    group, ia, ib, times = linked(a, b, group_a, group_b)
    codes = len(pair.a_bytes) * len(pair.b_bytes)
    key, place = np.unique(word[group] * codes + ia * len(pair.b_bytes) + ib, return_inverse=True)
    often = np.bincount(place, times, minlength=len(key)).astype(np.int64)
    per_word = np.bincount(key // codes, minlength=len(words)).astype(np.int64)

    # Texts as numbers of words; those with a word of other bytes have none.
    length = np.array([len(x) for x in split], np.int64)
    at = np.fromiter(chain.from_iterable(split), np.int64, int(length.sum()))
    bad = _sums((~good).astype(np.int64), at, np.concatenate([[0], np.cumsum(length)])) > 0
    at, length = at[np.repeat(~bad, length)], np.where(bad, 0, length)
    cuts = np.concatenate([[0], np.cumsum(length)])
    figures = [_sums(x, at, cuts).tolist() for x in (size_a, size_b, groups, links)]
    shown = ["" if bad[i] else ";".join(map(said.__getitem__, x)) for i, x in enumerate(split)]
    rows = list(zip(*figures, [hashlib.sha256(t.encode()).hexdigest() if t and digest else t for t in shown], strict=True))

    # The distinct pairs of each text, from its distinct words.
    held, count = np.unique(np.repeat(np.arange(len(texts)), length) * max(1, len(words)) + at, return_counts=True)
    doc, of = held // max(1, len(words)), held % max(1, len(words))
    entry = _ranges((np.cumsum(per_word) - per_word)[of], per_word[of])
    pairs, place = np.unique(np.repeat(doc, per_word[of]) * codes + key[entry] % codes, return_inverse=True)
    return rows, pairs // codes, pairs % codes, np.bincount(place, often[entry] * np.repeat(count, per_word[of]), minlength=len(pairs)).astype(np.int64)


def _small(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _large(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _schema(id_type) -> tuple[str, pa.Schema]:
    ddl = f"block long, place int, doc_id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, entries long, codes binary, held binary, pairs binary, often binary"
    kinds = [pa.int64(), pa.int32(), to_arrow_type(id_type), *[pa.int64()] * 4, pa.string(), pa.int64(), *[pa.binary()] * 4]
    return ddl, pa.schema(list(zip([x.split(" ")[0] for x in ddl.split(", ")], kinds, strict=True)))


def blocks_of(docs: DataFrame, path_a: str, path_b: str, digest: bool, block_bytes: int) -> DataFrame:
    """A row for each document (place from 0) and one for each block (place -1), which has the table of its pairs.

    codes and held: each distinct pair of the block and how many of its documents hold it. pairs and often: for each
    document in turn, its distinct pairs as places in that table, and how many links it has of each.
    """
    id_type = docs.schema["doc_id"].dataType
    ddl, schema = _schema(id_type)

    def run(batches):
        pair = loaded(path_a, path_b)
        task, number = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def block():
            rows, doc, code, often = _block(texts, pair, digest)
            codes, pairs = np.unique(code, return_inverse=True)
            held, entries = np.bincount(pairs, minlength=len(codes)).astype(np.int64), np.bincount(doc, minlength=len(rows))
            columns = [[(task << 24) + number] * (len(rows) + 1), [*range(len(rows)), -1], [*ids, None], *[[*x, None] for x in zip(*rows, strict=True)], [*entries.tolist(), None]]
            blobs = [[None] * len(rows) + [x] for x in (codes.tobytes(), held.tobytes(), _small(pairs.astype(np.int32)), _small(often))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*columns, *blobs], schema.types, strict=True)], schema=schema)

        for b in batches:
            for doc, text in zip(b.column(0).cast(to_arrow_type(id_type)).to_pylist(), b.column(1), strict=True):
                ids.append(doc)
                texts.append(text.as_py() or "")
                size += len(texts[-1]) + 64
                if size >= block_bytes:
                    yield block()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield block()

    return modest_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(releasing(run), ddl)


def pair_rows(blocks: DataFrame) -> DataFrame:
    """(block, code, held) of every block's table."""
    kind = pa.schema([("block", pa.int64()), ("code", pa.int64()), ("held", pa.int64())])

    def run(batches):
        for b in batches:
            for key, codes, held in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                c, h = np.frombuffer(codes, np.int64), np.frombuffer(held, np.int64)
                for at in range(0, len(c), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c[part]), key)), pa.array(c[part]), pa.array(h[part])], schema=kind)

    return blocks.filter("place = -1").select("block", "codes", "held").mapInArrow(run, "block long, code long, held long")


def counted(pairs: DataFrame, b_ids: int) -> DataFrame:
    """(code, n, best) of each pair: how many documents hold it, and whether that is the highest of its id of a."""
    salted = pairs.groupBy("code", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("held").alias("n"))
    counts = salted.groupBy("code").agg(F.sum("n").alias("n"))
    a = F.expr(f"code div {b_ids}")
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    # One row for each id of a at most: the vocabulary bounds it.
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select("code", "n", (F.col("n") == F.col("top")).alias("best"))


def _vocabulary(path_b: str) -> int:
    return sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()


def link_counts(docs: DataFrame, path_a: str = BYTE_LEVEL, path_b: str = PIECES) -> DataFrame:
    """(a, b, n, best) of every pair of ids that a document of docs links: how many documents do, and whether b is a's most frequent partner."""
    size = _vocabulary(path_b)
    found = counted(pair_rows(blocks_of(docs, path_a, path_b, True, BLOCK_BYTES)), size)
    return found.select(F.expr(f"code div {size}").alias("a"), (F.col("code") % size).alias("b"), "n", "best")


def align(docs: DataFrame, path_a: str = BYTE_LEVEL, path_b: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (as a1,a2|b1;a3|b2,b3) of each row of docs.

    The byte-level tokenizer encodes a space and the text, the other one the text, to which it adds that space. Null and
    empty texts, and those whose joined tokens of either side aren't a space and the text (normalised or unknown characters,
    U+2581 itself), have no tokens: zeros and an empty text. Repeated rows, repeated and null ids are documents of their own.
    Other columns are ignored. A text is held whole by one task.
    """
    return _aligned(docs, path_a, path_b, digest=False)


def _aligned(docs: DataFrame, path_a: str, path_b: str, digest: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    blocks = checkpoint(blocks_of(docs, path_a, path_b, digest, block_bytes))
    pairs = pair_rows(blocks)
    # Read twice, as it is cheap to read again: once to be added up, once to tell each block its counts.
    met = pairs.select("block", "code").join(counted(pairs, _vocabulary(path_b)), "code").select("block", "code", "n", "best")
    id_type = docs.schema["doc_id"].dataType
    named = ["n_a", "n_b", "n_groups", "n_links"]
    last = "groups_sha256" if digest else "groups"
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), *[(c, pa.int64()) for c in [*named, "n_best", "count_sum"]], (last, pa.string())])

    def finish(own: pa.Table, counts: pa.Table) -> pa.Table:
        own = own.sort_by("place")
        head, rows = own.slice(0, 1).to_pylist()[0], own.slice(1)
        codes, order = np.frombuffer(head["codes"], np.int64), np.argsort(counts["code"].to_numpy())
        assert np.array_equal(counts["code"].to_numpy()[order], codes), "a block met other pairs than its own"
        n, best = counts["n"].to_numpy()[order], counts["best"].to_numpy().astype(np.int64)[order]
        pairs, often = _large(head["pairs"], np.int32), _large(head["often"], np.int64)
        ends = np.cumsum(rows["entries"].to_numpy())
        sums = [np.diff(np.concatenate([[0], np.cumsum(often * x[pairs])])[np.concatenate([[0], ends])]) for x in (best, n)]
        release()
        return pa.Table.from_arrays([rows["doc_id"], *[rows[c] for c in named], *[pa.array(x, pa.int64()) for x in sums], rows["groups"]], schema=schema)

    ddl = ", ".join([f"doc_id {id_type.simpleString()}", *[f"{c} long" for c in [*named, "n_best", "count_sum"]], f"{last} string"])
    return blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(finish, ddl)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two public tokenizers over all documents, groups as digests. See align() for odd rows."""
    return _aligned(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES, digest=True)
