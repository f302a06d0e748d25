"""Byte-level BPE encoding and decoding by overlapping chunks.

Long texts are cut into overlapping chunks that tasks pre-tokenise apart from each other. Pre-tokens only depend
on what follows their start, so two chunks agree from the first boundary that they share; there they are stitched.
Each chunk also encodes its inner part, and the stitching task encodes the short pieces between those parts.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RID, modest_batches, releasing, table, with_rid

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: How far the pattern looks beyond the end of a match at most.
LOOK = 4


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def encode_text(text: str, path: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    ids = encoding(path).encode_to_numpy(text, disallowed_special=())
    return np.asarray(ids, dtype="<u4").tobytes()


def decode_ids(ids: bytes, path: str) -> bytes:
    return encoding(path).decode_bytes(np.frombuffer(ids, "<u4").tolist())


def chunks_of(text: str, chunk: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, next start, text with the overlap) of each chunk."""
    return [(at, min(at + chunk, len(text)), text[at : at + chunk + overlap]) for at in range(0, max(1, len(text)), chunk)]


def pretokenise(window: str, start: int, end: int, overlap: int, first: bool, last: bool) -> tuple[list[int], list[int]]:
    """Boundaries in the chunk's own first characters, and those in the next chunk's, both by place in the text.

    Only safe boundaries count: they follow a character that isn't white space, so that the texts on both sides
    have the same pre-tokens apart as together, and nothing beyond the window could move them.
    """
    reach = len(window)
    starts = [m.start() for m in pattern().finditer(window)]
    certain = reach if last else min(starts[-1] if starts else 0, reach - LOOK)
    safe = [x for x in starts if 0 < x <= certain and not window[x - 1].isspace()]
    lead = [0] if first else [start + x for x in safe if x <= overlap]
    trail = [start + reach] if last else [start + x for x in safe if start + x >= end]
    return lead, trail


def stitch(rows: list[dict], path: str) -> bytes:
    """The ids of one text from its chunks in order; each has start, window, lead, trail, ids (of its inner part)."""
    out, at = ([rows[0]["ids"]], rows[0]["trail"][0]) if rows[0]["trail"] else ([], 0)
    for k in range(1, len(rows)):
        prior, row = rows[k - 1], rows[k]
        met = out and row["lead"] and row["trail"] and not set(prior["trail"]).isdisjoint(row["lead"])
        if not met:  # the rest at once, in order
            rest = "".join(r["window"][: r["end"] - r["start"]] for r in rows[k:])
            head = "".join(r["window"][: r["end"] - r["start"]] for r in rows[:k])
            return b"".join([*out, encode_text((head + rest)[at:], path)])
        out.append(encode_text(row["window"][at - row["start"] : row["lead"][-1] - row["start"]], path))
        out.append(row["ids"])
        at = row["trail"][0]
    return b"".join(out)


def _inner(window: str, start: int, lead: list[int], trail: list[int], path: str) -> bytes:
    return encode_text(window[lead[-1] - start : trail[0] - start], path) if lead and trail else b""


def encode(docs: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of each row of docs. doc_ids that are no integers are text.

    A null text counts as empty and has no ids. Repeated and null doc_ids keep a row each; other columns are ignored.
    """
    return _encoded(docs, path, chunk, overlap, digest=False)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Adds decoded (binary) to rows with ids; null ids decode to null."""

    @F.pandas_udf("binary")
    def raw(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else decode_ids(x, path))

    return encoded.withColumn("decoded", raw("ids"))


def _encoded(docs: DataFrame, path: str, chunk: int, overlap: int, digest: bool) -> DataFrame:
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be positive and below chunk")
    whole_ids = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    id_type, id_kind = ("long", "Int64") if whole_ids else ("string", "object")
    docs = modest_batches(docs).select(F.col("doc_id").cast(id_type).alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else f"doc_id {id_type}, ids binary"

    def own(x):
        return None if pd.isna(x) else int(x) if whole_ids else x

    def result(ids: list, blobs: list[bytes]) -> pd.DataFrame:
        if not digest:
            return pd.DataFrame({"doc_id": pd.Series(ids, dtype=id_kind), "ids": blobs})
        hexed = lambda x: hashlib.sha256(x).hexdigest()
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype=id_kind), "n_tokens": [len(b) // 4 for b in blobs], "ids_sha256": [hexed(b) for b in blobs], "decoded_sha256": [hexed(decode_ids(b, path)) for b in blobs]})

    def whole(batches):
        for t in batches:
            yield result([own(x) for x in t.doc_id], [encode_text(x or "", path) for x in t.text])

    def cut(batches):
        for t in batches:
            for rid, doc, text in zip(t[RID], t.doc_id, t.text, strict=True):
                parts = chunks_of(text, chunk, overlap)
                yield pd.DataFrame([(rid, doc, k, len(parts), *x) for k, x in enumerate(parts)], columns=["rid", "doc_id", "k", "n", "start", "end", "window"]).astype({"doc_id": id_kind})

    def inner(batches):
        for t in batches:
            rows = []
            for r in t.to_dict("records"):
                lead, trail = pretokenise(r["window"], r["start"], r["end"], overlap, r["k"] == 0, r["k"] == r["n"] - 1)
                rows.append(r | {"lead": lead, "trail": trail, "ids": _inner(r["window"], r["start"], lead, trail, path)})
            yield pd.DataFrame(rows, columns=[*t.columns, "lead", "trail", "ids"]).astype({"doc_id": id_kind})

    def one(t: pd.DataFrame) -> pd.DataFrame:
        rows = [r | {"lead": list(r["lead"]), "trail": list(r["trail"])} for r in t.sort_values("k").to_dict("records")]
        return result([own(rows[0]["doc_id"])], [stitch(rows, path)])

    length = F.coalesce(F.length("text"), F.lit(0))
    short = docs.filter(length <= chunk).mapInPandas(releasing(whole), schema)
    long = with_rid(docs.filter(length > chunk), "doc_id", "text")
    kind = f"rid long, doc_id {id_type}, k int, n int, start long, end long, window string"
    parts = long.mapInPandas(cut, kind)
    parts = parts.repartition(F.col("rid"), F.col("k")).mapInPandas(releasing(inner), kind + ", lead array<long>, trail array<long>, ids binary")
    return short.unionByName(parts.groupBy("rid").applyInPandas(one, schema))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(table(spark, sf_dir, "documents"), VOCABULARY, CHUNK, OVERLAP, digest=True)
