"""Dropping lines that many documents share.

Texts are exploded into normalised lines, whose keys are hashed; documents are counted for each hash; a second join tells
each document the positions of its lines over the threshold, and the lines left are put together in their order.

Counting sends one row for each distinct line of a document, added up before they move. In the join, a line that a third of
all documents holds is dealt by a salt of the document, and each line over the threshold is there once for each salt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import RID, modest_batches, releasing, sheltered, table, with_rid

WHITE = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A line goes if its key has this many code points at least and this many documents hold it.
LEAST_CHARS, DOCUMENTS = 1, 10
#: Tasks that the documents of one line are dealt to.
SALTS = 32
_KEYS = pa.schema([("rid", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("places", pa.list_(pa.int32()))])


def keys_of(text: bytes) -> list[bytes]:
    """The key of each line: white space at both ends stripped, A-Z in lower case."""
    return [x.strip(WHITE) for x in text.translate(LOWER).split(b"\n")]


def without(text: bytes, places) -> bytes:
    """text without the lines at places."""
    lines, gone = text.split(b"\n"), set(places)
    return b"\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text


def exploded(docs: DataFrame, least_chars: int) -> DataFrame:
    """(rid, two halves of the key's hash, positions) of each distinct key of a document.

    The hash is a cryptographic one of 128 bits: no two keys of a corpus, made to or not, have the same.
    """

    def run(batches):
        for b in batches:
            rids, hashes, places, widths = [], [], [], []
            for rid, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found: dict[bytes, list[int]] = {}
                for i, key in enumerate(keys_of((text.as_py() or "").encode())):
                    if len(key) >= least_chars and (least_chars <= 1 or len(key.decode()) >= least_chars):
                        found.setdefault(key, []).append(i)
                rids += [rid] * len(found)
                for key, at in found.items():
                    hashes.append(hashlib.blake2b(key, digest_size=16).digest())
                    places += at
                    widths.append(len(at))
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), lists], schema=_KEYS)

    return docs.select(RID, F.col("text").cast("string").alias("text")).mapInArrow(releasing(run), "rid long, h long, g long, places array<int>")


def dropped_places(docs: DataFrame, documents: int = DOCUMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(RID, places) of the rows of docs (RID unique, text) that hold lines over the threshold, with their positions."""
    keys = exploded(docs, least_chars)
    common = keys.groupBy("h", "g").agg(F.count("*").alias("n")).filter(F.col("n") >= documents).select("h", "g")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("salt")
    met = keys.select("*", salt).join(common.select("h", "g", salts), ["h", "g", "salt"]).select(F.col("rid").alias(RID), "places")
    return met.groupBy(RID).agg(F.flatten(F.collect_list("places")).alias("places"))


def drop_lines(docs: DataFrame, documents: int = DOCUMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with n_lines (before) and n_dropped, and text without the lines whose keys at least ``documents`` rows hold.

    A null or empty text is one empty line; a null text stays null. A row counts once for a key however often its text
    repeats it. Repeated rows and rows with a repeated or null doc_id are documents of their own. Keys below
    ``least_chars`` code points stay. Other columns stay, whatever their names; an empty table gives an empty one.
    """
    return _dropped(docs, documents, least_chars, digest=False)


def _dropped(docs: DataFrame, documents: int, least_chars: int, digest: bool) -> DataFrame:
    if documents < 1 or least_chars < 1:
        raise ValueError("documents and least_chars must be at least 1")
    inner, back = sheltered(modest_batches(docs), ("doc_id", "text"))
    keyed = with_rid(inner.withColumn("text", F.col("text").cast("string")), "doc_id", "text")
    joined = keyed.join(dropped_places(keyed, documents, least_chars), RID, "left")
    carried = ["doc_id"] if digest else [c for c in inner.columns if c != "text"]
    types = [inner.schema[c].dataType for c in carried]
    made = "n_lines long, n_dropped long, " + ("kept_sha256 string" if digest else "text string")
    last = [("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256" if digest else "text", pa.string())]
    schema = pa.schema([*[(c, to_arrow_type(t)) for c, t in zip(carried, types, strict=True)], *last])

    def run(batches):
        for b in batches:
            n, gone, out = [], [], []
            for text, places in zip(b.column("text"), b.column("places"), strict=True):
                raw = (text.as_py() or "").encode()
                at = places.as_py() or ()
                kept = without(raw, at)
                n.append(raw.count(b"\n") + 1)
                gone.append(len(at))
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode() if text.is_valid else None)
            own = [b.column(c).cast(schema.field(c).type) for c in carried]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], schema=schema)

    ddl = ", ".join([*[f"`{c}` {t.simpleString()}" for c, t in zip(carried, types, strict=True)], made])
    done = joined.select(*carried, "text", "places").mapInArrow(releasing(run), ddl)
    if digest:
        return done
    # What is made here gets names that docs doesn't have.
    return back(done, n_lines=_free("n_lines", docs.columns), n_dropped=_free("n_dropped", docs.columns))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that ten documents hold go from all of them: doc_id, n_lines, n_dropped, kept_sha256. See drop_lines() for odd rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _dropped(docs, DOCUMENTS, LEAST_CHARS, digest=True)
