"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest_batches, releasing, table
from .hashing import mix

UNDETERMINED = "und"
#: Labelled rows of each language that the classifier is fitted on, about.
SAMPLE_ROWS = 5000
BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
#: n-grams whose evidence counts at most in a score; letters of the runs that tell a text's languages apart, about.
EVIDENCE, RUN = 30, 240
BEHIND = max(ORDERS) - 1
#: Letters of the texts that are scored together, places that are looked up at a time.
_BLOCK, _SLICE = 1 << 18, 1 << 20


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts with every run of other characters as one space, and offsets.

    BEHIND more spaces follow each text; they count as part of it in the offsets.
    """
    whole = " ".join(["", *[x.lower().replace("\x00", " ") for x in texts], ""])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[1], 1 + np.cumsum([len(x.lower()) + 1 for x in texts])]).astype(np.int64)
    is_letter = _letter_table()[codes]
    codes = np.where(is_letter, codes, 32).astype(np.uint64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    codes, offsets = codes[keep], place[offsets]
    # Spaces behind each text, so that no n-gram reaches into the next.
    apart = np.full(len(codes) + BEHIND * len(texts), 32, np.uint64)
    moved = np.arange(len(codes)) + BEHIND * np.searchsorted(offsets[1:-1], np.arange(len(codes)), "right")
    apart[moved] = codes
    return apart, offsets + BEHIND * np.arange(len(offsets))


_TABLE: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


def grams(codes: np.ndarray, buckets: int, order: int, lo: int, hi: int) -> np.ndarray:
    """The buckets of the n-grams of this order that start at places lo to hi; spaces follow the end."""
    rolled = np.zeros(hi - lo, np.uint64)
    for n in range(order):
        shifted = np.full(hi - lo, 32, np.uint64)
        here = codes[lo + n : hi + n]
        shifted[: len(here)] = here
        rolled = rolled * np.uint64(0x100000001B3) + shifted
    return (mix(rolled + np.uint64(order)) & np.uint64(buckets - 1)).astype(np.int64)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The number of the text at each place from offsets[0] on; -1 for the spaces behind it."""
    out = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for k in range(1, BEHIND + 1):
        out[offsets[1:] - offsets[0] - k] = -1
    return out


def count_rows(codes: np.ndarray, first: int, rows: np.ndarray, number: int, buckets: int, order: int) -> np.ndarray:
    """number rows of counts by bucket: how often n-grams of this order start at the places of each row. Long texts go in slices."""
    out = np.zeros(number * buckets)
    for lo in range(0, len(rows), _SLICE):
        some = rows[lo : lo + _SLICE]
        found = grams(codes, buckets, order, first + lo, first + lo + len(some))
        out += np.bincount((some * buckets + found)[some >= 0], minlength=len(out))
    return out.reshape(-1, buckets)


def gram_sums(codes: np.ndarray, offsets: np.ndarray, logs: np.ndarray, order: int) -> np.ndarray:
    """For each text, the sum of the rows of logs that its n-grams of this order have: only buckets that a text shows are read, so that work follows its letters."""
    out = np.zeros((len(offsets) - 1, logs.shape[1]))
    behind = np.concatenate([offsets[1:] - k for k in range(1, BEHIND + 1)])
    for lo in range(int(offsets[0]), int(offsets[-1]), _SLICE):
        hi = min(lo + _SLICE, int(offsets[-1]))
        rows = logs[grams(codes, len(logs), order, lo, hi)]
        rows[behind[(behind >= lo) & (behind < hi)] - lo] = 0
        first = int(np.searchsorted(offsets, lo, "right")) - 1
        starts = np.concatenate([[lo], offsets[(offsets > lo) & (offsets < hi)]])
        out[first : first + len(starts)] += np.add.reduceat(rows, starts - lo, axis=0)
    return out


def counts_of(texts: list[str], buckets: int) -> np.ndarray:
    codes, offsets = letters(texts)
    rows = np.minimum(rows_of(offsets), 0)
    return sum(count_rows(codes, int(offsets[0]), rows, 1, buckets, order)[0] for order in ORDERS).astype(np.int64)


def fit(labelled: DataFrame, per_language: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """(languages in code-point order, log-probability matrix buckets x languages) from rows (doc_id, text, lang).

    Rows without text or lang teach nothing. Of a language with more rows than ``per_language``, about that many
    take part, chosen by a hash of doc_id and text; what comes to the driver is bounded by that and by buckets.
    """
    labelled = modest_batches(labelled).filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((buckets, 0), np.float32)
    names = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, per_language / sizes[k]))])
    chance = (F.xxhash64("doc_id", "text") % 1_000_000 + 1_000_000) % 1_000_000 / 1e6
    tasks = max(1, min(64, sum(min(per_language, n) for n in sizes.values()) // 1000))
    sample = labelled.filter(chance < share[F.col("lang")]).repartition(tasks)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for t in batches:
            for lang, rows in t.groupby("lang"):
                for lo in range(0, len(rows), 64):
                    got = counts_of(list(rows.text[lo : lo + 64]), buckets)
                    total[lang] = total[lang] + got if lang in total else got
        for lang, x in total.items():
            some = np.flatnonzero(x)
            yield pd.DataFrame({"lang": lang, "bucket": some, "n": x[some]})

    sums = {k: np.zeros(buckets) for k in names}
    for lang, t in sample.mapInPandas(releasing(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas().groupby("lang"):
        sums[lang][t.bucket.to_numpy()] = t.n.to_numpy()
    logs = [np.log(sums[k] + SMOOTHING) - np.log(sums[k].sum() + SMOOTHING * buckets) for k in names]
    return names, np.stack(logs, axis=1).astype(np.float32)


def usual_fit(logs: np.ndarray) -> np.ndarray:
    """What a language's own n-grams have on average as log probability."""
    return (np.exp(logs.astype(np.float64)) * logs).sum(axis=0)


def shares(codes: np.ndarray, offsets: np.ndarray, logs: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The share of each text's runs of about RUN letters whose trigrams are likeliest in its language best, and one more such run."""
    size = np.diff(offsets) - BEHIND
    runs = np.maximum(1, np.round(size / RUN)).astype(np.int64) * (size > 0)
    text = np.repeat(np.arange(len(size)), runs)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = offsets[text] + nth * size[text] // runs[text]
    if not len(starts):
        return np.zeros(len(size))
    ends = np.append(starts[1:], offsets[-1])  # spaces behind a text count with its last run
    sums = np.empty((len(starts), logs.shape[1]))
    for lo in range(0, len(starts), _SLICE // RUN):
        a, b = starts[lo], ends[min(lo + _SLICE // RUN, len(starts)) - 1]
        sums[lo : lo + _SLICE // RUN] = np.add.reduceat(logs[grams(codes, len(logs), ORDERS[-1], a, b)], starts[lo : lo + _SLICE // RUN] - a, axis=0)
    won = sums.argmax(axis=1) == best[text]
    return np.where(runs == 1, 1.0, (np.bincount(text, won, len(size)) + 1) / (runs + 1))


def predict_texts(texts: list[str | None], names: list[str], logs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, fit, share) of each text.

    score is the posterior under equal priors if no more than EVIDENCE n-grams spoke, as neighbouring n-grams share
    letters. fit is how likely an n-gram of the text is in the language (mean log probability), less what is usual there. share is
    that of the text's runs which are in its language by themselves.
    """
    langs, scores, fits, parts = [], [], [], []
    block: list[str] = []
    usual, exact = usual_fit(logs), logs.astype(np.float64)

    def flush():
        codes, offsets = letters(block)
        is_letter = np.concatenate([[0], np.cumsum(codes != 32)])
        seen = is_letter[offsets[1:]] - is_letter[offsets[:-1]]
        sums = sum(gram_sums(codes, offsets, exact, order) for order in ORDERS) if names else np.zeros((len(block), 0))
        if names:
            number = np.maximum(1, len(ORDERS) * (np.diff(offsets) - BEHIND))[:, None]
            best = sums.argmax(axis=1)
            odds = (sums - sums.max(axis=1, keepdims=True)) * np.minimum(1, EVIDENCE / number)
            chance = 1 / np.exp(odds).sum(axis=1)
            fit = (sums / number)[np.arange(len(block)), best] - usual[best]
            share = shares(codes, offsets, logs, best)
        for i in range(len(block)):
            known = bool(names) and seen[i] > 0
            langs.append(names[best[i]] if known else UNDETERMINED)
            scores.append(float(chance[i]) if known else 0.0)
            fits.append(float(fit[i]) if known else -np.inf)
            parts.append(float(share[i]) if known else 0.0)

    size = 0
    for x in texts:
        block.append("" if x is None else x)
        size += len(block[-1])
        if size >= _BLOCK:
            flush()
            block, size = [], 0
    if block:
        flush()
    return langs, np.array(scores), np.array(fits), np.array(parts)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], name: str = "__lid") -> DataFrame:
    """Adds struct ``name`` (lang_pred, score, fit, share) to every row of docs, in place of a column of that name.

    Null texts and texts without a letter get ``und``, 0.0, -inf and 0.0, as all do if nothing was learned. Ties go to the
    language that comes first by code point. Repeated rows get equal results; long texts are counted in slices.
    """
    sent = modest_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, fit double, share double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("lang_pred", "score", "fit", "share"), predict_texts([None if x is None else x for x in texts], *sent.value), strict=True)))

    return docs.withColumn(name, predicted(F.col("text").cast("string")))


def held_out(folds: int, fold: int) -> F.Column:
    """Whether crc32 of doc_id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of each document, repeated and null ids included; a null doc_id is in no held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(3, 1))
    model = fit(docs.filter(~F.col("held_out")))
    return identify(docs.drop("lang"), model).select("doc_id", "held_out", F.col("__lid.lang_pred").alias("lang_pred"), F.col("__lid.score").alias("score"))
