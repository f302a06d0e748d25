"""Words that sums of powers can't tell apart, through every operator that hashes words."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from linkwright.llm import hashing, jaccard, lm, phrases

from .fixtures import write


def halves(n, a="a", b="b"):
    """Two words of n letters in which every half is the other one inverted."""
    marks = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[m] for m in marks), "".join((b, a)[m] for m in marks)


LONG = [w for n in (1024, 2048, 4096, 65536) for w in halves(n)]


def test_words_that_differ_have_different_hashes():
    words = [w.encode() for w in LONG] + [b"x" * n for n in range(1, 100)]
    h = hashing.words_of([b" ".join(words)])[0]
    assert len(set(h.tolist())) == len(words)
    again = hashing.words_of([b"other text", b" \n".join(words)])[0]
    assert np.array_equal(again[2:], h)


def test_phrases_with_long_words(spark, tmp_path):
    one, other = halves(2048)
    rest = [f"w{i}" for i in range(13)]
    texts = [" ".join([*rest[:6], one, *rest[6:]]), " ".join([*rest[:6], other, *rest[6:]]), " ".join([*rest[:6], other, *rest[6:]]), " ".join(rest)]
    folder = write(spark, tmp_path, list(enumerate(texts)), "doc_id long, text string")
    seen, want = {}, {}
    for d, t in enumerate(texts):
        words = t.split()
        for i in range(len(words) - 12):
            seen.setdefault(tuple(words[i : i + 13]), d)
    for d, t in enumerate(texts):
        words = t.split()
        gone = {i + k for i in range(len(words) - 12) if seen[tuple(words[i : i + 13])] < d for k in range(13)}
        want[d] = (len(words), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.op8_phrase_dedup(spark, folder).collect()}
    assert got == want and want[2][1] == 14


def test_links_between_long_words(spark, tmp_path):
    folder = write(spark, tmp_path, list(enumerate([*LONG, LONG[0]])), "doc_id long, text string")
    rows = {r.doc_id: r for r in jaccard.op10_jaccard_join(spark, folder).collect()}
    assert [rows[i].n_links for i in range(len(LONG) + 1)] == [1] + [0] * (len(LONG) - 1) + [1]


@pytest.mark.parametrize("n", [1024, 4096])
def test_counts_of_long_words(spark, tmp_path, n):
    one, other = halves(n)
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    taught, kept = [d for d in range(60) if not held(d)], next(d for d in range(60) if held(d))
    texts = {d: f"some words {one} {d}" for d in taught} | {kept: f"some {other}"}
    folder = write(spark, tmp_path, sorted(texts.items()), "doc_id long, text string")
    row = next(r for r in lm.op4_lm_score(spark, folder).collect() if r.doc_id == kept)
    counts = Counter(w for d in taught for w in [*texts[d].split(), None])
    total = sum(counts.values())
    base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ["some", other, None])
    assert row.n_known == 2 and row.train_tokens == total and abs(row.base_score - base) < 1e-6
