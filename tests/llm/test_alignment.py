"""Token alignment against plain loops over the same libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from linkwright.llm import alignment as al

from .fixtures import SCHEMA, messy, write

TEXTS = ["The quick brown fox", "", None, "  two  spaces ", "naïve café, 中文字符 and 😀", "line\nbreak\tand tab", "▁ is no space", "<s> and <|endoftext|> are text", "ﬁ ligature", "The quick brown fox", "ｆｕｌｌ width", "\x00nul", "a" * 5000, "中" * 3000, "x", " ", "The the The", "Ünïcödé " * 200]


def pieces(text):
    """(ids, bytes of each) of both tokenizers, or nothing."""
    pair = al.loaded(al.BYTE_LEVEL, al.PIECES)
    if not text:
        return [], []
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    letters = {c: x for x, c in ((x, chr(x)) for x in range(256) if 33 <= x < 127 or 161 <= x < 173 or x >= 174)}
    letters |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if not (33 <= x < 127 or 161 <= x < 173 or x >= 174))}
    own = [(i, b"<|endoftext|>" if i == 50256 else bytes(letters[c] for c in pair.a.id_to_token(i))) for i in a]
    other = [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and pair.b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, pair.b.id_to_piece(i)) for i in b)]
    if any(b"".join(x for _, x in s) != (" " + text).encode() for s in (own, other)):
        return [], []
    return own, other


def groups_of(text):
    own, other = pieces(text)
    ends = [set(np.cumsum([len(x) for _, x in s]).tolist()) for s in (own, other)]
    out = []
    for k, s in enumerate((own, other)):
        at, group = 0, 0
        for i, x in s:
            while len(out) <= group:
                out.append(([], []))
            out[group][k].append(i)
            at += len(x)
            group += at in ends[1 - k]
    return [g for g in out if g[0] or g[1]]


def plain(texts):
    found = [groups_of(t) for t in texts]
    links = [Counter((a, b) for g in doc for a in g[0] for b in g[1]) for doc in found]
    held = Counter(p for doc in links for p in doc)
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for doc, mine in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in doc)
        out.append((sum(len(a) for a, _ in doc), sum(len(b) for _, b in doc), len(doc), sum(mine.values()), sum(n for p, n in mine.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in mine.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, held


def test_rows_match_plain_loops(spark, tmp_path):
    folder = write(spark, tmp_path, [(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = al.op13_token_alignment(spark, folder).collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}
    want = plain(TEXTS)[0]
    assert got == dict(enumerate(want))
    assert [want[i][0] > 0 for i in (0, 1, 2, 6)] == [True, False, False, False]


def test_corpus_matches_plain_loops_in_many_blocks(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want, held = plain([r.text for r in rows])
    got = {r.doc_id: tuple(r)[1:] for r in al._aligned(docs.repartition(3), al.BYTE_LEVEL, al.PIECES, True, block_bytes=1 << 15).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, want)}
    counts = {(r.a, r.b): (r.n, r.best) for r in al.link_counts(docs).collect()}
    assert {k: n for k, (n, _) in counts.items()} == dict(held)


def test_large_groups_are_counted_before_they_are_linked(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 7, 500)
    group_a, group_b = np.sort(rng.integers(0, 6, 400)), np.sort(rng.integers(0, 6, 500))

    def counts():
        total = Counter()
        for g, x, y, n in zip(*(v.tolist() for v in al.linked(a, b, group_a, group_b))):
            total[g, x, y] += n
        return total

    monkeypatch.setattr(al, "LARGE", 1 << 30)
    by_token = counts()
    monkeypatch.setattr(al, "LARGE", 10)
    assert counts() == by_token and sum(by_token.values()) == sum((group_a == g).sum() * (group_b == g).sum() for g in range(6))


def test_groups_as_text_and_odd_rows(spark):
    docs = spark.createDataFrame(messy(), SCHEMA)
    got = al.align(docs).collect()
    assert len(got) == docs.count()
    want = plain([r.text for r in docs.collect()])[0]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_links, r.count_sum, digest(r.groups)) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, w[3], w[5], w[6]) for r, w in zip(docs.collect(), want))
    assert al.align(docs.limit(0)).count() == 0


def test_a_missing_file_raises(spark):
    with pytest.raises(Exception):
        al.align(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path_b="/nowhere.model").collect()


def test_words_are_encoded_as_in_their_text():
    """Texts of everything that could join two words: white space of all kinds, marks of spaces, bytes, accents, special tokens."""
    rng = np.random.default_rng(7)
    some = [" ", " ", " ", "\n", "\t", "a", "b", "é", "▁", "中", "😀", "'s", "'", "1", "23", "　", "\xa0", "​", "᠎", "\x00", "\x1f", "\x85", "fi", "ﬁ", "é", "<s>", "<0x0A>", "<unk>", " ", "the ", "  ", "<|endoftext|>"]
    texts = ["".join(some[i] for i in rng.integers(0, len(some), rng.integers(1, 16))) for _ in range(6000)]
    pair = al.loaded(al.BYTE_LEVEL, al.PIECES)
    rows, doc, code, often = al._block(texts, pair, digest=False)
    for k, text in enumerate(texts):
        own, other = pieces(text)
        assert rows[k][:2] == (len(own), len(other)), text
        sides = [x.split("|") for x in rows[k][4].split(";")] if rows[k][4] else []
        assert [int(i) for g in sides for i in g[0].split(",")] == [i for i, _ in own], text
        assert [int(i) for g in sides for i in g[1].split(",")] == [i for i, _ in other], text
    assert sum(r[0] > 0 for r in rows) > 4000
