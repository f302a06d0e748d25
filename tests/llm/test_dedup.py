import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from linkwright.llm import jaccard, phrases, suffix_dedup
from linkwright.llm.components import components, forest
from linkwright.llm.hashing import words_of

from .fixtures import SCHEMA, documents, messy, write


def removed_bytes(texts: list[bytes], length: int = 100):
    seen, masks = set(), []
    for text in texts:
        mask = bytearray(len(text))
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            if w in seen:
                mask[i : i + length] = b"\1" * length
            seen.add(w)
        masks.append(mask)
    return masks


def removed_words(docs: list[tuple[int, bytes]], window: int = 13):
    first, out = {}, []
    for order, text in docs:
        w = text.split()
        mask = [0] * len(w)
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i : i + window]), order) != order:
                mask[i : i + window] = [1] * window
        out.append((w, mask))
    return out


def test_suffix_dedup_query(spark, tmp_path):
    rows = documents()
    got = {r["doc_id"]: r for r in suffix_dedup.op3_suffix_dedup(spark, write(spark, tmp_path, rows)).collect()}
    texts = [(r[1] or "").encode() for r in rows]
    for r, text, mask in zip(rows, texts, removed_bytes(texts), strict=True):
        kept = bytes(x for x, m in zip(text, mask, strict=True) if not m)
        runs = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        assert got[r[0]][1:] == (len(text), sum(mask), runs, hashlib.sha256(kept).hexdigest())
    assert got[1]["n_removed"] == got[1]["n_bytes"] and got[10]["n_removed"] > 0 and got[6]["n_bytes"] == 0


def test_suffix_dedup_random_bytes(spark, tmp_path):
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab") for _ in range(130)) for _ in range(6)]
    rows = [(i, "".join(rng.choice([*parts, "x", "yz", "a" * 57]) for _ in range(12)), *documents()[0][2:]) for i in range(25)]
    got = {r["doc_id"]: r for r in suffix_dedup.op3_suffix_dedup(spark, write(spark, tmp_path, rows)).collect()}
    texts = [r[1].encode() for r in rows]
    for r, mask in zip(rows, removed_bytes(texts), strict=True):
        assert got[r[0]]["n_removed"] == sum(mask)


PERIODIC = ["a" * 120, "buy now, click here! " * 6, ("abcdefghijklmnopqrstuvwxy" * 5)[:112], "a" * 100, "a" * 101, "xy" * 84, "0123456789abcdefghijklmnopqrstuv" * 4, "z" * 168, "z" * 169]


@pytest.mark.parametrize("texts", [[t] for t in PERIODIC] + [PERIODIC, PERIODIC + PERIODIC[::-1]])
def test_suffix_dedup_of_short_periodic_texts(spark, texts):
    """Both anchors of a text can have the whole text as their context: that is one place, not a repeat."""
    docs = spark.createDataFrame(list(enumerate(texts)), "__rid long, text string").repartition(3)
    finish = lambda text, runs: ([j for s, e in runs for j in range(s, e)],)
    got = {r["__rid"]: r["gone"] for r in suffix_dedup._spans(docs, 100, finish, "gone array<long>", ["__rid"]).collect()}
    assert got == {i: [j for j, m in enumerate(mask) if m] for i, mask in enumerate(removed_bytes([t.encode() for t in texts]))}


def test_long_texts_are_cut_into_segments(monkeypatch, spark, tmp_path):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    rng = np.random.default_rng(5)
    data = bytes(rng.integers(97, 123, 4000).astype(np.uint8))
    block = [(1, data + data[500:900]), (2, data[100:400])]
    codes, offset, rid, begin, total, low, high = suffix_dedup._codes(100, 32)(block)
    assert set(total) == {len(block[0][1]), 300}
    starts = sorted((r, b + w - o) for r, b, o, lo, hi in zip(rid, begin, offset, low, high, strict=True) for w in range(lo, hi))
    assert starts == [(r, i) for r, t in block for i in range(len(t) - 99)]


@pytest.mark.parametrize("rows", [messy(), []])
def test_removers_keep_rows_and_columns(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for remove in (suffix_dedup.remove_repeats, phrases.remove_passages):
        out = remove(docs)
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        got = out.collect()
        assert len(got) == len(rows)
        assert sum(r["text"] is None for r in got) == sum(r[1] is None for r in rows)
    if rows:
        assert suffix_dedup.spans(docs).count() == len(rows)


def test_phrase_dedup_query(spark, tmp_path):
    rows = documents(2)
    got = {r["doc_id"]: r for r in phrases.op8_phrase_dedup(spark, write(spark, tmp_path, rows)).collect()}
    for r, (w, mask) in zip(rows, removed_words([(r[0], (r[1] or "").encode()) for r in rows]), strict=True):
        kept = b" ".join(x for x, m in zip(w, mask, strict=True) if not m)
        assert got[r[0]][1:] == (len(w), sum(mask), hashlib.sha256(kept).hexdigest())
    assert got[16]["n_removed"] == 40 and got[10]["n_removed"] == 0


def test_phrase_dedup_ignores_repeats_in_one_document(spark, tmp_path):
    text = " ".join(["x y"] * 60)
    rows = [(5, text, *documents()[0][2:]), (9, text, *documents()[0][2:])]
    got = {r["doc_id"]: r["n_removed"] for r in phrases.op8_phrase_dedup(spark, write(spark, tmp_path, rows)).collect()}
    assert got == {5: 0, 9: 120}


def stock(seed: int = 6, n: int = 60) -> list[str | None]:
    """Texts with stock phrases, shorter and longer than a window, between words of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    short, long = " ".join(word() for _ in range(8)), " ".join(word() for _ in range(20))
    texts = [" ".join(x for _ in range(1 + i % 9) for x in (*(word() for _ in range(12)), rng.choice([short, short, long]))) for i in range(n)]
    return [*texts, "", None, texts[7], long, texts[3] + texts[4]]


def gone(text, runs):
    return ([j for s, e in runs for j in range(s, e)],)


def keyed(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "__rid long, text string").repartition(3)


@pytest.mark.parametrize("heavy", [0, 20, 1 << 14])
def test_suffix_dedup_of_stock_phrases(spark, heavy):
    """With every anchor spread over groups, some, or none."""
    texts = stock()
    expected = {i: [j for j, m in enumerate(mask) if m] for i, mask in enumerate(removed_bytes([(x or "").encode() for x in texts]))}
    got = suffix_dedup._spans(keyed(spark, texts), 100, gone, "gone array<long>", ["__rid"], heavy=heavy).collect()
    assert {r["__rid"]: r["gone"] for r in got} == expected
    assert sum(len(x) > 0 for x in expected.values()) > 10


@pytest.mark.parametrize("shard", [1, 7, 1 << 15])
def test_phrase_dedup_of_stock_phrases(spark, shard):
    texts = stock()
    expected = {i: [j for j, m in enumerate(mask) if m] for i, (_, mask) in enumerate(removed_words(list(enumerate((x or "").encode() for x in texts))))}
    got = phrases._passages(keyed(spark, texts), 13, gone, "gone array<long>", ["__rid"], shard=shard).collect()
    assert {r["__rid"]: r["gone"] for r in got} == expected
    assert sum(len(x) > 0 for x in expected.values()) > 10


def test_refinement_alone_decides(monkeypatch):
    text = stock()[7].encode()
    args = ([text[:168]], np.zeros(3, np.int64), np.array([4, 9, 9]), np.array([0, 0, 30]), 100)
    (rid, start, end), whole = suffix_dedup.repeated(*args)
    assert rid.tolist() == [9] and (start[0], end[0]) == (0, 198) and whole.tolist() == [False, True, True]
    monkeypatch.setattr(suffix_dedup, "refine", lambda ids, places, *_: places[:0])
    (rid, _, _), whole = suffix_dedup.repeated(*args)
    assert not len(rid) and not whole.any()


@pytest.mark.parametrize("length", [4, 7, 25, 100])
def test_refinement_against_all_windows(length):
    rng = random.Random(length)
    payloads = [bytes(rng.choice(b"ab") for _ in range(length + rng.randrange(2 * length))) for _ in range(40)] + [b"a" * 3 * length]
    rid, low = np.arange(len(payloads)) % 5, np.arange(len(payloads)) * 1000
    (r, s, e), whole = suffix_dedup.repeated(payloads, np.arange(len(payloads)), rid, low, length)
    first, expected, all_of = {}, set(), []
    at = sorted((int(rid[k]), int(low[k]) + i, p[i : i + length]) for k, p in enumerate(payloads) for i in range(len(p) - length + 1))
    again = set()
    for x, i, w in at:
        if first.setdefault(w, (x, i)) != (x, i):
            again.add((x, i))
            expected |= {(x, j) for j in range(i, i + length)}
    all_of = [all((int(rid[k]), int(low[k]) + i) in again for i in range(len(p) - length + 1)) for k, p in enumerate(payloads)]
    assert {(x, j) for x, a, b in zip(r.tolist(), s.tolist(), e.tolist(), strict=True) for j in range(a, b)} == expected
    assert whole.tolist() == all_of


def test_names_of_last_buckets_are_those_of_windows():
    data = np.random.default_rng(1).integers(97, 99, 3000).astype(np.uint8)
    starts = np.arange(len(data) - 3 + 1)
    names = suffix_dedup.deepen(suffix_dedup.span(suffix_dedup.prefix(suffix_dedup.BYTE_CODES[data]), starts, starts + 3), 3, 11)
    windows = [data[i : i + 11].tobytes() for i in range(len(data) - 10)]
    assert len(names) == len(windows) and len(set(zip(names.tolist(), windows, strict=True))) == len(set(windows)) == len(set(names.tolist()))


def test_automata_find_every_occurrence():
    firsts = np.array([3, 5, 8, 3, 9])
    compiled = phrases.automata([b"a b c d", b"b c d", b"a b c d"], firsts, 3, shard=1)
    assert len(compiled[1]) == 2
    texts = [b"x a b c d y b c d", None, b"b c", b"d b c d"]
    start, place, first = phrases.occurrences(texts, compiled, 3)
    assert first.tolist() == [0, 10, 11, 14, 19]
    assert sorted(zip(start.tolist(), place.tolist(), strict=True)) == [(1, 0), (2, 1), (6, 1), (15, 1)]
    assert phrases.covered_runs(texts, [5, 0, 0, 0], compiled, 3) == [[(1, 4)], [], [], []]
    assert phrases.covered_runs(texts, [6, 0, 0, 9], compiled, 3) == [[(1, 5)], [], [], [(1, 4)]]
    assert phrases.covered_runs(texts, [9, 9, 9, 8], compiled, 3) == [[(1, 5), (6, 9)], [], [], []]
    assert phrases.covered_runs(texts, [9] * 4, phrases.automata([], firsts[:0], 3), 3) == [[]] * 4
    assert phrases.covered_runs([], [], compiled, 3) == []


def test_phrases_are_runs_of_shared_windows():
    got = dict(phrases.confirm([7, 2, 4], [False, False, True], [b"p a b c d q", b"r a b c d", b"x y z w"], 3))
    assert got == {b"a b c d": [2, 2], b"x y z w": [4, 4]}


def linked(rows):
    sets = [set(s.tolist()) for s in jaccard.shingle_sets([r[1] for r in rows])]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                links[i].add(j)
                links[j].add(i)
    return links


def reach(links, i):
    seen, todo = {i}, [i]
    while todo:
        new = links[todo.pop()] - seen
        seen |= new
        todo += new
    return seen


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_join_against_brute_force(spark, block):
    rng = random.Random(8)
    base = [f"v{rng.randrange(300)}" for _ in range(150)]
    rows = list(documents(4))
    for i in range(30):
        near = list(base)
        for _ in range(rng.randrange(0, 6)):
            near[rng.randrange(len(near))] = f"q{rng.randrange(50)}"
        rows.append((100 + i, " ".join(near), *rows[0][2:]))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("__rid", __import__("pyspark").sql.functions.col("doc_id"))
    got = {r["rid"]: r for r in jaccard.join(docs, block=block).collect()}
    links = linked(rows)
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        assert got[r[0]]["n_links"] == len(links[i]), r[0]
        assert got[r[0]]["component"] == min(rows[j][0] for j in reach(links, i))
    assert max(len(v) for v in links.values()) > 10


def test_jaccard_join_of_messy_and_empty_tables(spark, tmp_path):
    out = jaccard.op10_jaccard_join(spark, write(spark, tmp_path, messy()))
    assert out.count() == len(messy()) and out.filter("doc_id = 0").count() == 2
    assert jaccard.op10_jaccard_join(spark, write(spark, tmp_path, [])).count() == 0
    docs = spark.createDataFrame(messy(), SCHEMA)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 0").count() <= 1


def test_words_are_lower_cased_runs_of_letters_and_digits():
    hashes, first, _, _ = words_of(["A b".lower().encode(), b"a  b"])
    assert first.tolist() == [0, 2, 4] and hashes[0] == hashes[2] and hashes[1] == hashes[3]
    assert [len(s) for s in jaccard.shingle_sets([None, "", "one", "a b c d e f"])] == [0, 0, 1, 2]


def test_pruning_keeps_what_may_reach_the_threshold():
    assert jaccard.least_matches(20, 0.8, 1e-6) < 12 < jaccard.least_matches(180, 0.8, 1e-6) < 144


def test_forest_names_components():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, 200) * 7, rng.integers(0, 300, 200) * 7
    links = defaultdict(set)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        links[x].add(y)
        links[y].add(x)
    got = dict(forest(a, b).T.tolist())
    assert got == {x: min(reach(links, x)) for x in links if min(reach(links, x)) != x}
    assert forest(a[:0], b[:0]).shape == (2, 0)


def test_loosely_similar_pages_do_not_grow_into_one_cluster(monkeypatch, spark):
    """A chain of pages, each at 0.55 to the next: bands join them, the pairs of buckets don't."""
    rng = random.Random(4)
    page, texts = [f"c{rng.randrange(10**6)}" for _ in range(120)], []
    for _ in range(300):
        at = rng.randrange(0, 90)
        page = page[:at] + [f"c{rng.randrange(10**6)}" for _ in range(30)] + page[at + 30 :]
        texts.append(" ".join(page))
    clusters = []
    monkeypatch.setattr(jaccard, "components", lambda edges: clusters.append(components(edges)) or clusters[-1])
    got = jaccard.join(keyed(spark, texts)).collect()
    assert all(r["n_links"] == 0 and r["component"] == r["rid"] for r in got)
    assert clusters[0].count() < 30


@pytest.mark.parametrize("limits", [{"BUCKET": 3}, {"SENT": 1}])
def test_large_buckets_lose_no_link(monkeypatch, spark, limits):
    rng = random.Random(9)
    base = [f"v{rng.randrange(300)}" for _ in range(150)]
    rows = []
    for i in range(40):
        near = list(base)
        for _ in range(rng.randrange(0, 8)):
            near[rng.randrange(len(near))] = f"q{rng.randrange(50)}"
        rows.append((i, " ".join(near)))
    for k, v in limits.items():
        monkeypatch.setattr(jaccard, k, v)
    links = linked(rows)
    assert {r["rid"]: r["n_links"] for r in jaccard.join(keyed(spark, [r[1] for r in rows])).collect()} == {i: len(links[i]) for i in range(40)}
