"""Line dedup against plain loops."""

import hashlib
from collections import Counter

import pytest

from linkwright.llm import lines

from .fixtures import SCHEMA, messy, write


def plain_keys(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [x.strip(" \t\n\x0b\x0c\r").translate(low) for x in (text or "").split("\n")]


def plain(texts, documents=10, least=1):
    seen = Counter(k for t in texts for k in set(plain_keys(t)) if len(k) >= least)
    out = []
    for t in texts:
        kept = [x for x, k in zip((t or "").split("\n"), plain_keys(t)) if seen[k] < documents]
        out.append(((t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def texts():
    out = [f"own {i}\n  Shared Line\t\nÉTÉ\n\nnine {i % 2}" for i in range(18)]
    out += ["SHARED LINE", "\nshared line\nshared line\n", None, "", "\n", "été\n été", "x" * 300_000 + "\n\x0bshared line\x0c", "\x85shared line", "shared line", "\r\n".join(["a", "b", "shared line"])]
    return out + ["a\n" * 5000 + "shared line"]


def test_rows_match_plain_loops(spark, tmp_path):
    rows = [(i, t, None, "s", 1, 2, "k", "b", 1, 2) for i, t in enumerate(texts())]
    folder = write(spark, tmp_path, rows, SCHEMA)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.op12_line_dedup(spark, folder).collect()}
    assert got == dict(enumerate(plain(texts())))
    assert sum(x[1] for x in got.values()) > 20


@pytest.mark.parametrize(("documents", "least"), [(2, 1), (3, 12), (1, 1)])
def test_texts_of_the_operator_and_thresholds(spark, documents, least):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts())], "doc_id long, text string, n_lines int")
    got = lines.drop_lines(docs, documents, least)
    assert got.columns == ["doc_id", "text", "n_lines", "n_lines_", "n_dropped"]
    want = plain(texts(), documents, least)
    for r in got.collect():
        assert (r.n_lines_, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) == want[r.doc_id]
        assert (r.text is None) == (texts()[r.doc_id] is None) and r.n_lines == 5


def test_odd_rows(spark):
    docs = spark.createDataFrame(messy(), SCHEMA)
    got = lines.drop_lines(docs, 2)
    assert got.count() == docs.count()
    repeated = [r.text for r in got.filter("doc_id = 0").collect()]
    assert repeated == ["", ""]  # each row is a document of its own, so that their line is in two
    assert lines.drop_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lines.drop_lines(docs, 0)


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", "common\nown " + str(i)) for i in range(12)], "doc_id string, text string")
    assert {(r.doc_id, r.text) for r in lines.drop_lines(docs).collect()} == {(f"d{i}", f"own {i}") for i in range(12)}
