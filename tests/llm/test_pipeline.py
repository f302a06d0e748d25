import numpy as np
import pytest

from linkwright.llm import bpe

from .fixtures import SCHEMA, documents, messy, write

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.createDataFrame(documents(), SCHEMA)
    rows = {r["doc_id"] for r in docs.collect()}
    told = corpus_pipeline.identified(spark, docs, "")
    gone = rows - {r["doc_id"] for r in told.collect()}
    assert gone == {6, 7, 8, 14}
    distinct = corpus_pipeline.distinct(spark, told, "")
    assert {0} == {r["doc_id"] for r in distinct.filter("doc_id < 3").collect()}
    cut = corpus_pipeline.without_repeats(spark, distinct, "")
    assert cut.count() == distinct.count() and cut.columns == docs.columns
    mixed = corpus_pipeline.mixed(spark, cut, "")
    assert mixed.columns == docs.columns
    texts = [r["text"].encode() for r in mixed.collect()]
    ids = corpus_pipeline.encoded(spark, mixed, "").collect()
    back = [bpe.decode_ids(r["ids"], bpe.VOCABULARY) for r in ids]
    assert sorted(back) == sorted(texts) and all(r["n_tokens"] == len(np.frombuffer(r["ids"], "<u4")) for r in ids)


@pytest.mark.parametrize("rows", [messy(), []])
def test_run(spark, tmp_path, rows):
    out = corpus_pipeline.run(spark, write(spark, tmp_path, rows))
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    assert (out.count() > 0) == bool(rows)


def test_junk_and_mixed_texts_go(spark):
    rng = np.random.default_rng(7)
    syllables = {"en": "the ing ou er and th in on at es".split(), "es": "ción de la os que mi ra ar ez ado".split()}
    prose = lambda lang, n: " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(n))
    noise = lambda n: " ".join("".join(rng.choice(list("qxzjkvwpfyhgcb"), 6)) for _ in range(n))
    rows = [(i, prose(("en", "es")[i % 2], 120), ("en", "es")[i % 2]) for i in range(200)]
    rows += [(900, noise(100), "en"), (901, noise(20), None), (902, prose("en", 200) + ". " + prose("es", 200), "en"), (903, "1234 !?", "en"), (904, prose("en", 60), None), (905, prose("es", 3), "es")]
    docs = spark.createDataFrame([(*r, "s", 1, "their own", "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __found string, __rid string")
    kept = corpus_pipeline.identified(spark, docs, "")
    assert kept.columns == docs.columns
    got = {r["doc_id"]: r for r in kept.collect()}
    assert set(range(200)) | {904, 905} == set(got) and got[904]["lang"] == "en" and {r["__found"] for r in got.values()} == {"their own"}


def test_stages_keep_columns_that_clash(spark):
    """Columns named like those that operators use inside come out as they went in; ids may be text."""
    names = ["__rid", "__size", "__id", "__n", "__words", "__lid", "__found", "__other_0", "rendered", "rid", "c0", "key"]
    rows = [(f"d{i}", r[1], r[2], r[3], r[4], *[f"{n}{i}" for n in names]) for i, r in enumerate(documents())]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for stage in (corpus_pipeline.identified, corpus_pipeline.distinct, corpus_pipeline.without_repeats, corpus_pipeline.mixed):
        docs = stage(spark, docs, "")
        assert docs.columns[5:] == names
        got = docs.collect()
        assert got and all(r[n] == f"{n}{r['doc_id'][1:]}" for r in got for n in names)
    assert {r["doc_id"] for r in corpus_pipeline.encoded(spark, docs, "").collect()} == {r["doc_id"] for r in got}
