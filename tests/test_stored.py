"""What sinks write, sources give back."""

import pytest
from pyspark.sql import functions as F

from linkwright.plans import queries as base
from linkwright.plans import stored
from linkwright.sources import tables as A
from linkwright.sources.tables import ID, LEFT, RIGHT
from linkwright.sources.views import catalogue, table

from .conftest import DATA


def same(got, want):
    assert set(got.columns) == set(want.columns)
    rows = lambda d: sorted(map(repr, d.select(sorted(want.columns)).collect()))
    assert rows(got) == rows(want)


def test_catalogue(spark):
    """An empty text reads as null, the rest as it was."""
    want = catalogue(spark, DATA)
    same(stored.stored_catalogue(spark, DATA), want.select([F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in want.columns]))


def test_catalogue_of_odd_texts(spark, tmp_path):
    texts = [' lead and trail ', 'a "quoted" word', '"', '""', "two\nlines", "a,b;c\td", "\\", 'back\\"slash', "NA", "null", "", None, "é\u2028ü", "#", " ", "c\r\nd", "e\rf", "x" * 200000]
    df = spark.createDataFrame([(f"A_{i}", t, "z") for i, t in enumerate(texts)], "unique_id string, title string, last string")
    A.save_catalogue(df, f"{tmp_path}/a")
    got = {r[ID]: r["title"] for r in A.read_catalogue(spark, f"{tmp_path}/a", "A").collect()}
    assert got == {f"A_{i}": t or None for i, t in enumerate(texts)}


def test_file_with_other_line_ends(spark, tmp_path):
    """Files with CRLF read as files with LF do."""
    (tmp_path / "crlf.csv").write_bytes(b'id,title,last\r\n1,"a, b",z\r\n2,,y\r\n')
    assert [tuple(r) for r in A.read_catalogue(spark, f"{tmp_path}/crlf.csv", "B").orderBy(ID).collect()] == [("B_1", "a, b", "z"), ("B_2", None, "y")]


def test_candidates_and_scores(spark):
    same(stored.stored_candidates(spark, DATA), base._candidates(spark, DATA))
    same(stored.stored_pair_scores(spark, DATA), base._scored(spark, DATA).select(LEFT, RIGHT, "match_probability"))


def test_labels(spark):
    got = stored.stored_labels(spark, DATA).toPandas()
    truth = {tuple(r) for r in base._truth(spark, DATA).collect()}
    pairs = {tuple(r) for r in base._scored(spark, DATA).select(LEFT, RIGHT).collect()}
    assert {(r[LEFT], r[RIGHT]): r.label for _, r in got.iterrows()} == {p: int(p in truth) for p in pairs} and len(got) == len(pairs)
    assert (got.groupby(LEFT)["split"].nunique() == 1).all() and set(got["split"]) == set(stored.SPLITS)


def test_embeddings(spark, tmp_path):
    same(stored.stored_embeddings(spark, DATA), table(spark, DATA, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("vec")))
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0, 3.0])], "id long, vec array<double>")
    A.save_embeddings(df, f"{tmp_path}/v")
    asked = spark.createDataFrame([(2,), (3,), (3,)], "id long")
    assert {r["id"]: r["vec"] for r in A.read_embeddings(spark, f"{tmp_path}/v", asked).collect()} == {2: [2.0, 3.0], 3: None}
    A.save_embeddings(df.union(df), f"{tmp_path}/w")
    with pytest.raises(Exception, match="stored twice"):
        A.read_embeddings(spark, f"{tmp_path}/w").collect()
