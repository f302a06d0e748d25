"""Every query against its SQL in DuckDB on the smallest tables, and the driver's contract."""

import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as driver
from linkwright.plans import queries as linkage

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: "~" if v is None or (isinstance(v, float) and np.isnan(v)) else f"{float(v):.6g}" if isinstance(v, (float, np.floating)) else str(v))
    return list(df.columns), sorted(map(tuple, df.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(linkage.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = plain(linkage.queries()[name](spark, DATA).toPandas())
    spark.catalog.clearCache()
    assert got == plain(duck.execute(linkage.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(linkage.queries()) - set(linkage.oracle_sql())))
def test_other_queries_run(spark, name):
    assert linkage.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert driver.entry(spark).columns == ["unique_id_l", "unique_id_r", "bits"]
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_the_rest_needs_no_llm(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("linkwright.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "linkwright.llm", None)
    assert driver.queries().keys() == linkage.queries().keys()
