"""The operators that SQL can express against that SQL in DuckDB."""

import duckdb
import pytest

from linkwright.llm import queries as llm

from ..test_queries import plain
from .fixtures import documents, write


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_operator_matches_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    assert plain(llm.queries()[name](spark, data).toPandas()) == plain(con.execute(llm.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in llm.oracle_sql() if n not in ("op2_embedding_join", "op7_top_k")))
def test_odd_documents_match_sql(spark, tmp_path, name):
    folder = write(spark, tmp_path, documents())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert plain(llm.queries()[name](spark, folder).toPandas()) == plain(con.execute(llm.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ("op2_embedding_join", "op7_top_k"))
def test_odd_vectors_match_sql(spark, tmp_path, name):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0, -0.5 * (i % 3)]) for i in range(120)]
    rows += [(200, None), (250, [0.0, 0.0, 0.0]), (300, [1.0, None, 0.0]), (350, [nan, 1.0, 0.0]), (400, [inf, 1.0, 0.0]), (450, [1e-3, 2e-3, 0.0])]
    folder = write(spark, tmp_path, rows, "vec_id long, embedding array<float>", "embeddings")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    assert plain(llm.queries()[name](spark, folder).toPandas()) == plain(con.execute(llm.oracle_sql()[name]).df())
