import tracemalloc

import numpy as np
import pandas as pd
import pytest

from linkwright.llm import components, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, id long, dim int, unit string"


def table(spark, folder, rows):
    spark.createDataFrame([(i, v, 0, 1, 2, "u") for i, v in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def some(n=220, d=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, d))
    x = centres[rng.integers(0, 8, n)] + 0.35 * rng.standard_normal((n, d))
    x[:40] = rng.standard_normal((40, d))
    x[50:70] = x[50] * rng.uniform(0.5, 2, (20, 1))
    return [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(n * 3)[:n], x, strict=True)]


ODD = [(5001, None), (5002, []), (5003, [0.0] * 12), (5004, [float("nan")] + [1.0] * 11), (5005, [None] + [1.0] * 11), (5006, [float("inf")] + [1.0] * 11), (5007, [1.0, 2.0]), (5008, [2.0, 4.0])]


@pytest.mark.parametrize("block,cell", [(8192, 4096), (16, 20)])
def test_range_join_against_brute_force(spark, tmp_path, block, cell):
    rows = some()
    df = spark.createDataFrame([(i, v) for i, v in rows + ODD], "id long, vector array<double>")
    got = {r["id"]: r for r in vectors.range_join(df, block=block, cell_rows=cell).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    label = components.local_forest(len(rows), ((i, np.flatnonzero(h)) for i, h in enumerate(hit) if h.any()))
    ids = np.array([i for i, _ in rows])
    for k, (i, _) in enumerate(rows):
        assert got[i]["n_links"] == hit[k].sum()
        assert got[i]["component"] == ids[label == label[k]].min()
    assert hit.sum() > 100
    assert {i: got[i]["n_links"] for i, _ in ODD} == {5001: 0, 5002: 0, 5003: 0, 5004: 0, 5005: 0, 5006: 0, 5007: 1, 5008: 1}


def test_join_query_with_repeated_and_null_ids(spark, tmp_path):
    rows = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [0.9, 0.1]), (None, [0.0, 1.0]), (None, None)]
    got = sorted(vectors.op2_embedding_join(spark, table(spark, tmp_path, rows)).collect(), key=str)
    assert sorted(r["n_links"] for r in got) == [0, 0, 2, 2, 2]
    assert {r["component_id"] for r in got if r["vec_id"] in (1, 3)} == {1}
    assert vectors.op2_embedding_join(spark, table(spark, tmp_path, [])).count() == 0


def expected_top(rows, k=5):
    x = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows}
    out = {}
    for q in (i for i in x if i % 50 == 0):
        scored = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


@pytest.mark.parametrize("block,cell", [(8192, 4096), (16, 20)])
def test_top_k_against_brute_force(spark, block, cell):
    rows = [(i * 10 if k % 3 else i, v) for k, (i, v) in enumerate(some(300))]
    rows = list(dict(rows).items())
    df = spark.createDataFrame([(i, v) for i, v in rows], "id long, vector array<double>")
    got = vectors.top_k(df, "id % 50 = 0", block=block, cell_rows=cell).toPandas().sort_values(["query", "rank"])
    found = {q: list(zip(g.id, g.score, strict=True)) for q, g in got.groupby("query")}
    assert found == expected_top(rows)


def test_top_k_query_on_odd_tables(spark, tmp_path):
    rows = [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (51, None), (100, [float("nan"), 1.0])]
    got = [tuple(r) for r in vectors.op7_top_k(spark, table(spark, tmp_path, rows)).orderBy("query_id", "rank").collect()]
    assert got == [(50, 1, 1, 65536), (50, 2, 2, 65536)]
    again = vectors.op7_top_k(spark, table(spark, tmp_path, [*rows[:3], rows[0], (None, [1.0, 0.0])]))
    assert again.filter("query_id = 50").count() == 8
    assert vectors.op7_top_k(spark, table(spark, tmp_path, [])).count() == 0


def test_large_components_count_exactly():
    q = np.array([[2.0**30, 3.0], [1.0, 1.0]])
    assert vectors.exact_scores(q, q)[0][0] == 2**60 + 9


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(7, k) for k in range(20, 60)] + [(5, 5), (7, 20)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(100, 131)} == {100} and {got[k] for k in range(20, 60)} == {7} and 5 not in got


def test_usable():
    assert vectors.usable(None) is None and vectors.usable([1.0, None]) is None and vectors.usable(np.array([1.0, 2.0])).tolist() == [1, 2]
    assert isinstance(vectors._link_unit(pd.DataFrame({"side": [0, 0], "id": [4, 2], "dim": [1, 1], "vector": [np.array([1.0]).tobytes()] * 2}), 0.9, 1), pd.DataFrame)


@pytest.mark.parametrize("top", [1e8, 1e12])
def test_top_k_of_large_components(spark, top):
    """Scores beyond 2**53 are exact; one beyond 64 bits in a result raises, elsewhere it doesn't matter."""
    rows = [(i, [float(i % 11) - 5, 0.125 * i, 1.0]) for i in range(60)] + [(99, [-top, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    whole = {i: [int(np.floor(256 * c)) for c in x] for i, x in rows}
    got = {}
    for r in vectors.top_k(v, "id % 50 = 0").collect():
        got.setdefault(r["query"], []).append((-r["score"], r["id"]))
    for q in (0, 50):
        expected = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:5]
        assert sorted(got[q]) == expected
    wide = spark.createDataFrame([(0, [top * 1e3]), (1, [top * 1e3])], "id long, vector array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        vectors.top_k(wide, "id = 0").collect()
    with pytest.raises(Exception, match="component"):
        vectors.top_k(spark.createDataFrame([(0, [1e307]), (1, [1.0])], "id long, vector array<double>"), "id = 0").collect()


def test_queries_go_only_where_their_floor_can_be_reached(monkeypatch, spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 6)) * 40
    data = centres[rng.integers(0, 12, 1200)] + rng.standard_normal((1200, 6)) * 0.2
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(data)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in vectors.top_k(v, "id % 50 = 0", cell_rows=100).collect()}
    whole = np.floor(256 * data).astype(np.int64)
    for q in range(0, 1200, 50):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(1200), -s)) if i != q][:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, int(s[i])) for i in order]
    assert vectors.pivots_for(10**9, 4096) > 30_000 and vectors.pivots_for(50_000, 4096) == 12


def test_rows_by_many_pivots_stay_within_a_bound(monkeypatch):
    """With 30,000 pivots (9e8 vectors) matrices of a batch's rows by pivots hold CELLS entries, whatever the batch."""
    rng = np.random.default_rng(4)
    pivots, rows = rng.standard_normal((30000, 16)), pd.DataFrame({"v": list(rng.standard_normal((1000, 16)))})
    sizes = []

    def nearest(t):
        d = vectors.distances(np.stack(t.v.to_list()), pivots)
        sizes.append(d.size)
        return pd.DataFrame({"home": d.argmin(axis=1)})

    tracemalloc.start()
    got = pd.concat(vectors.in_chunks(nearest, len(pivots))([rows, rows.iloc[:0]]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1000 and max(sizes) <= vectors.CELLS and peak < 8 * 8 * vectors.CELLS
    monkeypatch.setattr(vectors, "DEALT", 10)
    frames = list(vectors.dealing(lambda t: ((i, x) for i in range(len(t)) for x in range(7)), 1, ["a", "b"])([rows.iloc[:5], rows.iloc[:0]]))
    assert [len(f) for f in frames] == [10, 10, 10, 5]


def test_pivots_in_two_levels():
    """Many pivots are distinct rows of the sample, as many as asked for where it has them, and cover it well."""
    rng = np.random.default_rng(5)
    sample = np.concatenate([rng.standard_normal((4000, 8)), np.repeat(rng.standard_normal((1, 8)), 500, axis=0)])
    chosen = vectors.choose_pivots(sample, 1000)
    assert 900 <= len(chosen) <= 1000 and len(np.unique(chosen, axis=0)) == len(chosen)
    assert {tuple(x) for x in chosen} <= {tuple(x) for x in sample}
    widest = lambda p: vectors.distances(sample, p).min(axis=1).max()
    assert widest(chosen) <= 2 * widest(sample[vectors._farthest(sample, 1000)])
    assert len(vectors.choose_pivots(sample[-500:], 400)) == 1 and not len(vectors.choose_pivots(sample[:0], 4))


def test_join_and_search_with_many_pivots(spark, monkeypatch):
    """Results don't depend on how pivots are chosen."""
    monkeypatch.setattr(vectors, "FEW", 4)
    rows = some(150)
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = {r["id"]: r["n_links"] for r in vectors.range_join(df, block=16, cell_rows=5).collect()}
    assert got == dict(zip(ids.tolist(), near.sum(axis=1).tolist(), strict=True))
    whole = np.floor(256 * x).astype(np.int64)
    scores = whole @ whole.T
    want = {(int(ids[q]), int(ids[c])) for q in np.flatnonzero(ids % 5 == 0) for c in sorted((c for c in range(len(x)) if c != q), key=lambda c: (-scores[q, c], ids[c]))[:5]}
    assert {(r["query"], r["id"]) for r in vectors.top_k(df, "id % 5 = 0", block=16, cell_rows=5).collect()} == want
