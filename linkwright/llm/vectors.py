"""Exact joins and searches over vectors through distances to pivots."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RID, checkpoint, modest_batches, parts_for, slices, table, with_rid
from .components import components, local_forest

#: Vectors in one side of a unit of work, rows that pivots are chosen from for each pivot (and in all, at least).
BLOCK, PIVOT_SAMPLE, PER_PIVOT = 8192, 2048, 4
#: The largest component that top_k takes, and the score that stands for one beyond 64 bits until the end.
LARGEST, BEYOND = 2.0**500, 2**63 - 1
#: Pivots that are chosen in one level, and entries of a matrix of rows by pivots (32 MB of doubles).
FEW, CELLS = 256, 1 << 22
#: Rows of a frame that goes back to Spark while vectors are dealt to units.
DEALT = 16384
_UNIT = "unit string, side int, id long, dim int, vector binary"


def usable(vector) -> np.ndarray | None:
    """The vector in double precision; None if it is null, empty, or has a null or non-finite component."""
    if vector is None:
        return None
    x = np.array([np.nan if c is None else c for c in vector], dtype=np.float64) if not isinstance(vector, np.ndarray) or vector.dtype == object else vector.astype(np.float64)
    return x if len(x) and np.isfinite(x).all() else None


def _farthest(sample: np.ndarray, n: int) -> np.ndarray:
    """Indexes of up to n rows, each farthest from those before it."""
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and gap.max() > 1e-12:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of the sample that lie far from each other.

    Beyond FEW of them in two levels: about the root of n rows first, then each one's share among the rows nearest to it,
    so that the time grows with the sample times the root of n. Every distinct row can be chosen.
    """
    if len(sample) < 2 or n <= FEW:
        return sample[_farthest(sample, n)] if len(sample) else sample
    first = sample[_farthest(sample, int(n**0.5))]
    home = np.concatenate([distances(x, first).argmin(axis=1) for x in chunks(sample, len(first))])
    shares = np.diff(np.floor(np.cumsum(np.bincount(home, minlength=len(first))) * (n / len(sample))).astype(int), prepend=0)
    return np.concatenate([sample[rows][_farthest(sample[rows], max(1, int(shares[h])))] for h, rows in slices(home)])[:n]


def chunks(x, across: int):
    """Pieces of x (rows of an array or frame), so that a matrix of a piece's rows by ``across`` has at most CELLS entries."""
    step = max(1, CELLS // max(1, across))
    for lo in range(0, len(x), step):
        yield x[lo : lo + step]


def in_chunks(function, across: int):
    """A function over batches, from one over frames that makes matrices of their rows by ``across``."""

    def run(batches):
        for t in batches:
            for piece in chunks(t, across):
                yield function(piece.reset_index(drop=True))

    return run


def dealing(function, across: int, columns: list[str]):
    """The same from one that yields tuples; frames of them hold at most DEALT rows, however many a piece deals."""

    def run(batches):
        for t in batches:
            for piece in chunks(t, across):
                rows = function(piece.reset_index(drop=True))
                while some := list(islice(rows, DEALT)):
                    yield pd.DataFrame(some, columns=columns)

    return run


def pivots_for(n: int, cell_rows: int) -> int:
    """How many pivots n vectors get: cells hold about cell_rows of them, or the root of n where that is more.

    Pivots and what is collected to choose them so grow as the root of n (for 1e9 vectors 31,000 pivots, 16 MB at 64
    components), and a row's distances to all pivots stay affordable.
    """
    return max(4, n // max(cell_rows, int(n**0.5)))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _prepared(rows: DataFrame, unit_length: bool) -> DataFrame:
    """(id, dim, vector: packed doubles) of usable vectors, scaled to unit length or turned into integers."""

    def clean(batches):
        for t in batches:
            out = []
            for i, v in zip(t.id, t.vector, strict=True):
                x = usable(v)
                if x is not None and unit_length:
                    top = np.abs(x).max()
                    x = x / top if top > 0 else None
                    x = None if x is None else x / np.linalg.norm(x)
                elif x is not None:
                    if np.abs(x).max() >= LARGEST:
                        raise OverflowError(f"row {i} has a component of {LARGEST:g} or more")
                    x = np.floor(256 * x)
                if x is not None:
                    out.append((i, len(x), x.tobytes()))
            yield pd.DataFrame(out, columns=["id", "dim", "vector"])

    return rows.mapInPandas(clean, "id long, dim int, vector binary")


def _sample(clean: DataFrame, n: int, width: int) -> np.ndarray:
    got = clean.orderBy(F.xxhash64("id")).limit(n).toPandas()
    return _matrix(unpack_each(got.vector), width)


def unpack_each(blobs) -> list[np.ndarray]:
    return [np.frombuffer(b, np.float64) for b in blobs]


def _link_unit(t: pd.DataFrame, floor: float, width: int, block: int = 1024) -> pd.DataFrame:
    """Links between both sides of a unit (within it, where all rows are of side 0): counts and a spanning forest."""
    left, right = t[t.side == 0], t[t.side == 1]
    within = not len(right)
    right = left if within else right
    a, b = _matrix(unpack_each(left.vector), width), _matrix(unpack_each(right.vector), width)
    da, db = left.dim.to_numpy(), right.dim.to_numpy()
    n = len(a) if within else len(a) + len(b)
    ids = left.id.to_numpy() if within else np.concatenate([left.id.to_numpy(), right.id.to_numpy()])
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    counts = np.zeros(n, np.int64)

    def found():
        for lo in range(0, len(a), block):
            hit = a[lo : lo + block] @ b.T >= floor
            if (da != da[0]).any() or (db != da[0]).any():
                hit &= da[lo : lo + block, None] == db[None, :]
            if within:
                hit[np.arange(len(hit)), np.arange(lo, lo + len(hit))] = False
                counts[:] += np.bincount(np.arange(lo, lo + len(hit)), hit.sum(axis=1), n).astype(np.int64)
            else:
                counts[lo : lo + len(hit)] += hit.sum(axis=1)
                counts[len(a) :] += hit.sum(axis=0)
            for i in np.flatnonzero(hit.any(axis=1)):
                yield rank[lo + i], rank[np.flatnonzero(hit[i]) + (0 if within else len(a))]

    label = local_forest(n, found())
    with_links = counts > 0
    return pd.DataFrame({"id": ids[with_links], "n": counts[with_links], "least": ids[order[label[rank[with_links]]]]})


def range_join(vectors: DataFrame, floor: float = 0.9, block: int = BLOCK, cell_rows: int = 4096) -> DataFrame:
    """(id, n_links, component) of each row (id unique, vector array): links are pairs with cosine of floor or more.

    On the unit sphere cosine >= floor is distance <= r. A row belongs to the cell of its nearest pivot; two rows
    within r in cells i and j are compared in one of the two cells, to which the triangle inequality brings every row
    whose distance to that cell's pivot is at most 2r above its nearest. Large cells are worked off in blocks.
    Unusable, zero and differently long vectors link with nothing; equal vectors link with each other.
    """
    clean = checkpoint(_prepared(modest_batches(vectors.select("id", "vector")), unit_length=True))
    n, width = clean.agg(F.count("*"), F.max("dim")).first()
    if not n:
        return vectors.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    number = pivots_for(n, cell_rows)
    pivots = choose_pivots(_sample(clean, max(PIVOT_SAMPLE, PER_PIVOT * number), width), number)
    r = float(np.sqrt(max(0.0, 2 - 2 * floor))) + 1e-9
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(pivots)

    def cells(ids, blobs):
        d = distances(_matrix(unpack_each(blobs), width), sent.value)
        home = d.argmin(axis=1)
        return d, home

    def owner(i, j):
        return np.where((i + j) % 2 == 0, np.minimum(i, j), np.maximum(i, j))

    def visits(d, home, reach):
        cell = np.arange(d.shape[1])
        near = (d <= d[np.arange(len(d)), home][:, None] + 2 * r) & (d <= reach[None, :] + r)
        return near & (owner(home[:, None], cell[None, :]) == cell[None, :]) & (home[:, None] != cell[None, :])

    def measure(t):
        d, home = cells(t.id, t.vector)
        return pd.DataFrame({"cell": home, "reach": d[np.arange(len(d)), home], "n": 1}).groupby("cell", as_index=False).agg({"reach": "max", "n": "sum"})

    reach, homes = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for x in clean.mapInPandas(in_chunks(measure, len(pivots)), "cell long, reach double, n long").groupBy("cell").agg(F.max("reach").alias("reach"), F.sum("n").alias("n")).collect():
        reach[x["cell"]], homes[x["cell"]] = x["reach"], x["n"]

    def guests(t):
        d, home = cells(t.id, t.vector)
        found = visits(d, home, reach).sum(axis=0)
        return pd.DataFrame({"cell": np.flatnonzero(found), "n": found[found > 0]})

    foreign = np.zeros(len(pivots), np.int64)
    for x in clean.mapInPandas(in_chunks(guests, len(pivots)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        foreign[x["cell"]] = x["n"]
    home_blocks, guest_blocks = -(-np.maximum(homes, 1) // block), -(-np.maximum(foreign, 1) // block)

    def deal(t):
        d, home = cells(t.id, t.vector)
        visit = visits(d, home, reach)
        mixed = t.id.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        for k, row in enumerate(t.itertuples(index=False)):
            c, value = int(home[k]), (row.id, row.dim, row.vector)
            nb = int(home_blocks[c])
            a = int(mixed[k] % nb)
            yield from ((f"{c}/{min(a, x)}/{max(a, x)}", int(x < a), *value) for x in range(nb))
            if foreign[c]:
                yield from ((f"{c}/{a}/g{x}", 0, *value) for x in range(int(guest_blocks[c])))
            for g in np.flatnonzero(visit[k]):
                x = int(mixed[k] % int(guest_blocks[g]))
                yield from ((f"{g}/{b}/g{x}", 1, *value) for b in range(int(home_blocks[g])))

    def unit(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        first, _, second = key[0].partition("/")[2].partition("/")
        if first != second and (not (t.side == 1).any() or not (t.side == 0).any()):
            return pd.DataFrame({"id": [], "n": [], "least": []})
        return _link_unit(t, floor, width)

    found = checkpoint(clean.mapInPandas(dealing(deal, len(pivots), [x.split()[0] for x in _UNIT.split(", ")]), _UNIT).groupBy("unit").applyInPandas(unit, "id long, n long, least long"))
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    groups = components(found.select(F.col("id").alias("u"), F.col("least").alias("v")))
    out = vectors.select("id").join(links, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", F.col("id")).alias("component"))


def keyed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id unique, key, vector) of each row; keys that are no integers stay text, in whose order ids are."""
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    df = df.select(F.col(key).cast("long" if whole else "string").alias("key"), F.col(vector).alias("vector"))
    return with_rid(df, "key", "vector").select(F.col(RID).alias("id"), "key", "vector")


def op2_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat a vec_id or lack one keep a row each; component_id is then the vec_id of the least such row."""
    rows = keyed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    joined = range_join(rows)
    named = joined.join(rows.select("id", F.col("key").alias("vec_id")), "id")
    names = rows.select(F.col("id").alias("component"), F.col("key").alias("component_id"))
    out = named.join(names, "component")
    return out.select("vec_id", "n_links", "component_id", (F.col("id") == F.col("component")).alias("kept"))


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products: by double products while every sum stays below 2**53, else in Python integers."""
    if not len(q) or not len(v) or float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2**53:
        return (q @ v.T).astype(np.int64)
    whole = lambda x: np.array([[int(c) for c in row] for row in x], dtype=object)
    return whole(q) @ whole(v).T


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_unit(queries: np.ndarray, query_ids, floors: np.ndarray, v: np.ndarray, ids: np.ndarray, pivot: np.ndarray, top_norm: float, k: int, annulus: int = 512):
    """The k best of v for each query that can reach its floor, walking annuli around the pivot outward from the query.

    With all norms raised to M by one more component, <q, v> = (|q|^2 + M^2 - d(q, v)^2) / 2, and d(q, v) is at least
    the difference of both distances to the pivot. An annulus that can't reach the k-th score so far ends its direction.
    """
    extra = lambda x: np.sqrt(np.maximum(top_norm**2 - (x**2).sum(axis=1), 0))
    lifted = np.column_stack([v, extra(v)])
    far = np.sqrt(np.maximum(((lifted - pivot) ** 2).sum(axis=1), 0))
    order = np.argsort(far, kind="stable")
    v, ids, far = v[order], ids[order], far[order]
    edges = list(range(0, len(v), annulus))
    rings = [(far[e], far[min(e + annulus, len(v)) - 1], e) for e in edges]
    dq = np.sqrt(np.maximum(((np.column_stack([queries, np.zeros(len(queries))]) - pivot) ** 2).sum(axis=1), 0))
    best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in query_ids]
    floor = floors.astype(np.float64).copy()
    square = (queries**2).sum(axis=1) + top_norm**2
    low, high = np.array([r[0] for r in rings]), np.array([r[1] for r in rings])
    gap = np.maximum(0, np.maximum(low[None, :] - dq[:, None], dq[:, None] - high[None, :]))
    slack = 1e-6 * (1 + square)
    bound = (square[:, None] - gap**2) / 2 + slack[:, None]
    for step in np.argsort(gap.min(axis=0), kind="stable"):
        todo = np.flatnonzero(bound[:, step] >= floor)
        if not len(todo):
            continue
        e = edges[step]
        got = exact_scores(queries[todo], v[e : e + annulus])
        inside = ids[e : e + annulus]
        for i, row in zip(todo, got, strict=True):
            hit = np.flatnonzero((row >= floor[i]) & (inside != query_ids[i]))
            if len(hit):
                best[i] = _top(np.concatenate([best[i][1], row[hit]]), np.concatenate([best[i][0], inside[hit]]), k)
                if len(best[i][0]) == k:
                    floor[i] = max(floor[i], float(best[i][1][-1]))
    return best


def top_k(vectors: DataFrame, is_query: str, k: int = 5, block: int = BLOCK, cell_rows: int = 4096) -> DataFrame:
    """(query, rank, id, score) with the k highest integer inner products of each query among all other rows.

    Rows are (id unique, vector). Index rows are keyed by their nearest pivot and dealt out in blocks. Every query first
    searches the cell of its own nearest pivot, which bounds its k-th score from below. It then goes to those cells only
    whose distances from their pivot could hold a better one, and there to such annuli. Ties go to the smaller id. Vectors
    of other lengths count as padded with zeros. Components of 2**500 or more, and results beyond 64 bits, raise.
    """
    clean = checkpoint(_prepared(modest_batches(vectors.select("id", "vector")), unit_length=False))
    schema = "query long, id long, score long"
    empty = vectors.sparkSession.createDataFrame([], "query long, rank int, id long, score long")

    def norms(batches):
        for t in batches:
            if len(t):
                yield pd.DataFrame({"norm": [max(float(np.sqrt((x**2).sum())) for x in unpack_each(t.vector))]})

    n, width = clean.agg(F.count("*"), F.max("dim")).first()
    if not n:
        return empty
    top_norm = clean.mapInPandas(norms, "norm double").agg(F.max("norm")).first()[0] * (1 + 1e-9) + 1e-9
    number = pivots_for(n, cell_rows)
    sample = _sample(clean, max(PIVOT_SAMPLE, PER_PIVOT * number), width)
    lift = lambda x: np.column_stack([x, np.sqrt(np.maximum(top_norm**2 - (x**2).sum(axis=1), 0))])
    pivots = choose_pivots(lift(sample), number)
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def asking(x: np.ndarray) -> np.ndarray:
        """Distances of queries to all pivots."""
        return distances(np.column_stack([x, np.zeros(len(x))]), sent.value)

    def home_of(t):
        x = _matrix(unpack_each(t.vector), width)
        d = distances(lift(x), sent.value)
        return t.assign(cell=d.argmin(axis=1), far=d.min(axis=1), near=asking(x).argmin(axis=1))

    indexed = checkpoint(clean.mapInPandas(in_chunks(home_of, len(pivots)), "id long, dim int, vector binary, cell int, far double, near int"))
    sizes, low, high = {}, np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for x in indexed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect():
        sizes[x["cell"]], low[x["cell"]], high[x["cell"]] = x["n"], x["low"], x["high"]
    blocks = {c: parts_for(m, block, 1) for c, m in sizes.items()}

    def mixed(x) -> int:
        return (int(x) * 0x9E3779B97F4A7C15 % 2**64) >> 33

    def cells_of(t: pd.DataFrame, first: bool) -> np.ndarray:
        """Which cells each query visits: first that of its nearest pivot, then others in which its floor can be reached."""
        here = t.near.to_numpy()[:, None] == np.arange(len(pivots))[None, :]
        full = np.isfinite(low)[None, :]
        if first:
            return here & full
        x = _matrix(unpack_each(t.vector), width)
        d, square = asking(x), (x**2).sum(axis=1) + top_norm**2
        gap = np.maximum(0, np.maximum(low[None, :] - d, d - high[None, :]) - 1e-7 * (1 + d))
        return ~here & full & ((square[:, None] - gap**2) / 2 + 1e-6 * (1 + square)[:, None] >= t.floor.to_numpy()[:, None])

    def visits(first: bool):
        def count(t):
            found = cells_of(t, first).sum(axis=0)
            return pd.DataFrame({"cell": np.flatnonzero(found), "n": found[found > 0]})

        return in_chunks(count, len(pivots))

    columns = ["unit", "side", "id", "floor", "vector"]

    def deal_rows(asked: dict[int, int]):
        def deal(t):
            for row in t.itertuples(index=False):
                b = mixed(row.id) % blocks[row.cell]
                yield from ((f"{row.cell}/{b}/{q}", 1, row.id, 0.0, row.vector) for q in range(asked.get(row.cell, 0)))

        return dealing(deal, 1, columns)

    def deal_queries(first: bool, asked: dict[int, int]):
        def deal(t):
            for row, some in zip(t.itertuples(index=False), cells_of(t, first), strict=True):
                for c in np.flatnonzero(some).tolist():
                    q = mixed(row.id) % asked[c]
                    yield from ((f"{c}/{b}/{q}", 0, row.id, row.floor, row.vector) for b in range(blocks[c]))

        return dealing(deal, len(pivots), columns)

    def unit(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        cell = int(key[0].split("/")[0])
        q, v = t[t.side == 0], t[t.side == 1]
        if not len(q) or not len(v):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        found = search_unit(_matrix(unpack_each(q.vector), width), q.id.to_numpy(), q.floor.to_numpy(), _matrix(unpack_each(v.vector), width), v.id.to_numpy(), sent.value[cell], top_norm, k)
        return pd.DataFrame([(a, i, int(max(-BEYOND, min(BEYOND, s)))) for a, (ids, scores) in zip(q.id, found, strict=True) for i, s in zip(ids, scores, strict=True)], columns=["query", "id", "score"])

    dealt = "unit string, side int, id long, floor double, vector binary"
    asked = indexed.filter(is_query)

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        counts = queries.mapInPandas(visits(first), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 0")
        slots = {x["cell"]: parts_for(x["n"], block, 1) for x in counts.collect()}
        rows = indexed.mapInPandas(deal_rows(slots), dealt)
        return rows.unionByName(queries.mapInPandas(deal_queries(first, slots), dealt)).groupBy("unit").applyInPandas(unit, schema)

    best = F.row_number().over(_by_score())
    near = checkpoint(searched(asked.withColumn("floor", F.lit(float("-inf"))), True).withColumn("rank", best).filter(F.col("rank") <= k))
    floors = near.filter(F.col("rank") == k).select(F.col("query").alias("q"), F.col("score").cast("double").alias("floor"))
    rest = checkpoint(asked.join(floors, F.col("id") == F.col("q"), "left").select(*asked.columns, F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))
    both = near.select("query", "id", "score").unionByName(searched(rest, False))
    beyond = F.raise_error(F.lit("a score is beyond 64 bits")).cast("long")
    exact = F.when(F.abs("score") < F.lit(BEYOND), F.col("score")).otherwise(beyond)
    return both.withColumn("rank", best.cast("int")).filter(F.col("rank") <= k).select("query", "rank", "id", exact.alias("score"))


def _by_score():
    return Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat a vec_id or lack one are told apart; a null vec_id is never a query."""
    rows = keyed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    if rows.filter("not (id <=> try_cast(key as long))").isEmpty():
        found = top_k(rows, "id % 50 = 0")
        return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
    # Twice the row key orders as the row key does, and its last bit tells queries.
    marked = rows.withColumn("id", F.col("id") * 2 + F.coalesce(F.expr("try_cast(key as long) % 50 = 0").cast("int"), F.lit(0)))
    found = top_k(marked, "id % 2 = 1")
    names = lambda a, b: marked.select(F.col("id").alias(a), F.col("key").alias(b))
    return found.join(names("query", "query_id"), "query").join(names("id", "vec_id"), "id").select("query_id", "rank", "vec_id", "score")
