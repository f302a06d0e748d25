"""Compaction against plain loops over the written files."""

import datetime as dt
import hashlib
import io
import math
import os
import random
import shutil
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from linkwright.llm import compaction as co

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
EPOCH = dt.datetime(1970, 1, 1)


def share(rows, n):
    return 1 + rows // n


def plain(rows):
    """The final files by (day, lot, piece), from dicts of clicks."""
    total, by_day = len(rows), defaultdict(list)
    for r in rows:
        by_day[(r["arrived_at"] - EPOCH).days if r["arrived_at"] else None].append(r)
    out = {}
    for day, mine in by_day.items():
        files = defaultdict(list)
        for r in mine:
            h = zlib.crc32(("" if r["click_id"] is None else str(r["click_id"])).encode())
            files[(h // 16) % (1 + len(mine) // share(total, 200)), min(h % 4, h // 4 % 4)].append(r)
        for f in files.values():
            f.sort(key=lambda r: (r["arrived_at"] or EPOCH, r["click_id"] is not None, r["click_id"] or 0))
        small = sorted((k for k in files if len(files[k]) < share(total, 750)), key=lambda k: (-len(files[k]), k))
        groups = []
        for k in small:
            for g in groups:
                if sum(len(files[x]) for x in g) + len(files[k]) <= share(total, 300):
                    g.append(k)
                    break
            else:
                groups.append([k])
        for g in groups + [[k] for k in files if k not in small]:
            got = [r for k in g for r in files[k]]
            ids = [r["click_id"] for r in got]
            known = [x for x in ids if x is not None]
            cents = sum(math.floor(100 * r["value"] + 0.5) for r in got if r["value"] is not None and math.isfinite(r["value"]))
            out[day, *g[0]] = (len(got), min(known, default=None), max(known, default=None), cents, ",".join(f"{a}-{b}" for a, b in g), hashlib.sha256(",".join("" if x is None else str(x) for x in ids).encode()).hexdigest(), len(g) > 1)
    return out


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def checked(spark, folder, monkeypatch=None):
    clicks = [r.asDict() for r in spark.read.parquet(f"{folder}/clicks.parquet").collect()]
    seen = {}
    first = co.compact

    def watch(s, at, small, most):
        for where, _, names in os.walk(local(at)):
            for n in names:
                if n.endswith(".parquet"):
                    seen[os.path.join(where, n)] = hashlib.sha256(open(os.path.join(where, n), "rb").read()).hexdigest()
        return first(s, at, small, most)

    monkeypatch.setattr(co, "compact", watch)
    rows = co.op11_compaction(spark, folder).collect()
    monkeypatch.undo()
    got = {(r.day, r.lot, r.piece): (r.n_rows, r.min_click_id, r.max_click_id, r.cents, r.sources, r.ids_sha256, r.rewritten) for r in rows}
    assert len(got) == len(rows) and got == plain(clicks)
    if not rows:
        return rows
    at = local(rows[0].path).split("/__day=")[0]
    there = {os.path.join(w, n) for w, _, names in os.walk(at) for n in names if n.endswith(".parquet")}
    assert there == {local(r.path) for r in rows} and not os.path.exists(at + "-merging")
    for r in rows:
        raw = open(local(r.path), "rb").read()
        assert r.rewritten or hashlib.sha256(raw).hexdigest() == seen[local(r.path)]
        assert r.columns.split(",") == list(clicks[0]) == pq.read_schema(local(r.path)).names
    back = spark.read.parquet(at)
    order = list(clicks[0])
    key = lambda r: str(tuple(r[c] for c in order))
    assert sorted(map(key, back.select(order).collect())) == sorted(map(key, clicks))
    assert back.select(order).dtypes == spark.read.parquet(f"{folder}/clicks.parquet").dtypes
    return rows


def test_clicks_match_plain_loops(spark, data, monkeypatch):
    assert sum(r.rewritten for r in checked(spark, data, monkeypatch)) > 50


def test_odd_clicks(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        when = None if i % 90 == 0 else EPOCH + dt.timedelta(days=rng.choice([-1, 0, 0, 0, 7]), seconds=rng.randrange(0, 86400, 3600))
        value = rng.choice([None, 0.005, -1.255, 3.0, float("nan"), float("inf"), 1e15])
        rows.append((None if i % 70 == 0 else i // 2, when, when, rng.randrange(3), rng.choice([None, "view"]), value, "x" * (50_000 if i == 5 else 2)))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/clicks.parquet")
    checked(spark, str(tmp_path), monkeypatch)


def test_empty_table_and_clashing_columns(spark, tmp_path, monkeypatch):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/clicks.parquet")
    assert co.op11_compaction(spark, f"{tmp_path}/none").count() == 0
    when = dt.datetime(2024, 1, 1, 5)
    rows = [(i, when, when, 1, "view", 1.0, "{}", 3, "y") for i in range(40)]
    spark.createDataFrame(rows, SCHEMA + ", day long, path string").write.parquet(f"{tmp_path}/more/clicks.parquet")
    checked(spark, f"{tmp_path}/more", monkeypatch)


@pytest.mark.parametrize("seed", range(30))
def test_run_lengths_pack_like_single_files(seed):
    rng = random.Random(seed)
    most = rng.randrange(5, 60)
    sizes = sorted((rng.randrange(1, most + (10 if seed % 3 == 0 else 1)) for _ in range(rng.randrange(1, 80))), reverse=True)
    groups, of = [], []
    for s in sizes:
        at = next((i for i, g in enumerate(groups) if sum(g) + s <= most), None)
        if at is None:
            groups.append([])
            at = len(groups) - 1
        groups[at].append(s)
        of.append(at)
    runs = sorted(set(sizes), reverse=True)
    got = []
    for size, low, high, g in sorted(co.packed(runs, [sizes.count(x) for x in runs], most), key=lambda x: (-x[0], x[1])):
        got += [(size, g)] * (high - low + 1)
    assert got == list(zip(sizes, of))


def test_a_repeated_task_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i % 24)) for i in range(300)], "click_id long, arrived_at timestamp_ntz")
    folder = f"file://{tmp_path}/files"
    co.write_files(co.keyed(rows, "click_id", "arrived_at"), folder, ["click_id"])
    sources = [r.path for r in co.files_of(spark, folder).orderBy("lot", "piece").limit(3).collect()]
    kept = {p: open(local(p), "rb").read() for p in sources}
    target = co.replace(sources, folder + "-merging")
    content = open(local(target), "rb").read()
    assert co.replace(sources, folder + "-merging") == target and open(local(target), "rb").read() == content
    # A task that was lost after the new file appeared, before all sources went.
    open(local(sources[1]), "wb").write(kept[sources[1]])
    assert co.replace(sources, folder + "-merging") == target and not os.path.exists(local(sources[1]))
    # One that was lost while it wrote.
    os.remove(local(target))
    for p in sources:
        open(local(p), "wb").write(kept[p])
    os.makedirs(f"{tmp_path}/files-merging", exist_ok=True)
    open(f"{tmp_path}/files-merging/half.parquet", "wb").write(b"PAR1")
    assert pq.read_table(local(co.replace(sources, folder + "-merging"))).num_rows == sum(pq.read_table(io.BytesIO(kept[p])).num_rows for p in sources)
    shutil.rmtree(f"{tmp_path}/files")


def test_a_store_that_arrow_does_not_know_raises(spark):
    with pytest.raises(Exception, match="(?i)unrecognized|unknown"):
        co.compact(spark, "nostore://x/y", 10, 20)
