"""Compacting a folder of Parquet files: small files of a partition are packed into groups, and each group becomes one file.

Packing is first-fit decreasing over run lengths: equal-sized files of a partition are one entry with a multiplicity, and
each open group, from the earliest on, absorbs as many of them at once as fit (the floor of what is left over their size).
Groups come out as ranges of ordinals among equal-sized files, which a join expands back to files.

Rows move once, when files are first written. Merging moves none: a task streams the files of a group into one. What the
merging tasks read is a checkpointed table of groups, and each step of a task can be repeated, so that a lost executor
costs only its own groups. Files are opened with Arrow's file systems (local paths, s3, gs, hdfs where libhdfs is there);
another store raises before anything is written.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, parts_for, releasing, remove_folder, shared_folder, table

DAY, LOT, PIECE = "__day", "__lot", "__piece"
#: The day of rows without a time.
NO_DAY = -(1 << 31)
#: Bytes of a row group of a merged file, rows of a batch that is read.
ROW_GROUP_BYTES, BATCH_ROWS = 64 << 20, 1 << 16


def share(rows: int, n: int) -> int:
    return 1 + rows // n


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path there."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", path)))


# Writing


def keyed(rows: DataFrame, id_column: str, time_column: str, lots: int = 200) -> DataFrame:
    """rows with the day, lot and piece of each.

    A day without a time is NO_DAY; a null id counts as an empty text. Days are counted first and joined as a table of
    their own, one row for each day of the calendar, which Spark broadcasts as long as its threshold allows it.
    """
    spark = rows.sparkSession
    day = F.coalesce(F.unix_date(F.to_date(time_column)).cast("long"), F.lit(NO_DAY))
    h = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))
    own = rows.withColumn(DAY, day)
    folder = f"{shared_folder(spark)}/days-{uuid.uuid4().hex}"
    own.groupBy(DAY).agg(F.count("*").alias("__r")).write.parquet(folder)
    days = spark.read.parquet(folder)
    size = share(days.agg(F.coalesce(F.sum("__r"), F.lit(0))).first()[0], lots)
    lot = F.floor(h / 16) % (1 + F.floor(F.col("__r") / size))
    return own.join(days, DAY).withColumn(LOT, lot.cast("long")).withColumn(PIECE, F.least(h % 4, F.floor(h / 4) % 4).cast("long")).drop("__r")


def write_files(rows: DataFrame, folder: str, order: list[str]) -> None:
    """One file for each (day, lot, piece) of rows, sorted by order (null first), with all other columns in their order.

    A file is written by one task, which sorts outside memory. There are as many tasks as the session has shuffle partitions.
    """
    keys = [DAY, LOT, PIECE]
    conf = rows.sparkSession.conf
    was = conf.get("spark.sql.parquet.outputTimestampType")
    conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")  # the form that other readers write back alike
    try:
        tasks = int(conf.get("spark.sql.shuffle.partitions"))  # given, so that small tables are written in parallel too
        rows.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).write.option("maxRecordsPerFile", 0).partitionBy(*keys).parquet(folder)
    finally:
        conf.set("spark.sql.parquet.outputTimestampType", was)


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """(day, lot, piece, path, size in rows) of the files of a folder. Only footers are read."""
    keys = (DAY, LOT, PIECE)
    at = spark.read.schema(", ".join(f"{c} long" for c in keys)).parquet(folder).select(*[F.col(c).alias(c.strip("_")) for c in keys], F.col("_metadata.file_path").alias("path"))
    return at.groupBy("day", "lot", "piece", "path").agg(F.count("*").alias("size"))


# Packing


def packed(sizes: list[int], times: list[int], most: int) -> list[tuple[int, int, int, int]]:
    """(size, first ordinal, last ordinal, group) of first-fit decreasing over times[i] files of sizes[i] (descending, distinct).

    Files of more than most are a group each.
    """
    out: list[tuple[int, int, int, int]] = []
    left = np.empty(0, np.int64)
    for size, n in zip(sizes, times, strict=True):
        each = max(1, size)
        fits = left // each
        taken = np.diff(np.minimum(np.cumsum(np.concatenate([[0], fits])), n))
        fresh = max(1, most // each)
        more = -(-(n - int(taken.sum())) // fresh)
        opened = np.diff(np.minimum(np.arange(more + 1) * fresh, n - int(taken.sum())))
        taken = np.concatenate([taken, opened])
        left = np.concatenate([left, np.full(more, most, np.int64)]) - taken * size
        ends = np.cumsum(taken)
        out += [(size, int(ends[g] - taken[g]), int(ends[g]) - 1, g) for g in np.flatnonzero(taken).tolist()]
        left = np.maximum(left, 0)
    return out


def bins_of(files: DataFrame, small: int, most: int) -> DataFrame:
    """One row for each file that there will be, with its sources in joining order; day, lot and piece are its first source's.

    Files under ``small`` rows are packed by day into groups of ``most`` rows. A task packs the run lengths of a day.
    """

    def pack_day(runs: pd.DataFrame) -> pd.DataFrame:
        runs = runs.sort_values("size", ascending=False)
        found = packed(runs["size"].tolist(), runs["n"].tolist(), most)
        return pd.DataFrame(found, columns=["size", "low", "high", "bin"]).assign(day=runs["day"].iloc[0])[["day", "size", "low", "high", "bin"]]

    few = files.filter(F.col("size") < small)
    runs = few.groupBy("day", "size").agg(F.count("*").alias("n"))
    ranges = runs.groupBy("day").applyInPandas(pack_day, "day long, size long, low long, high long, bin long")
    nth = F.row_number().over(Window.partitionBy("day", "size").orderBy("lot", "piece", "path")) - 1
    met = few.withColumn("nth", nth).join(ranges, ["day", "size"]).filter(F.col("nth").between(F.col("low"), F.col("high")))
    source = F.struct((-F.col("size")).alias("size"), "lot", "piece", "path")
    groups = met.groupBy("day", "bin").agg(F.array_sort(F.collect_list(source)).alias("sources")).drop("bin")
    alone = files.filter(F.col("size") >= small).select("day", F.array(source).alias("sources"))
    rows = groups.unionByName(alone)
    sources = F.transform("sources", lambda x: F.struct((-x["size"]).alias("size"), x["lot"].alias("lot"), x["piece"].alias("piece"), x["path"].alias("path")))
    return rows.select("day", F.col("sources")[0]["lot"].alias("lot"), F.col("sources")[0]["piece"].alias("piece"), sources.alias("sources"))


# Merging


def _merge(sources: list[str], target: str, folder: str) -> None:
    """The rows of sources in one file at target, in order, with row groups of about ROW_GROUP_BYTES."""
    fs, _ = store(sources[0])
    place = store(f"{folder}/{uuid.uuid4().hex}.parquet")[1]
    fs.create_dir(store(folder)[1], recursive=True)
    schema = pq.read_schema(store(sources[0])[1], filesystem=fs)
    with fs.open_output_stream(place) as out, pq.ParquetWriter(out, schema, compression="snappy") as writer:
        held: list[pa.RecordBatch] = []
        for path in sources:
            with fs.open_input_file(store(path)[1]) as f:
                source = pq.ParquetFile(f)
                if not source.schema_arrow.equals(schema):
                    raise ValueError(f"the columns of {path} differ from those of {sources[0]}")
                for batch in source.iter_batches(batch_size=BATCH_ROWS):
                    held.append(batch)
                    if sum(b.nbytes for b in held) >= ROW_GROUP_BYTES:
                        writer.write_table(pa.Table.from_batches(held, schema))
                        held = []
        if held:
            writer.write_table(pa.Table.from_batches(held, schema))
    fs.move(place, store(target)[1])


def _exists(path: str) -> bool:
    fs, at = store(path)
    return fs.get_file_info(at).type == pa.fs.FileType.File


def replace(sources: list[str], folder: str) -> str:
    """Put one file in the place of sources, beside the first; return its path.

    The new file appears whole under a name that follows from its sources, then the sources go: a repeated task finds the
    file and only clears what is left.
    """
    name = hashlib.sha256("\n".join(sources).encode()).hexdigest()[:32]
    target = f"{sources[0].rpartition('/')[0]}/merged-{name}.parquet"
    if not _exists(target):
        try:
            _merge(sources, target, folder)
        except FileNotFoundError:  # another copy of this task was faster
            if not _exists(target):
                raise
    for path in sources:
        fs, at = store(path)
        head, _, last = at.rpartition("/")
        for x in (at, f"{head}/.{last}.crc"):
            with contextlib.suppress(FileNotFoundError):
                fs.delete_file(x)
    return target


def compact(spark: SparkSession, folder: str, small: int, most: int) -> DataFrame:
    """Compact the files of write_files() in place: (day, lot, piece, path, rewritten, sources) of each file that is there then.

    Within a day, files under ``small`` rows are taken by descending rows, then ascending lot and piece; each joins the
    earliest group that holds at most ``most`` rows with it, or opens one. A group of several becomes one file, in joining
    order; other files are not touched. An empty folder of files gives no rows. Runs when called.
    """
    store(folder)
    bins = checkpoint(bins_of(files_of(spark, folder), small, most))
    work = f"{folder}-merging"

    def run(batches):
        for t in batches:
            out = []
            for r in t.to_dict("records"):
                paths = [s["path"] for s in r["sources"]]
                several = len(paths) > 1
                out.append((r["day"], r["lot"], r["piece"], replace(paths, work) if several else paths[0], several, [{"size": s["size"], "lot": s["lot"], "piece": s["piece"]} for s in r["sources"]]))
            yield pd.DataFrame(out, columns=["day", "lot", "piece", "path", "rewritten", "sources"])

    tasks = parts_for(bins.count(), 4, 1)
    done = checkpoint(bins.repartition(tasks, F.col("day"), F.col("lot"), F.col("piece")).mapInPandas(releasing(run), "day long, lot long, piece long, path string, rewritten boolean, sources array<struct<size: long, lot: long, piece: long>>"))
    remove_folder(spark, work)
    return done


def described(files: DataFrame, id_column: str, value_column: str) -> DataFrame:
    """files with n_rows, least and greatest id, sum of cents, a digest of the ids in file order, and column names.

    Files are streamed in batches. Nulls aren't least or greatest, have no cents and are empty in the digest, as values that
    aren't finite have no cents.
    """

    def run(batches):
        for t in batches:
            rows = []
            for path in t["path"]:
                fs, at = store(path)
                n, low, high, cents, digest = 0, None, None, 0, hashlib.sha256()
                with fs.open_input_file(at) as f:
                    source = pq.ParquetFile(f)
                    names = source.schema_arrow.names
                    for b in source.iter_batches(batch_size=BATCH_ROWS, columns=[id_column, value_column]):
                        ids = b.column(id_column).to_pylist()
                        known = [x for x in ids if x is not None]
                        digest.update((("," if n else "") + ",".join(["" if x is None else str(x) for x in ids])).encode())
                        n += len(ids)
                        low, high = (f(known + ([x] if x is not None else []), default=None) for f, x in ((min, low), (max, high)))
                        v = b.column(value_column).cast(pa.float64()).to_numpy(zero_copy_only=False)
                        v = np.floor(100 * np.where(np.isfinite(v), v, 0.0) + 0.5)
                        cents += int(v.astype(np.int64).sum()) if (np.abs(v) < 1 << 53).all() else sum(map(int, v))
                rows.append((n, low, high, max(-(1 << 63), min((1 << 63) - 1, cents)), digest.hexdigest(), ",".join(names)))
            made = pd.DataFrame(rows, columns=["n_rows", "low", "high", "cents", "digest", "names"]).astype({"low": "Int64", "high": "Int64"})
            yield pd.concat([t.reset_index(drop=True), made], axis=1)

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(releasing(run), ddl + ", n_rows long, low long, high long, cents long, digest string, names string")


def op11_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clicks written as files of days, lots and pieces into a new folder, and compacted there; one row for each file left.

    Clicks without a time are a day of their own (null); null ids count as empty texts; repeated rows stay; extra columns are
    written like the others. An empty table has no files.
    """
    rows = table(spark, sf_dir, "clicks")
    folder = f"{shared_folder(spark)}/compaction-{uuid.uuid4().hex}"
    total = rows.count()
    write_files(keyed(rows, "click_id", "arrived_at"), folder, ["arrived_at", "click_id"])
    final = compact(spark, folder, share(total, 750), share(total, 300))
    made = described(final, "click_id", "value")
    names = F.array_join(F.transform("sources", lambda s: F.concat(s["lot"], F.lit("-"), s["piece"])), ",")
    return made.select(
        F.when(F.col("day") != NO_DAY, F.col("day")).alias("day"), "lot", "piece", "n_rows", F.col("low").alias("min_click_id"), F.col("high").alias("max_click_id"), "cents",
        names.alias("sources"), F.col("digest").alias("ids_sha256"), F.col("names").alias("columns"), "path", "rewritten",
    )
