"""Helpers shared by the operators: row keys, checkpoints and packed arrays."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RID = "__rid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local master gets a folder of its own; a cluster raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="linkwright-"))
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours in the shared store, if it is there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def sheltered(docs: DataFrame, named: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with the columns not in named under names that clash with nothing, and what gives them back their names and order.

    That function also appends other columns of its frame, given as column=name.
    """
    names = {c: c if c in named else f"__other_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return inner, lambda out, **more: out.select(*[F.col(n).alias(c) for c, n in names.items()], *[F.col(n).alias(c) for n, c in more.items()])


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in shared_folder()."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_rid(df: DataFrame, key: str, then: str) -> DataFrame:
    """Add a unique long row key that sorts as ``key`` does.

    It is ``key`` itself where that is an integer, unique and never null. Otherwise rows are ranked by ``key`` (null first), then by
    a hash of ``then`` (short, as sorting samples its keys): rows that repeat an id are told apart, and equal rows are
    interchangeable.
    """
    odd = df.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull())
    if isinstance(df.schema[key].dataType, T.IntegralType) and odd.isEmpty():
        return df.withColumn(RID, F.col(key).cast("long"))
    ranked = df.orderBy(F.col(key).asc_nulls_first(), F.xxhash64(then))
    return checkpoint(ranked.withColumn(RID, F.monotonically_increasing_id()))


#: Rows and bytes of an Arrow batch at most: texts may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def modest_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of its session held to BATCH_ROWS and BATCH_BYTES, so that a batch of long texts fits a worker.

    Plans run after we return, so that the session keeps these settings; smaller ones stay.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.sub(r"[^0-9]", "", conf.get(name))
        if not (now and 0 < int(now) <= most):
            conf.set(name, str(most))
    return df


def release() -> None:
    """Give memory that is free in this process back to the system: workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def releasing(function):
    """A function over batches that releases memory when a task's batches are done."""

    def run(batches):
        yield from function(batches)
        release()

    return run


def parts_for(amount: float, each: float, least: int = 48) -> int:
    """How many groups keep each near ``each``; the count grows with the data, so that a group's size doesn't."""
    return max(least, int(np.ceil((amount or 0) / each)))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one binary value."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blobs, *dtypes) -> list[np.ndarray]:
    """The arrays of many packed values, joined."""
    sizes = [np.dtype(t).itemsize for t in dtypes]
    out: list[list[np.ndarray]] = [[] for _ in dtypes]
    for blob in blobs:
        n, at = len(blob) // sum(sizes), 0
        for i, (kind, each) in enumerate(zip(dtypes, sizes, strict=True)):
            out[i].append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
            at += n * each
    return [np.concatenate(x) if x else np.empty(0, dtype=t) for x, t in zip(out, dtypes, strict=True)]


def slices(keys: np.ndarray):
    """(key, indexes) for each distinct value of keys."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield keys[part[0]], part
