"""What the operators share: written tables in the shared folder and connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset, a new local one (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="attestra-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed at the driver's exit."""
    path = f"{shared_dir(spark)}/attestra-{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor costs a reread."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns node, component (the smallest node reachable) for the nodes of edges (a, b), any orderable type.

    Alternating large-star and small-star rounds; each round is written to the shared folder. A hub's
    edges are joined with a table that holds no hub, so adaptive execution can split the hub's partition;
    nothing is collected but a count and a checksum. Null ends and loops are ignored.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b")
    state = materialize(pairs.distinct(), "cc")
    seen = _fingerprint(state)
    while seen[0]:
        lows = materialize(state.groupBy("u").agg(F.min("v").alias("lo")), "cc-lows").withColumnRenamed("u", "n")
        large = materialize(state.join(lows, state["v"] == lows["n"], "left").select("u", F.coalesce("lo", "v").alias("v")).distinct(), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("lo"))
        hooked = large.join(least.withColumnRenamed("u", "n"), F.col("u") == F.col("n")).where("v <> lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
        state = materialize(hooked.union(least.select("u", "lo")).distinct(), "cc")
        if (now := _fingerprint(state)) == seen:
            break
        seen = now
    roots = state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return roots.union(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _fingerprint(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n, by the pairs left[k], right[k]."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, left, root[right])
        np.minimum.at(root, right, root[left])
        root = root[root]
        if (root == before).all():
            return root


def _stretches(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """From where to where rows hold about `most` bytes, or are one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start = stop


def byte_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, so that long texts don't meet in one."""
    for batch in batches:
        for start, stop in _stretches(batch.column(text), most):
            yield batch.slice(start, stop - start)
        pa.default_memory_pool().release_unused()


def byte_slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[pa.Array]:
    """The same texts in slices of about `most` bytes; an empty array is one slice."""
    for start, stop in _stretches(texts, most) if len(texts) else [(0, 0)]:
        yield texts.slice(start, stop - start)
