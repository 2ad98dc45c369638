"""What the corpus operators share: staged tables, row keys, connected components, Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bounds of an Arrow batch sent to a Python worker, set where the session allows more.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def prepare(spark: SparkSession) -> None:
    """What all operators need of the session: workers find this package, and Arrow batches are bounded in rows and bytes."""
    context = spark.sparkContext
    path = context.environment.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in path.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_ROOT, path) if x)
    for key, most in BATCH.items():
        now = (spark.conf.get(key, None) or "").rstrip("b")  # None where the default holds
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


class Scratch:
    """Tables written to the shared folder named by ``spark.checkpoint.dir``.

    A written table cuts the lineage and survives lost executors. Where that setting is unset, a
    temporary folder is used on a single machine (a local master); on a cluster that is an error, as
    executors don't see each other's disks.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        prepare(spark)
        context = spark.sparkContext
        base = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.gettempdir()}/tandem-scratch"
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_CACHES: dict[str, dict] = {}


def cache(name: str) -> dict:
    """What an operator keeps in a worker process between tasks. Workers are reused, so whatever others kept there is let go."""
    for other, held in _CACHES.items():
        if other != name:
            held.clear()
    return _CACHES.setdefault(name, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(*columns: str) -> list[Column]:
    """Two hashes that name a row by content: equal for repeated rows, null-safe, the same in every job."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(7919), *reversed(columns)).alias("k2")]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n + 1 offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together, at least one row each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def batch_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds at most ``limit`` bytes of text (a longer row stays whole)."""
    for batch in batches:
        if batch.num_rows:
            _, offsets = text_buffers(batch.column(column))
            for low, high in slices(offsets, limit):
                yield batch.slice(low, high - low)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int, column: str = "", most: int = 1 << 62) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches, each of about ``limit`` rows or ``most`` bytes of ``column``, or one group."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.column(column).nbytes if column else 0
        if rows < limit and size < most:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        tail = np.ones(rows, bool)
        for key in keys:
            values = whole.column(key)
            last = values[rows - 1].as_py()
            same = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
            tail &= same.to_numpy(zero_copy_only=False) == last
        cut = int(np.flatnonzero(~tail)[-1]) + 1 if not tail.all() else 0
        if cut:
            yield whole.slice(0, cut)
            rest = whole.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
            size = rest.column(column).nbytes if column else 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def components(scratch: Scratch, edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b), the component named by its smallest id.

    Large-star and small-star passes in turn: each keeps the components and shortens the paths, so a
    chain of n nodes needs about log n rounds. Every pass is written to the shared folder. A node with
    many neighbours is aggregated by min, never gathered. Nothing but two counts reaches the driver.
    """
    now = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0")
    if now.isEmpty():
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    before = None
    for step in range(1, rounds + 1):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        least = scratch.save(least, f"{name}-least")
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = scratch.save(large, f"{name}-large")
        small_min = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_min, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        following = scratch.save(small, f"{name}-{step}")
        mark = following.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        scratch.drop(f"{name}-{step - 1}")
        now = following
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component"))


__all__ = ["Scratch", "batch_slices", "by_group", "cache", "components", "prepare", "row_keys", "slices", "table", "text_buffers"]
