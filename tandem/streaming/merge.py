"""Incremental ingest: new conversations are appended as they arrive, each message once, each batch whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators.shape import merge_new

#: Partitions of the target by a hash of the key.
BUCKETS = 256
KEYS = ["conversation_id", "message_id"]
#: Bits of a bucket's Bloom filter (a multiple of a bitmap's 32,768), and bits a key sets.
BITS, HASHES = 1 << 22, 4
_BITMAP = 1 << 15


class Target:
    """A table of batches: a folder of rows and one of Bloom bits a batch, and a manifest, without which a batch doesn't exist.

    A batch is written under its own name, over whatever a failed try has left there. Then its manifest is written aside and
    renamed, which a store does at once or not at all. A batch that has a manifest is never written again, so a replay changes nothing;
    readers see the folders that manifests name. ``stream`` keeps batches of several streams into one target apart.
    """

    def __init__(self, spark: SparkSession, path: str, stream: str = "main") -> None:
        self.spark, self.path, self.stream = spark, path.rstrip("/"), stream
        self._of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._store = self._of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _name(self, batch: int) -> str:
        return f"{self.stream}-{batch:020d}"

    def manifests(self) -> list[str]:
        """Names of the batches that are there, in order."""
        place = self._of(f"{self.path}/manifests")
        found = self._store.listStatus(place) if self._store.exists(place) else []
        return sorted(name for s in found if not (name := s.getPath().getName()).startswith((".", "_")))

    def has(self, batch: int) -> bool:
        return self._store.exists(self._of(f"{self.path}/manifests/{self._name(batch)}"))

    def read(self, *columns: str) -> DataFrame | None:
        """All rows of whole batches; none if there is no batch."""
        names = self.manifests()
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(*(f"{self.path}/rows/batch={n}" for n in names)) if names else None
        return rows.select(*columns) if rows is not None and columns else rows

    def bits(self) -> DataFrame | None:
        """(bucket, slot, bitmap): which bits the keys of each bucket have set."""
        names = self.manifests()
        if not names:
            return None
        return self.spark.read.parquet(*(f"{self.path}/bits/batch={n}" for n in names)).groupBy("bucket", "slot").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))

    def stage(self, rows: DataFrame, batch: int) -> None:
        """Write a batch's rows (with their bucket) and its bits."""
        name = self._name(batch)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={name}")
        kept = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/batch={name}")
        places = kept.select("bucket", F.explode(positions()).alias("at")).groupBy("bucket", F.floor(F.col("at") / _BITMAP).cast("int").alias("slot"))
        places.agg(F.bitmap_construct_agg((F.col("at") % _BITMAP).cast("long")).alias("bitmap")).write.mode("overwrite").parquet(f"{self.path}/bits/batch={name}")

    def commit(self, batch: int) -> None:
        """Make a staged batch part of the table."""
        aside, name = self._of(f"{self.path}/manifests/.{self._name(batch)}"), self._of(f"{self.path}/manifests/{self._name(batch)}")
        out = self._store.create(aside, True)
        out.write(bytearray(json.dumps({"batch": batch, "stream": self.stream}).encode()))
        out.close()
        if not self._store.rename(aside, name) and not self.has(batch):
            raise OSError(f"the manifest of batch {batch} can't be renamed")

    def append(self, batch: DataFrame, number: int) -> None:
        """The rows of a batch whose key is new, once each; nothing if the batch is there already."""
        if not self.has(number):
            self.stage(self.fresh(batch), number)
            self.commit(number)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose key isn't in the table, with their bucket.

        Keys of which some bit isn't set are surely new. Only of the others the table's keys are read, in their buckets.
        """
        own = batch.dropDuplicates(KEYS).withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int"))
        bits = self.bits()
        if bits is None:
            return own
        asked = own.select(*KEYS, "bucket", F.explode(positions()).alias("at")).withColumn("slot", F.floor(F.col("at") / _BITMAP).cast("int"))
        byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("at") % _BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.col("at") % 8).cast("int")) != 0, F.lit(False))
        maybe = asked.join(bits, ["bucket", "slot"], "left").groupBy(*KEYS, "bucket").agg(F.bool_and(hit).alias("maybe")).where("maybe").drop("maybe")
        buckets = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # at most BUCKETS
        if not buckets:
            return own
        known = self.read(*KEYS, "bucket").where(F.col("bucket").isin(buckets))
        return own.join(known.join(maybe, [*KEYS, "bucket"], "left_semi"), [*KEYS, "bucket"], "left_anti")


def positions() -> Column:
    """The bits that a row's key sets in its bucket's filter."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(i), *KEYS), F.lit(BITS)) for i in range(1, HASHES + 1)))


def read_messages(spark: SparkSession, target: str) -> DataFrame | None:
    """The rows of all whole batches in a target of ``stream_messages``."""
    rows = Target(spark, target).read()
    return rows.drop("bucket", "batch") if rows is not None else None


def stream_messages(spark: SparkSession, path: str, schema: str, target: str, checkpoint: str, stream: str = "main"):
    """A query that appends to ``target`` the rows of JSON files whose (conversation_id, message_id) is new there."""
    place = Target(spark, target, stream)
    return spark.readStream.schema(schema).json(path).writeStream.foreachBatch(place.append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["Target", "merge_new", "read_messages", "stream_messages"]
