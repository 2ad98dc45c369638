"""Staged tables: written to the shared folder that ``spark.checkpoint.dir`` names, so that later steps don't repeat earlier ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder for files: in the shared folder if there is one, else, on a single machine, a temporary one."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/tandem-files-{uuid.uuid4().hex}"


def stage(frame: DataFrame) -> DataFrame:
    """The frame, computed once and written; it survives lost executors."""
    path = folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
