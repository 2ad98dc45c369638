"""The registry of queries and their SQL, and what queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.plans.views import view, with_views
from tandem.sources.staging import folder  # noqa: F401  for the queries that write files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL over the test tables or over ``views``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql.strip(), *views) if views else sql.strip()
        return f

    return add


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def longs(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("long") for c in columns})


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of the test tables as conversations: model, language, conversation_id, messages."""
    t = view(spark, sf, "turns").withColumn("from_type", F.when(F.col("role") == "assistant", "agent").when(F.col("role") == "user", "customer").otherwise(F.col("role")))
    message = F.struct(F.col("role").alias("from_name"), "from_type", F.col("text").alias("message"))
    found = t.groupBy("model", "language", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))).alias("list"))
    return found.select("model", "language", F.col("conv_id").alias("conversation_id"), F.transform("list", lambda x: x.m).alias("messages"))


def put(lines: DataFrame, path: str, order: str | None = None) -> str:
    """One file at ``path`` with a line a row of ``lines`` (value), in the order of the column ``order``."""
    spark = lines.sparkSession
    rows = (lines.orderBy(order) if order else lines).select("value")
    rows.coalesce(1).write.text(f"{path}.parts")
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in store.listStatus(of(f"{path}.parts")) if s.getPath().getName().startswith("part-"))
    store.rename(part, of(path))
    store.delete(of(f"{path}.parts"), True)
    return path
