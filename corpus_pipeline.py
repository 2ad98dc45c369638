"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

Null and empty texts, and texts without a letter, go in the first stage, as their language can't be told. A row with
null doc_id is kept by the second stage (it is linked with nothing); of repeated rows one stays. Very long texts are
judged whole. Extra columns of any name are carried along to the last stage; tables may be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.common import Scratch, table
from tandem.llm.decontaminate import decontaminate
from tandem.llm.language_id import reject_unknown
from tandem.llm.minhash_dedup import drop_near_duplicates
from tandem.llm.packing import pack
from tandem.llm.suffix_dedup import dedup_texts


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without text or letters go."""
    return reject_unknown(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without bytes in windows of 400, or of 50 words, that occur elsewhere; n_chars is that of the new text."""
    out = dedup_texts(docs, words=50)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated by the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("minhash_dedup", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]

#: The first stage (a trained model) and the last (a tokenizer) can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
