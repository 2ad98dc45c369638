"""Nesting, flattening, regrouping, counting and merging of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import text as X


def flatten(conversations: DataFrame) -> DataFrame:
    """One row a message, with the conversation's columns; conversations without messages go."""
    kept = [c for c in conversations.columns if c != "messages"]
    return conversations.select(*kept, F.posexplode("messages").alias("message_id", "m")).select(*kept, "message_id", "m.*")


def regroup(messages: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Messages back to conversations, in the order of ``order``; n_messages is their number."""
    found = messages.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("list"))
    return found.select(*keys, F.transform("list", lambda m: F.struct(*(m[f].alias(f) for f in fields))).alias("messages"), F.size("list").cast("long").alias("n_messages"))


def count_by_model_and_language(rows: DataFrame) -> DataFrame:
    """Counts overall, by model, by language and by both; ``level`` says which."""
    sets = rows.groupingSets([[], ["model"], ["language"], ["model", "language"]], "model", "language")
    level = F.element_at(F.array(*map(F.lit, ("both", "model", "language", "all"))), (F.grouping_id() + 1).cast("int"))
    return sets.agg(F.count("*").alias("n"), level.alias("level"))


def dataset_statistics(messages: DataFrame) -> DataFrame:
    """Per language: messages, conversations, their mean, least and greatest length, and the different labels of all messages, an absent one being one more."""
    labels = [c for c in ("industry", "problem") if c in messages.columns]
    each = messages.groupBy("language", "conversation_id").agg(F.count("*").alias("n"))
    out = each.groupBy("language").agg(F.sum("n").alias("n_messages"), F.count("*").alias("n_conversations"), F.avg("n").alias("mean_length"), F.min("n").alias("min_length"), F.max("n").alias("max_length"))
    for c in labels:
        kinds = messages.select(F.col("language").alias("_l"), F.coalesce(c, F.lit("")).alias(c)).distinct().groupBy("_l").agg(F.count("*").alias(f"n_{c}"))
        out = out.join(kinds, F.col("language").eqNullSafe(F.col("_l"))).drop("_l")
    return out


def merge_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All existing rows and the new rows whose key isn't there yet."""
    fresh = new.join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def overlapping(existing: DataFrame, new: DataFrame, key: str, most: int = 5) -> DataFrame:
    """A report of ids on both sides, the first few in order."""
    return new.join(existing.select(key), key, "left_semi").select(key).distinct().orderBy(key).limit(most)


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The values that both sides have."""
    return a.select(key).intersect(b.select(key))


def absent_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The values that only the first side has."""
    return a.select(key).subtract(b.select(key))


def structure(rows: DataFrame) -> DataFrame:
    """Columns in order of name, every one a string, null as the empty string."""
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(rows.columns)))


def first_by(rows: DataFrame, keys: list[str], order: list, most: int = 1) -> DataFrame:
    """The first rows of each key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_at", at).where(F.col("_at") <= most).drop("_at")


def drop_blank(conversations: DataFrame) -> DataFrame:
    """Conversations without blank messages; a missing author is Unknown."""
    messages = F.filter("messages", lambda m: ~X.blank(m["message"]))
    return conversations.withColumn("messages", F.transform(messages, lambda m: m.withField("from_name", F.coalesce(X.truthy(m["from_name"]), F.lit("Unknown")))))


def stacked(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Frames one under the other by the names of their columns; what a frame lacks is null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
