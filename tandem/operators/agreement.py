"""Judges against truth, against each other, and human ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.schemas import CATEGORIES


def _matches(a: str, b: str) -> list:
    return [(F.coalesce(f"{a}{c}", F.lit("")) == F.coalesce(f"{b}{c}", F.lit(""))).alias(f"m_{c}") for c in CATEGORIES]


def _all() -> Column:
    out = F.lit(True)
    for c in CATEGORIES:
        out = out & F.col(f"m_{c}")
    return out


def judged(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """Whether each category, and all of them, are right, by judge, generator and conversation."""
    t = truth.select("generator_model", "conversation_id", *(F.col(c).alias(f"t_{c}") for c in CATEGORIES))
    return labels.join(t, ["generator_model", "conversation_id"]).select("judge_model", "generator_model", "conversation_id", *_matches("", "t_")).withColumn("m_all", _all())


def judge_accuracy(matches: DataFrame, keys: list[str]) -> DataFrame:
    return matches.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("m_all").cast("int")).alias("accuracy"), *(F.avg(F.col(f"m_{c}").cast("int")).alias(c) for c in CATEGORIES))


def judge_consistency(labels: DataFrame, matches: DataFrame) -> DataFrame:
    """Mean and population deviation of the accuracy by generator; a generator without truth counts as 0."""
    each = labels.select("judge_model", "generator_model").distinct().join(judge_accuracy(matches, ["judge_model", "generator_model"]), ["judge_model", "generator_model"], "left")
    return each.groupBy("judge_model").agg(F.avg(F.coalesce("accuracy", F.lit(0.0))).alias("mean_accuracy"), F.stddev_pop(F.coalesce("accuracy", F.lit(0.0))).alias("std_accuracy"), F.count("*").alias("n_generators"))


def pairwise_agreement(labels: DataFrame, order: str) -> DataFrame:
    """For each two judges: common conversations, share of full agreement and of each category's.

    Of several rows of a judge for a conversation the last by ``order`` counts; of equals the one whose labels come first.
    """
    keys = ["generator_model", "conversation_id"]
    last = F.row_number().over(Window.partitionBy("judge_model", *keys).orderBy(F.desc(order), *CATEGORIES))
    one = labels.withColumn("_at", last).where("_at = 1").select("judge_model", *keys, *CATEGORIES)
    a = one.select(F.col("judge_model").alias("judge_a"), *keys, *(F.col(c).alias(f"a_{c}") for c in CATEGORIES))
    b = one.select(F.col("judge_model").alias("judge_b"), *keys, *(F.col(c).alias(f"b_{c}") for c in CATEGORIES))
    both = a.join(b, keys).where("judge_a < judge_b").select("judge_a", "judge_b", *_matches("a_", "b_")).withColumn("m_all", _all())
    return judge_accuracy(both, ["judge_a", "judge_b"]).withColumnRenamed("n", "n_common").withColumnRenamed("accuracy", "agreement")


def mean_agreement(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n_pairs"), F.avg("agreement").alias("agreement"), *(F.avg(c).alias(c) for c in CATEGORIES))


def keep_first(ratings: DataFrame, order: list[str]) -> DataFrame:
    """The first rating of each reviewer, conversation and category."""
    at = F.row_number().over(Window.partitionBy("reviewer_name", "conversation_id", "rating_category_name").orderBy(*order))
    return ratings.withColumn("_at", at).where("_at = 1").drop("_at")


def duplicates(ratings: DataFrame) -> DataFrame:
    """All rows whose reviewer, conversation and category occur more than once."""
    n = F.count("*").over(Window.partitionBy("reviewer_name", "conversation_id", "rating_category_name"))
    return ratings.withColumn("_n", n).where("_n > 1").drop("_n")


def reviewer_statistics(ratings: DataFrame, key: str = "reviewer_name") -> DataFrame:
    return ratings.groupBy(key).agg(F.count_distinct("conversation_id").alias("conversations"), F.count_distinct("rating_category_name").alias("categories"), F.count("*").alias("ratings"), F.round(F.avg("rating_value"), 2).alias("mean_rating"))


def rating_pivot(ratings: DataFrame, reviewers: list[str]) -> DataFrame:
    """Mean rating by conversation and category, a column a reviewer."""
    return ratings.groupBy("conversation_id", "rating_category_name").pivot("reviewer_name", reviewers).agg(F.avg("rating_value"))


def majority(ratings: DataFrame) -> DataFrame:
    """The commonest value by conversation and category (the least of equals), and its votes."""
    votes = ratings.groupBy("conversation_id", "rating_category_name", "rating_value").agg(F.count("*").alias("votes"))
    best = F.max_by(F.struct("rating_value", "votes"), F.struct(F.col("votes"), -F.col("rating_value")))
    return votes.groupBy("conversation_id", "rating_category_name").agg(best.alias("b")).select("conversation_id", "rating_category_name", F.col("b.rating_value").alias("vote"), F.col("b.votes").alias("votes"))


def vote_statistics(votes: DataFrame, value: str) -> DataFrame:
    return votes.groupBy("rating_category_name").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))


def rating_flags(ratings: DataFrame) -> DataFrame:
    """Conversations whose ratings part: fluency by 2 or more, coherence at all, of two ratings or more."""
    by = ratings.groupBy("conversation_id", "rating_category_name").agg(F.count("rating_value").alias("n"), (F.max("rating_value") - F.min("rating_value")).alias("gap"), F.count_distinct("rating_value").alias("kinds"))
    fluent = F.contains(F.lower("rating_category_name"), F.lit("fluent")) & (F.col("n") >= 2) & (F.col("gap") >= 2)
    coherent = (F.col("rating_category_name") == "Does the content make sense?") & (F.col("n") >= 2) & (F.col("kinds") > 1)
    return by.select("conversation_id", "rating_category_name", fluent.alias("fluency_flag"), coherent.alias("coherence_flag"))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """Fleiss' kappa by category over conversations with two ratings or more; n is that of the first conversation."""
    counts = ratings.groupBy("rating_category_name", "conversation_id", "rating_value").agg(F.count("*").alias("c"))
    rows = counts.groupBy("rating_category_name", "conversation_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")).where("n >= 2")
    used = counts.join(rows.select("rating_category_name", "conversation_id"), ["rating_category_name", "conversation_id"], "left_semi")
    whole = rows.groupBy("rating_category_name").agg(F.count("*").alias("subjects"), F.sum("sq").alias("sq"), F.min_by("n", "conversation_id").alias("n"))
    share = used.groupBy("rating_category_name", "rating_value").agg(F.sum("c").alias("c")).join(whole, "rating_category_name").groupBy("rating_category_name").agg(F.sum(F.pow(F.col("c") / (F.col("subjects") * F.col("n")), 2)).alias("pe"))
    po = (F.col("sq") - F.col("subjects") * F.col("n")) / (F.col("subjects") * F.col("n") * (F.col("n") - 1))
    done = whole.join(share, "rating_category_name").where("subjects >= 2").withColumn("po", po)
    return done.select("rating_category_name", "subjects", F.when(F.abs(F.col("pe") - 1) < 1e-12, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def category_spread(matches: DataFrame, generators: DataFrame) -> DataFrame:
    """By judge and category the mean and population deviation of the accuracy over generators that have truth, and all generators."""
    each = judge_accuracy(matches, ["judge_model", "generator_model"])
    long = each.unpivot(["judge_model", "generator_model"], list(CATEGORIES), "category", "accuracy")
    all_of = generators.select("judge_model", "generator_model").distinct().groupBy("judge_model").agg(F.count("*").alias("n_generators"))
    return long.groupBy("judge_model", "category").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std")).join(all_of, "judge_model")


def value_counts(ratings: DataFrame) -> DataFrame:
    """Different conversations, reviewers and categories, and the number of each value as a map."""
    counts = ratings.groupBy(F.col("rating_value").cast("string").alias("v")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("v", "n")))).alias("value_counts"))
    return ratings.agg(F.count_distinct("conversation_id").alias("conversations"), F.count_distinct("reviewer_name").alias("reviewers"), F.count_distinct("rating_category_name").alias("categories")).crossJoin(whole)


def sorted_ratings(ratings: DataFrame) -> DataFrame:
    """Ratings by conversation, then reviewer."""
    return ratings.orderBy("conversation_id", "reviewer_name")
