"""Judge scores, label recovery, accuracy and F1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import text as X
from tandem.schemas import CATEGORIES


def score_statistics(scores: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, population deviation, least and greatest score."""
    return scores.groupBy(*keys).agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))


def score_histogram(scores: DataFrame, tops: dict[str, int]) -> DataFrame:
    """Counts of every score from 0 to the metric's top, zeros too."""
    top = F.element_at(F.create_map(*(x for m, t in tops.items() for x in (F.lit(m), F.lit(t)))), F.col("metric"))
    bins = scores.select("model", "metric").distinct().select("model", "metric", F.explode(F.sequence(F.lit(0), top)).alias("score"))
    counts = scores.groupBy("model", "metric", F.col("score").cast("int").alias("score")).agg(F.count("*").alias("c"))
    return bins.join(counts, ["model", "metric", "score"], "left").select("model", "metric", "score", F.coalesce("c", F.lit(0)).alias("n"))


def model_comparison(results: DataFrame) -> DataFrame:
    """Mean of each metric by model, and their sum."""
    means = results.groupBy("generator_model").agg(*(F.avg(m).alias(m) for m in "GRCF"))
    return means.withColumn("total", F.col("G") + F.col("R") + F.col("C") + F.col("F"))


def success_statistics(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Successes, failures, success rate, and processing time over rows that have one."""
    good = X.successful(*(F.col(c) for c in CATEGORIES))
    time = F.when(F.col("processing_time") != 0, F.col("processing_time"))
    return labels.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(good).alias("successes"), F.count_if(~good).alias("failures"), (F.count_if(good) / F.count("*")).alias("success_rate"), F.avg(time).alias("mean_time"), F.sum(time).alias("total_time"))


def value_distribution(labels: DataFrame) -> DataFrame:
    """Counts of the values of each category over the successful rows."""
    good = labels.where(X.successful(*(F.col(c) for c in CATEGORIES)))
    return good.unpivot([], list(CATEGORIES), "category", "value").groupBy("category", "value").agg(F.count("*").alias("n"))


def top_values(labels: DataFrame, most: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "value"))
    return value_distribution(labels).withColumn("rank", at).where(F.col("rank") <= most)


def error_counts(labels: DataFrame, most: int = 5) -> DataFrame:
    failed = labels.where(~X.successful(*(F.col(c) for c in CATEGORIES)))
    return failed.groupBy(F.coalesce("error", F.lit("Incomplete classification")).alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(most)


def paired(labels: DataFrame, truth: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """(extra, category, y_true, y_pred) of the rows that have truth and a prediction."""
    t = truth.select(*keys, *(F.col(c).alias(f"t_{c}") for c in CATEGORIES))
    joined = labels.join(t, keys)
    pair = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(f"t_{c}").alias("y_true"), F.col(c).alias("y_pred")) for c in CATEGORIES))).alias("p")
    return joined.select(*extra, pair).select(*extra, "p.*").where("y_pred is not null and y_true is not null")


def confusion(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))


def class_report(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of every label met as truth or prediction; 0/0 is 0."""
    side = F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s")
    long = counts.select(*keys, "n", (F.col("y_true") == F.col("y_pred")).alias("hit"), side).select(*keys, "n", "hit", "s.*")
    by = long.groupBy(*keys, "label").agg(F.sum(F.when(F.col("hit"), F.col("n") * F.col("t")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("p")).alias("predicted"), F.sum(F.col("n") * F.col("t")).alias("support"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return by.select(*keys, "label", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support", "tp", "predicted")


def category_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, macro and weighted F1, rows and label counts by keys (the category among them)."""
    report = class_report(confusion(pairs, keys), keys)
    return report.groupBy(*keys).agg(F.count_if(F.col("predicted") > 0).alias("predicted_labels"), F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.count_if(F.col("support") > 0).alias("true_labels"))


def category_scores_of_all(pairs: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """The category scores of every group, zeros where it has no row with truth and prediction."""
    every = groups.crossJoin(F.broadcast(pairs.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")))
    return every.join(category_scores(pairs, [*keys, "category"]), [*keys, "category"], "left").na.fill(0)


def overall_accuracy(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of accuracy over the categories that have rows."""
    return scores.where("n > 0").groupBy(*keys).agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"))


def long_scores(judgements: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A row for each metric of a judgement (metric, score); absent scores stay null."""
    return judgements.unpivot(keys, metrics, "metric", "score")


def recovery_scores(labels: DataFrame, truth: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """(keys, extra, score) of labels that have truth: 1 where industry and problem are both right."""
    own = truth.select(*keys, F.col("industry").alias("_industry"), F.col("problem").alias("_problem"))
    right = (F.col("industry") == F.col("_industry")) & (F.col("problem") == F.col("_problem"))
    return labels.join(own, keys).select(*keys, *extra, F.when(right, 1.0).otherwise(0.0).alias("score"))
