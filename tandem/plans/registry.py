"""All queries of the library by name, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions import text as X
from tandem.operators import agreement as A
from tandem.operators import generate as G
from tandem.operators import lexical as L
from tandem.operators import ranking as R
from tandem.operators import scoring as S
from tandem.operators import shape as H
from tandem.operators import similarity as M
from tandem.operators.quantiles import quantiles, with_quantiles
from tandem.plans import analysis, files, texts  # noqa: F401  they register their queries
from tandem.plans.base import QUERIES, SQL, Query, query
from tandem.plans.base import conversations as _conversations
from tandem.plans.base import longs as _longs
from tandem.plans.base import rounded as _rounded
from tandem.plans.views import view
from tandem.schemas import CATEGORIES, METRICS


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# -- ranking ------------------------------------------------------------------------------------------

RANKED = """means AS (SELECT language, model, metric, avg(score) AS mean, count(score) AS n FROM scores GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY language, metric ORDER BY round(mean, 12) DESC, model) AS rank FROM means)"""


@query(f"WITH {RANKED} SELECT language, model, metric, round(mean, 6) AS mean, n, rank FROM ranked", "scores")
def win_model_ranks(spark, sf):
    return _longs(_rounded(R.ranks(view(spark, sf, "scores")), "mean"), "rank")


@query("WITH m AS (SELECT metric, model, CAST(round(avg(score), 6) AS DOUBLE) AS mean FROM scores GROUP BY ALL) SELECT metric, model, mean, rank() OVER (PARTITION BY metric ORDER BY mean DESC) + (count(*) OVER (PARTITION BY metric, mean) - 1) / 2.0 AS rank FROM m", "scores")
def win_average_ranks(spark, sf):
    m = view(spark, sf, "scores").groupBy("metric", "model").agg(F.round(F.avg("score"), 6).alias("mean"))
    return R.average_ranks(m, ["metric"], "mean")


INVERSIONS = f"""WITH {RANKED},
both_ AS (SELECT a.metric, a.language AS l1, b.language AS l2, a.model, a.rank AS r1, b.rank AS r2 FROM ranked a JOIN ranked b ON a.metric = b.metric AND a.model = b.model AND a.language < b.language),
flips AS (SELECT i.metric, i.l1, i.l2, count(*) AS pairs, count(*) FILTER ((i.r1 < j.r1) <> (i.r2 < j.r2)) AS inversions FROM both_ i JOIN both_ j ON i.metric = j.metric AND i.l1 = j.l1 AND i.l2 = j.l2 AND i.model < j.model GROUP BY ALL),
again AS (SELECT metric, l1, l2, row_number() OVER (PARTITION BY metric, l1, l2 ORDER BY r1) AS x, row_number() OVER (PARTITION BY metric, l1, l2 ORDER BY r2) AS y FROM both_),
rho AS (SELECT metric, l1, l2, count(*) AS models, corr(x, y) AS rho FROM again GROUP BY ALL)
SELECT metric, l1, l2, models, pairs, inversions, round(inversions / pairs, 6) AS rate, round(1 - 2 * inversions / pairs, 6) AS tau, round(rho, 6) AS rho FROM flips JOIN rho USING (metric, l1, l2)"""


@query(INVERSIONS, "scores")
def stat_rank_inversions(spark, sf):
    return _rounded(R.inversions(R.ranks(view(spark, sf, "scores"))), "rate", "tau", "rho")


# The exact distribution of inversions by its recursion, and Student's t with whole degrees of freedom by its finite sum.
P_VALUES = f"""WITH RECURSIVE {INVERSIONS[5 : INVERSIONS.index("SELECT metric, l1, l2, models, pairs")].rstrip()},
base AS (SELECT metric, l1, l2, models, pairs, inversions, least(inversions, pairs - inversions) AS low, rho, models - 2 AS df, atan(rho * sqrt((models - 2) / (1 - rho * rho)) / sqrt(models - 2)) AS angle FROM flips JOIN rho USING (metric, l1, l2)),
counts(n, k, c) AS (SELECT 1::BIGINT, 0::BIGINT, 1.0::DOUBLE UNION ALL SELECT n + 1, k + j, sum(c) FROM (SELECT n, k, c, unnest(range(0, n + 1)) AS j FROM counts WHERE n < 33) GROUP BY n, k + j),
tails AS (SELECT n, k, sum(c) OVER (PARTITION BY n ORDER BY k) / sum(c) OVER (PARTITION BY n) AS below FROM counts),
t AS (SELECT *, CASE WHEN df % 2 = 0 THEN sin(abs(angle)) * list_sum(list_transform(range(0, df // 2), lambda j: pow(cos(angle), 2 * j) * coalesce(list_product(list_transform(range(1, j + 1), lambda i: (2 * i - 1) / (2 * i))), 1)))
ELSE 2 / pi() * (abs(angle) + sin(abs(angle)) * coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda j: pow(cos(angle), 2 * j + 1) * coalesce(list_product(list_transform(range(1, j + 1), lambda i: 2 * i / (2 * i + 1))), 1))), 0)) END AS inside FROM base)
SELECT metric, l1, l2, models, pairs, inversions, round(inversions / pairs, 6) AS rate, round(1 - 2 * inversions / pairs, 6) AS tau, round(rho, 6) AS rho, round(CASE WHEN 2 * low = pairs THEN 1.0 ELSE least(1.0, 2 * below) END, 6) AS tau_p, round(1 - inside, 6) AS rho_p FROM t JOIN tails ON tails.n = models AND tails.k = low"""


@query(P_VALUES, "scores")
def stat_rank_p_values(spark, sf):
    return _rounded(R.with_p_values(R.inversions(R.ranks(view(spark, sf, "scores")))), "rate", "tau", "rho", "tau_p", "rho_p")


@query()
def stat_bootstrap(spark, sf):
    return R.bootstrap(view(spark, sf, "scores"))


@query()
def stat_permutation(spark, sf):
    return R.permutation(R.ranks(view(spark, sf, "scores")))


@query(f"WITH {RANKED} SELECT a.metric, a.model, a.language AS l1, b.language AS l2, a.rank AS r1, b.rank AS r2 FROM ranked a JOIN ranked b ON a.metric = b.metric AND a.model = b.model AND a.language < b.language", "scores")
def join_common_models(spark, sf):
    return _longs(R.common(R.ranks(view(spark, sf, "scores"))), "r1", "r2")


# -- judge scores -------------------------------------------------------------------------------------


def _long_scores(spark, sf):
    return S.long_scores(view(spark, sf, "judgements"), ["conversation_id", "generator_model"], list(METRICS)).withColumnRenamed("generator_model", "model")


LONG = "long AS (SELECT conversation_id, generator_model AS model, unnest(['G', 'R', 'C', 'F']) AS metric, unnest([G, R, C, F]) AS score FROM judgements)"


@query(f"WITH {LONG} SELECT conversation_id, model, metric, score FROM long", "judgements")
def src_unpivot_scores(spark, sf):
    return _long_scores(spark, sf)


@query(f"WITH {LONG} SELECT model, metric, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max FROM long GROUP BY model, metric", "judgements")
def agg_score_statistics(spark, sf):
    return _rounded(S.score_statistics(_long_scores(spark, sf), ["model", "metric"]), "mean", "std")


@query(f"WITH {LONG}, tops AS (SELECT * FROM (VALUES ('G', 4), ('R', 4), ('C', 3), ('F', 3)) t(metric, top)), bins AS (SELECT model, metric, unnest(range(top + 1)) AS score FROM (SELECT DISTINCT model, metric FROM long) JOIN tops USING (metric)) SELECT model, metric, CAST(score AS INT) AS score, count(long.score) AS n FROM bins LEFT JOIN long USING (model, metric, score) GROUP BY ALL", "judgements")
def agg_score_histogram(spark, sf):
    return S.score_histogram(_long_scores(spark, sf), METRICS)


@query("SELECT generator_model, round(avg(G), 6) AS G, round(avg(R), 6) AS R, round(avg(C), 6) AS C, round(avg(F), 6) AS F, round(avg(G) + avg(R) + avg(C) + avg(F), 6) AS total FROM judgements GROUP BY generator_model", "judgements")
def agg_model_comparison(spark, sf):
    return _rounded(S.model_comparison(view(spark, sf, "judgements")), *"GRCF", "total")


# -- label recovery -----------------------------------------------------------------------------------

GOOD = " AND ".join(f"coalesce({c}, '') <> ''" for c in CATEGORIES)
CATS = ", ".join(CATEGORIES)
NAMES = ", ".join(f"'{c}'" for c in CATEGORIES)


@query(f"SELECT judge_model, count(*) AS n, count(*) FILTER ({GOOD}) AS successes, count(*) FILTER (NOT ({GOOD})) AS failures, round(count(*) FILTER ({GOOD}) / count(*), 6) AS success_rate, round(avg(nullif(processing_time, 0)), 6) AS mean_time, round(sum(nullif(processing_time, 0)), 6) AS total_time FROM predictions GROUP BY judge_model", "predictions")
def agg_success(spark, sf):
    return _rounded(S.success_statistics(view(spark, sf, "predictions"), ["judge_model"]), "success_rate", "mean_time", "total_time")


VALUES = f"vals AS (SELECT category, value, count(*) AS n FROM (SELECT unnest([{NAMES}]) AS category, unnest([{CATS}]) AS value FROM predictions WHERE {GOOD}) GROUP BY ALL)"


@query(f"WITH {VALUES} SELECT * FROM vals", "predictions")
def agg_value_distribution(spark, sf):
    return S.value_distribution(view(spark, sf, "predictions"))


@query(f"WITH {VALUES} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, value) AS rank FROM vals) WHERE rank <= 3", "predictions")
def top_values(spark, sf):
    return _longs(S.top_values(view(spark, sf, "predictions"), 3), "rank")


@query(f"SELECT coalesce(error, 'Incomplete classification') AS error, count(*) AS n FROM predictions WHERE NOT ({GOOD}) GROUP BY 1 ORDER BY n DESC, error LIMIT 5", "predictions")
def top_errors(spark, sf):
    return S.error_counts(view(spark, sf, "predictions"))


PAIRS = f"pairs AS (SELECT p.judge_model, unnest([{NAMES}]) AS category, unnest([{', '.join('t.' + c for c in CATEGORIES)}]) AS y_true, unnest([{', '.join('p.' + c for c in CATEGORIES)}]) AS y_pred FROM predictions p JOIN truth t ON p.generator_model = t.generator_model AND p.conversation_id = t.conversation_id), used AS (SELECT * FROM pairs WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)"
REPORT = f"""WITH {PAIRS}, labs AS (SELECT judge_model, category, y_true AS label FROM used UNION SELECT judge_model, category, y_pred FROM used),
rep AS (SELECT l.judge_model, l.category, l.label, count(*) FILTER (u.y_true = l.label AND u.y_pred = l.label) AS tp, count(*) FILTER (u.y_pred = l.label) AS predicted, count(*) FILTER (u.y_true = l.label) AS support FROM labs l JOIN used u ON l.judge_model = u.judge_model AND l.category = u.category GROUP BY ALL),
done AS (SELECT judge_model, category, label, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2 * tp / (predicted + support) END AS f1, support, tp, predicted FROM rep)"""


def _pairs(spark, sf):
    return S.paired(view(spark, sf, "predictions"), view(spark, sf, "truth"), ["generator_model", "conversation_id"], ["judge_model"])


@query(f"{REPORT} SELECT judge_model, category, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM done", "predictions", "truth")
def agg_class_report(spark, sf):
    return _rounded(S.class_report(S.confusion(_pairs(spark, sf), ["judge_model", "category"]), ["judge_model", "category"]), "precision", "recall", "f1").drop("tp", "predicted")


CATEGORY = f"{REPORT}, cat AS (SELECT judge_model, category, CAST(sum(support) AS BIGINT) AS n, sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, count(*) FILTER (support > 0) AS true_labels, count(*) FILTER (predicted > 0) AS predicted_labels FROM done GROUP BY ALL)"


@query(f"{CATEGORY} SELECT judge_model, category, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, true_labels, predicted_labels FROM cat", "predictions", "truth")
def agg_category_scores(spark, sf):
    return _rounded(S.category_scores(_pairs(spark, sf), ["judge_model", "category"]), "accuracy", "macro_f1", "weighted_f1")


@query(f"{CATEGORY} SELECT judge_model, round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS std_accuracy FROM cat WHERE n > 0 GROUP BY judge_model", "predictions", "truth")
def agg_overall_accuracy(spark, sf):
    return _rounded(S.overall_accuracy(S.category_scores(_pairs(spark, sf), ["judge_model", "category"]), ["judge_model"]), "mean_accuracy", "std_accuracy")


@query("SELECT 'LRA' AS metric, p.judge_model, p.generator_model AS model, p.conversation_id, CASE WHEN p.industry = t.industry AND p.problem = t.problem THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM predictions p JOIN truth t ON p.conversation_id = t.conversation_id AND p.generator_model = t.generator_model", "predictions", "truth")
def join_label_recovery_score(spark, sf):
    found = S.recovery_scores(view(spark, sf, "predictions"), view(spark, sf, "truth"), ["generator_model", "conversation_id"], ["judge_model"])
    return found.select(F.lit("LRA").alias("metric"), "judge_model", F.col("generator_model").alias("model"), "conversation_id", "score")


# -- agreement ----------------------------------------------------------------------------------------

_EQ = lambda a, b: ", ".join(f"coalesce({a}{c}, '') = coalesce({b}{c}, '') AS m_{c}" for c in CATEGORIES)
_ALL = " AND ".join(f"m_{c}" for c in CATEGORIES)
_AVGS = ", ".join(f"round(avg(CAST(m_{c} AS INT)), 6) AS {c}" for c in CATEGORIES)
MATCHES = f"WITH j AS (SELECT p.judge_model, p.generator_model, p.conversation_id, {_EQ('p.', 't.')} FROM predictions p JOIN truth t ON p.generator_model = t.generator_model AND p.conversation_id = t.conversation_id)"


def _matches(spark, sf):
    return A.judged(view(spark, sf, "predictions"), view(spark, sf, "truth"))


@query(f"{MATCHES} SELECT judge_model, count(*) AS n, round(avg(CAST({_ALL} AS INT)), 6) AS accuracy, {_AVGS} FROM j GROUP BY judge_model", "predictions", "truth")
def agg_judge_accuracy(spark, sf):
    return _rounded(A.judge_accuracy(_matches(spark, sf), ["judge_model"]), "accuracy", *CATEGORIES)


@query(f"{MATCHES}, e AS (SELECT judge_model, generator_model, avg(CAST({_ALL} AS INT)) AS a FROM j GROUP BY ALL) SELECT judge_model, round(avg(a), 6) AS mean_accuracy, round(stddev_pop(a), 6) AS std_accuracy, count(*) AS n_generators FROM e GROUP BY judge_model", "predictions", "truth")
def agg_judge_consistency(spark, sf):
    return _rounded(A.judge_consistency(view(spark, sf, "predictions"), _matches(spark, sf)), "mean_accuracy", "std_accuracy")


PAIRWISE = f"WITH ab AS (SELECT a.judge_model AS judge_a, b.judge_model AS judge_b, {_EQ('a.', 'b.')} FROM predictions a JOIN predictions b ON a.generator_model = b.generator_model AND a.conversation_id = b.conversation_id AND a.judge_model < b.judge_model)"


@query(f"{PAIRWISE} SELECT judge_a, judge_b, count(*) AS n_common, round(avg(CAST({_ALL} AS INT)), 6) AS agreement, {_AVGS} FROM ab GROUP BY ALL", "predictions")
def join_pairwise_agreement(spark, sf):
    return _rounded(A.pairwise_agreement(view(spark, sf, "predictions"), "processing_time"), "agreement", *CATEGORIES)


@query(f"{PAIRWISE}, p AS (SELECT judge_a, judge_b, avg(CAST({_ALL} AS INT)) AS agreement, {_AVGS.replace('round(', '(').replace(', 6)', ')')} FROM ab GROUP BY ALL) SELECT count(*) AS n_pairs, round(avg(agreement), 6) AS agreement, {', '.join(f'round(avg({c}), 6) AS {c}' for c in CATEGORIES)} FROM p", "predictions")
def agg_mean_agreement(spark, sf):
    return _rounded(A.mean_agreement(A.pairwise_agreement(view(spark, sf, "predictions"), "processing_time")), "agreement", *CATEGORIES)


# -- ratings ------------------------------------------------------------------------------------------


@query("SELECT reviewer_name, count(DISTINCT conversation_id) AS conversations, count(DISTINCT rating_category_name) AS categories, count(*) AS ratings, round(avg(rating_value), 2) AS mean_rating FROM ratings GROUP BY reviewer_name", "ratings")
def agg_reviewers(spark, sf):
    return A.reviewer_statistics(view(spark, sf, "ratings"))


@query("SELECT data_source, count(DISTINCT conversation_id) AS conversations, count(DISTINCT rating_category_name) AS categories, count(*) AS ratings, round(avg(rating_value), 2) AS mean_rating FROM ratings GROUP BY data_source", "ratings")
def agg_data_sources(spark, sf):
    return A.reviewer_statistics(view(spark, sf, "ratings"), "data_source")


@query("WITH u AS (SELECT * FROM ratings UNION ALL SELECT * FROM ratings WHERE data_source = 'calibration') SELECT reviewer_name, conversation_id, rating_category_name, rating_value, data_source FROM (SELECT *, row_number() OVER (PARTITION BY reviewer_name, conversation_id, rating_category_name ORDER BY data_source, rating_value) AS rn FROM u) WHERE rn = 1", "ratings")
def win_keep_first(spark, sf):
    r = view(spark, sf, "ratings")
    return A.keep_first(r.unionByName(r.where("data_source = 'calibration'"), allowMissingColumns=True), ["data_source", "rating_value"])


@query("WITH u AS (SELECT * FROM ratings UNION ALL SELECT * FROM ratings WHERE data_source = 'calibration') SELECT reviewer_name, conversation_id, rating_category_name, rating_value, data_source FROM (SELECT *, count(*) OVER (PARTITION BY reviewer_name, conversation_id, rating_category_name) AS n FROM u) WHERE n > 1", "ratings")
def win_duplicates(spark, sf):
    r = view(spark, sf, "ratings")
    return A.duplicates(r.unionByName(r.where("data_source = 'calibration'")))


@query("SELECT conversation_id, rating_category_name, avg(rating_value) FILTER (reviewer_name = 'Annotator1') AS Annotator1, avg(rating_value) FILTER (reviewer_name = 'Annotator2') AS Annotator2, avg(rating_value) FILTER (reviewer_name = 'Annotator4') AS Annotator4 FROM ratings GROUP BY ALL", "ratings")
def agg_rating_pivot(spark, sf):
    return A.rating_pivot(view(spark, sf, "ratings"), ["Annotator1", "Annotator2", "Annotator4"])


VOTES = "votes AS (SELECT conversation_id, rating_category_name, rating_value, count(*) AS votes FROM ratings GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, rating_category_name ORDER BY votes DESC, rating_value) AS rn FROM votes)"


@query(f"WITH {VOTES} SELECT conversation_id, rating_category_name, rating_value AS vote, votes FROM best WHERE rn = 1", "ratings")
def agg_majority_vote(spark, sf):
    return A.majority(view(spark, sf, "ratings"))


@query(f"WITH {VOTES} SELECT rating_category_name, round(avg(rating_value), 6) AS mean, round(stddev_samp(rating_value), 6) AS std, count(*) AS n FROM best WHERE rn = 1 GROUP BY 1", "ratings")
def agg_vote_statistics(spark, sf):
    return _rounded(A.vote_statistics(A.majority(view(spark, sf, "ratings")), "vote"), "mean", "std")


FLAGS = "WITH b AS (SELECT conversation_id, rating_category_name, count(rating_value) AS n, max(rating_value) - min(rating_value) AS gap, count(DISTINCT rating_value) AS kinds FROM ratings GROUP BY ALL), f AS (SELECT conversation_id, rating_category_name, contains(lower(rating_category_name), 'fluent') AND n >= 2 AND gap >= 2 AS fluency_flag, rating_category_name = 'Does the content make sense?' AND n >= 2 AND kinds > 1 AS coherence_flag FROM b)"


@query(f"{FLAGS} SELECT * FROM f", "ratings")
def stat_rating_flags(spark, sf):
    return A.rating_flags(view(spark, sf, "ratings"))


@query(f"{FLAGS} SELECT rating_category_name, round(avg(CAST(fluency_flag AS INT)), 6) AS fluency, round(avg(CAST(coherence_flag AS INT)), 6) AS coherence FROM f GROUP BY 1", "ratings")
def agg_flag_rates(spark, sf):
    flags = A.rating_flags(view(spark, sf, "ratings"))
    return flags.groupBy("rating_category_name").agg(F.round(F.avg(F.col("fluency_flag").cast("int")), 6).alias("fluency"), F.round(F.avg(F.col("coherence_flag").cast("int")), 6).alias("coherence"))


@query("WITH c AS (SELECT rating_category_name, conversation_id, rating_value, count(*) AS c FROM ratings GROUP BY ALL), r AS (SELECT rating_category_name, conversation_id, sum(c) AS n, sum(c * c) AS sq FROM c GROUP BY ALL HAVING sum(c) >= 2), w AS (SELECT rating_category_name, count(*) AS subjects, sum(sq) AS sq, arg_min(n, conversation_id) AS n FROM r GROUP BY 1), s AS (SELECT c.rating_category_name, c.rating_value, sum(c) AS c FROM c JOIN r USING (rating_category_name, conversation_id) GROUP BY 1, 2), pe AS (SELECT rating_category_name, sum(pow(s.c / (w.subjects * w.n), 2)) AS pe FROM s JOIN w USING (rating_category_name) GROUP BY 1) SELECT rating_category_name, subjects, round(CASE WHEN abs(pe - 1) < 1e-12 THEN 1.0 ELSE ((sq - subjects * n) / (subjects * n * (n - 1)) - pe) / (1 - pe) END, 6) AS kappa FROM w JOIN pe USING (rating_category_name) WHERE subjects >= 2", "ratings")
def stat_fleiss_kappa(spark, sf):
    return _rounded(A.fleiss_kappa(view(spark, sf, "ratings")), "kappa")


# -- shape --------------------------------------------------------------------------------------------


@query("SELECT model, language, conv_id AS conversation_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS message_id, role AS from_name, CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'customer' ELSE role END AS from_type, text AS message FROM turns", "turns")
def prj_flatten_messages(spark, sf):
    return _longs(H.flatten(_conversations(spark, sf)), "message_id")


@query("SELECT conv_id AS conversation_id, count(*) AS n_messages, string_agg(text, chr(10) ORDER BY turn) AS texts FROM turns GROUP BY conv_id", "turns")
def agg_regroup(spark, sf):
    flat = H.flatten(_conversations(spark, sf))
    return H.regroup(flat, ["conversation_id"], "message_id", ["message"]).select("conversation_id", "n_messages", F.array_join(F.transform("messages", lambda m: m.message), "\n").alias("texts"))


@query("SELECT source AS model, lang AS language, count(*) AS n, CASE WHEN GROUPING(source) = 0 AND GROUPING(lang) = 0 THEN 'both' WHEN GROUPING(source) = 0 THEN 'model' WHEN GROUPING(lang) = 0 THEN 'language' ELSE 'all' END AS level FROM documents GROUP BY GROUPING SETS ((), (source), (lang), (source, lang))")
def agg_grouping_sets(spark, sf):
    return H.count_by_model_and_language(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("model"), F.col("lang").alias("language")))


@query("WITH e AS (SELECT language, conv_id, count(*) AS n FROM turns GROUP BY ALL) SELECT language, CAST(sum(n) AS BIGINT) AS n_messages, count(*) AS n_conversations, round(avg(n), 6) AS mean_length, min(n) AS min_length, max(n) AS max_length FROM e GROUP BY language", "turns")
def agg_dataset_statistics(spark, sf):
    return _rounded(H.dataset_statistics(view(spark, sf, "turns").withColumnRenamed("conv_id", "conversation_id")), "mean_length")


@query("""WITH m AS (SELECT language, conv_id, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN role ELSE '' END AS industry, concat(role, CAST(conv_id % 5 AS VARCHAR)) AS problem FROM turns),
e AS (SELECT language, conv_id, count(*) AS n FROM m GROUP BY ALL), l AS (SELECT language, count(DISTINCT coalesce(industry, '')) AS n_industry, count(DISTINCT problem) AS n_problem FROM m GROUP BY language)
SELECT language, CAST(sum(n) AS BIGINT) AS n_messages, count(*) AS n_conversations, round(avg(n), 6) AS mean_length, min(n) AS min_length, max(n) AS max_length, any_value(n_industry) AS n_industry, any_value(n_problem) AS n_problem FROM e JOIN l USING (language) GROUP BY language""", "turns")
def agg_dataset_labels(spark, sf):
    """Labels that differ within a conversation, absent and empty ones among them."""
    t = view(spark, sf, "turns").withColumnRenamed("conv_id", "conversation_id")
    labelled = t.withColumn("industry", F.when(F.col("turn") % 3 == 1, F.col("role")).when(F.col("turn") % 3 == 2, "")).withColumn("problem", F.concat("role", (F.col("conversation_id") % 5).cast("string")))
    return _rounded(H.dataset_statistics(labelled), "mean_length")


@query("SELECT doc_id, lang AS language, source FROM documents WHERE doc_id % 10 < 7 UNION ALL SELECT doc_id, lang, source FROM documents WHERE doc_id % 10 >= 7")
def set_merge(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("language"), "source")
    return H.merge_new(d.where("doc_id % 10 < 7"), d.where("doc_id % 10 >= 4"), ["language", "doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id % 10 BETWEEN 4 AND 6 ORDER BY doc_id LIMIT 5")
def join_duplicate_report(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    return H.overlapping(d.where("doc_id % 10 < 7"), d.where("doc_id % 10 >= 4"), "doc_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3")
def top_limit_per_model(spark, sf):
    return H.first_by(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), ["source"], ["doc_id"], 3)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(source, '') AS source, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, '') AS tag FROM documents")
def prj_structure(spark, sf):
    return H.structure(spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("tag")))


@query("SELECT source FROM documents WHERE lang = 'de' INTERSECT SELECT source FROM documents WHERE lang = 'fr'")
def set_common_models(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return H.common_keys(d.where("lang = 'de'"), d.where("lang = 'fr'"), "source")


@query("SELECT role FROM conversations EXCEPT SELECT 'user'")
def set_difference(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("role")
    return H.absent_keys(c, c.where("role = 'user'"), "role")


@query("SELECT doc_id, source AS language, concat('convo_gpt-4.1_', lang, '_20260127-143052') AS stem, 'gpt-4.1' AS p_model, lang AS p_language, '20260127-143052' AS p_datetime, CASE WHEN length(text) > 25 THEN concat(substr(text, 1, 25), '...') ELSE text END AS short, CASE WHEN n_chars < 1000 THEN 'n<1K' WHEN n_chars < 10000 THEN '1K<n<10K' WHEN n_chars < 100000 THEN '10K<n<100K' ELSE '100K<n<1M' END AS bucket FROM documents")
def prj_names(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("stem", F.concat(F.lit("convo_gpt-4.1_"), "lang", F.lit("_20260127-143052"))).withColumn("p", X.file_parts(F.col("stem")))
    return d.select("doc_id", F.col("source").alias("language"), "stem", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("model", "language", "datetime")), X.shortened(F.col("text")).alias("short"), X.size_bucket(F.col("n_chars")).alias("bucket"))


@query(r"SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS value FROM events")
def fn_json(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.element_at(X.parsed_values(F.col("props")), 1).alias("value"))


# -- texts --------------------------------------------------------------------------------------------

TOKENS = r"tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents)"


def _tokens(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", X.tokens(F.col("text")).alias("tokens"))


@query(rf"WITH {TOKENS} SELECT doc_id, len(t) AS n, array_to_string(t[1:5], ' ') AS head, len(list_filter(t, lambda x: length(x) >= 2)) AS n2 FROM tok")
def prj_tokens(spark, sf):
    d = _tokens(spark, sf)
    return d.select("doc_id", F.size("tokens").cast("long").alias("n"), F.array_join(F.slice("tokens", 1, 5), " ").alias("head"), F.size(F.filter("tokens", lambda t: F.length(t) >= 2)).cast("long").alias("n2"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\[.*?\]', '', 'g'), '\(.*?\)', '', 'g') AS clean FROM documents")
def prj_clean(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.clean(F.col("text")).alias("clean"))


@query(rf"WITH {TOKENS} SELECT doc_id, round(CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_distinct(t)) / len(t) END, 6) AS ttr FROM tok")
def agg_ttr(spark, sf):
    return _tokens(spark, sf).select("doc_id", F.round(L.ttr(F.col("tokens")), 6).alias("ttr"))


@query(rf"WITH {TOKENS}, w AS (SELECT doc_id, t, len(t) AS n, least(100, len(t)) AS w FROM tok WHERE len(t) > 0), s AS (SELECT doc_id, w, unnest(range(1, CAST(n - w + 2 AS BIGINT))) AS i, t FROM w), m AS (SELECT doc_id, sum(len(list_distinct(t[i : i + w - 1]))) / (max(w) * count(*)) AS mattr FROM s GROUP BY doc_id) SELECT tok.doc_id, round(coalesce(mattr, 0.0), 6) AS mattr FROM tok LEFT JOIN m ON tok.doc_id = m.doc_id")
def win_mattr(spark, sf):
    return _rounded(L.mattr(_tokens(spark, sf), ["doc_id"]), "mattr")


BLEU_DOCS = r"d AS (SELECT model, role, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS key, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM turns)"


def _bleu_docs(spark, sf):
    t = view(spark, sf, "turns")
    return t.select("model", "role", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), X.tokens(F.col("text")).alias("tokens"))


@query(rf"WITH {BLEU_DOCS}, e AS (SELECT model, role, key, n, unnest(list_transform(range(1, CAST(len(t) - n + 2 AS BIGINT)), lambda i: array_to_string(t[i : i + n - 1], chr(31)))) AS g FROM d, (VALUES (1), (2), (3), (4)) v(n) WHERE len(t) >= n), c AS (SELECT model, role, key, n, g, count(*) AS c FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model, role, n, g ORDER BY c DESC, key DESC) AS rn FROM c), t AS (SELECT model, role, n, g, max(c) FILTER (rn = 1) AS c1, max(key) FILTER (rn = 1) AS d1, max(c) FILTER (rn = 2) AS c2 FROM r GROUP BY ALL) SELECT model, role, key, n, CAST(sum(least(c, CASE WHEN key = d1 THEN coalesce(c2, 0) ELSE c1 END)) AS BIGINT) AS clipped, CAST(sum(c) AS BIGINT) AS total FROM c JOIN t USING (model, role, n, g) GROUP BY ALL", "turns")
def stat_self_bleu_counts(spark, sf):
    return L.self_bleu_counts(_bleu_docs(spark, sf), ["model", "role"], "key")


BLEU = rf"""WITH {BLEU_DOCS}, e AS (SELECT model, role, key, n, unnest(list_transform(range(1, CAST(len(t) - n + 2 AS BIGINT)), lambda i: array_to_string(t[i : i + n - 1], chr(31)))) AS g FROM d, (VALUES (1), (2), (3), (4)) v(n) WHERE len(t) >= n), c AS (SELECT model, role, key, n, g, count(*) AS c FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model, role, n, g ORDER BY c DESC, key DESC) AS rn FROM c), t AS (SELECT model, role, n, g, max(c) FILTER (rn = 1) AS c1, max(key) FILTER (rn = 1) AS d1, max(c) FILTER (rn = 2) AS c2 FROM r GROUP BY ALL), clips AS (SELECT model, role, key, n, CAST(sum(least(c, CASE WHEN key = d1 THEN coalesce(c2, 0) ELSE c1 END)) AS BIGINT) AS clipped, CAST(sum(c) AS BIGINT) AS total FROM c JOIN t USING (model, role, n, g) GROUP BY ALL),
s AS (SELECT model, role, key, len(t) AS n FROM d WHERE len(t) > 0),
near AS (SELECT a.model, a.role, a.key, arg_min(b.n, abs(b.n - a.n) * 1000000 + b.n) AS ref FROM s a JOIN s b ON a.model = b.model AND a.role = b.role AND a.key <> b.key GROUP BY ALL),
h AS (SELECT s.*, ref, [coalesce(max(clipped) FILTER (clips.n = 1), 0), coalesce(max(clipped) FILTER (clips.n = 2), 0), coalesce(max(clipped) FILTER (clips.n = 3), 0), coalesce(max(clipped) FILTER (clips.n = 4), 0)] AS hit
FROM s LEFT JOIN near ON s.model = near.model AND s.role = near.role AND s.key = near.key LEFT JOIN clips ON s.model = clips.model AND s.role = clips.role AND s.key = clips.key GROUP BY s.model, s.role, s.key, s.n, ref),
b AS (SELECT model, role, key, n AS len, ref, CASE WHEN ref IS NULL THEN NULL WHEN hit[1] = 0 THEN 0.0 WHEN n > 1 THEN exp(CASE WHEN n > ref THEN 0.0 ELSE 1 - ref / n END
+ list_sum(list_transform([1, 2, 3, 4], lambda i: ln(CASE WHEN hit[i] > 0 THEN CAST(hit[i] AS DOUBLE) ELSE ln(n) / (5 * pow(2, len(list_filter(hit[2:i], lambda x: x = 0)))) END / greatest(n - i + 1, 1)) / 4))) END AS bleu FROM h)"""


@query(f"{BLEU} SELECT model, role, key, len, ref, round(bleu, 6) AS bleu FROM b", "turns")
def stat_self_bleu(spark, sf):
    return _longs(_rounded(L.self_bleu(_bleu_docs(spark, sf), ["model", "role"], "key"), "bleu"), "len", "ref")


@query(f"{BLEU} SELECT model, role, round(avg(bleu), 6) AS mean, round(stddev_pop(bleu), 6) AS std, round(quantile_cont(bleu, 0.5), 6) AS median, round(min(bleu), 6) AS min, round(max(bleu), 6) AS max, count(bleu) AS n, count(*) FILTER (bleu IS NULL) AS failed FROM b GROUP BY model, role", "turns")
def agg_self_bleu(spark, sf):
    return _rounded(L.bleu_summary(L.self_bleu(_bleu_docs(spark, sf), ["model", "role"], "key"), ["model", "role"]), "mean", "std", "median", "min", "max")


@query("SELECT source, lang, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, max(n_chars) AS max, quantile_cont(n_chars, 0.5) AS median FROM documents GROUP BY ALL")
def agg_length_statistics(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    base = d.groupBy("source", "lang").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_samp("n_chars"), 6).alias("std"), F.min("n_chars").alias("min"), F.max("n_chars").alias("max"))
    return with_quantiles(base, quantiles(d, ["source", "lang"], ["n_chars"]), ["source", "lang"], {"n_chars_0.5": "median"})


@query("SELECT source, lang, quantile_cont(n_chars, 0.0) AS q0, quantile_cont(n_chars, 0.025) AS q025, quantile_cont(n_chars, 0.9) AS q9, quantile_cont(n_chars, 1.0) AS q1, round(quantile_cont(n_chars / 7.0 - 50, 0.5), 6) AS shifted FROM documents GROUP BY ALL")
def agg_quantiles(spark, sf):
    """Several exact quantiles of two columns, one with negative values."""
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("shifted", F.col("n_chars") / 7.0 - 50)
    found = quantiles(d, ["source", "lang"], ["n_chars", "shifted"], (0.0, 0.025, 0.5, 0.9, 1.0))
    return _rounded(found.select("source", "lang", *(F.col(f"`n_chars_{q}`").alias(name) for q, name in ((0.0, "q0"), (0.025, "q025"), (0.9, "q9"), (1.0, "q1"))), F.col("`shifted_0.5`").alias("shifted")), "shifted")


@query(rf"WITH {TOKENS}, r AS (SELECT source AS model, CASE WHEN coalesce(len(t), 0) = 0 THEN 0.0 ELSE len(list_distinct(t)) / len(t) END AS ttr FROM tok JOIN documents USING (doc_id)) SELECT model, round(avg(ttr), 6) AS mean, round(stddev_samp(ttr), 6) AS std, round(min(ttr), 6) AS min, round(max(ttr), 6) AS max, round(quantile_cont(ttr, 0.5), 6) AS median FROM r GROUP BY model")
def agg_ttr_by_model(spark, sf):
    return _rounded(L.ttr_statistics(_tokens(spark, sf).withColumnRenamed("source", "model"), ["model"]), "mean", "std", "min", "max", "median")


@query("SELECT lang, count(text) - count(DISTINCT text) AS num_duplicates, count(*) FILTER (coalesce(text, '') = '') AS num_empty FROM documents GROUP BY lang")
def win_duplicate_counts(spark, sf):
    return M.duplicate_counts(spark.read.parquet(f"{sf}/documents.parquet"), ["lang"], "text")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def win_distinct_texts(spark, sf):
    return M.distinct_texts(spark.read.parquet(f"{sf}/documents.parquet"), ["lang"], "text", "doc_id").select("doc_id", "lang")


@query("WITH p AS (SELECT a.label, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT label, round(avg(s), 6) AS avg_similarity, round(max(s), 6) AS max_similarity, round(min(s), 6) AS min_similarity, round(stddev_pop(s), 6) AS std_similarity, round(quantile_cont(s, 0.5), 6) AS median_similarity, count(*) AS num_comparisons FROM p GROUP BY label")
def stat_similarity(spark, sf):
    return _rounded(M.similarity_summary(spark.read.parquet(f"{sf}/embeddings.parquet"), ["label"], "vec_id", "embedding"), *(f"{c}_similarity" for c in ("avg", "max", "min", "std", "median")))


@query()
def gen_configs(spark, sf):
    """A configuration for every conversation, from the languages and kinds of agents that there are."""
    ids = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("id")).distinct()
    return G.configs_of(ids, {"language": ["et", "fi", "hu"], "channel": ["email", "chat"], "agent_type": ["human", "bot"], "agent_experience": ["junior", "senior"]}, ["Anna", "Mart", "Eva"])
