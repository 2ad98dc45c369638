"""Queries of whole analyses: metrics by conversation and model, ranking, agreement in detail."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions import text as X
from tandem.operators import agreement as A
from tandem.operators import lexical as L
from tandem.operators import metrics as C
from tandem.operators import ranking as R
from tandem.operators import scoring as S
from tandem.operators import shape as H
from tandem.plans.base import conversations, longs, query, rounded
from tandem.plans.views import view
from tandem.schemas import CATEGORIES
from tandem.sources.staging import stage

_ACC = ", ".join(f"avg(CAST(coalesce(p.{c}, '') = coalesce(t.{c}, '') AS INT)) AS {c}" for c in CATEGORIES)
_CATS = ", ".join(CATEGORIES)
_NAMES = ", ".join(f"'{c}'" for c in CATEGORIES)


@query(f"WITH e AS (SELECT p.judge_model, p.generator_model, {_ACC} FROM predictions p JOIN truth t ON p.generator_model = t.generator_model AND p.conversation_id = t.conversation_id WHERE p.generator_model <> 'src1' GROUP BY ALL), l AS (SELECT judge_model, unnest([{_NAMES}]) AS category, unnest([{_CATS}]) AS a FROM e), g AS (SELECT judge_model, count(DISTINCT generator_model) AS n_generators FROM predictions GROUP BY 1) SELECT judge_model, category, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, n_generators FROM l JOIN g USING (judge_model) GROUP BY ALL", "predictions", "truth")
def agg_category_spread(spark, sf):
    """A generator without truth (src1) counts as one, but not in mean and deviation."""
    p = view(spark, sf, "predictions")
    return rounded(A.category_spread(A.judged(p, view(spark, sf, "truth").where("generator_model <> 'src1'")), p), "mean", "std")


@query("WITH v AS (SELECT CAST(rating_value AS VARCHAR) AS v, count(*) AS n FROM ratings GROUP BY 1) SELECT count(DISTINCT conversation_id) AS conversations, count(DISTINCT reviewer_name) AS reviewers, count(DISTINCT rating_category_name) AS categories, (SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM v) AS value_counts FROM ratings", "ratings")
def agg_value_counts(spark, sf):
    found = A.value_counts(view(spark, sf, "ratings"))
    return found.withColumn("value_counts", F.array_join(F.transform(F.map_entries("value_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("SELECT * FROM ratings ORDER BY conversation_id, reviewer_name", "ratings")
def top_sorted_ratings(spark, sf):
    return A.sorted_ratings(view(spark, sf, "ratings"))


@query("SELECT count(DISTINCT conversation_id) AS total_conversations, count(DISTINCT model) AS total_models FROM scores", "scores")
def agg_analysis_metadata(spark, sf):
    return R.metadata(view(spark, sf, "scores"))


RANKED = """means AS (SELECT language, model, metric, avg(score) AS mean, count(score) AS n FROM scores GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY language, metric ORDER BY round(mean, 12) DESC, model) AS rank FROM means)"""
_LANGS = ("de", "en", "es", "fr")
_GRID = ", ".join(f"coalesce(CAST(max(rank) FILTER (language = '{c}') AS VARCHAR), '—') AS {c}" for c in _LANGS)


@query(f"WITH {RANKED} SELECT metric, model, {_GRID} FROM ranked GROUP BY ALL", "scores")
def join_display_grid(spark, sf):
    return R.display_grid(R.ranks(view(spark, sf, "scores")), list(_LANGS))


@query(f"WITH {RANKED} SELECT model, rank, round(mean, 6) AS mean FROM ranked WHERE language = 'de' AND metric = 'quality'", "scores")
def fn_lookup_language(spark, sf):
    return longs(rounded(R.of_language(R.ranks(view(spark, sf, "scores")), "de", "quality"), "mean"), "rank").select("model", "rank", "mean")


_PAIR = f"""WITH {RANKED},
both_ AS (SELECT a.metric, a.language AS l1, b.language AS l2, a.model, a.rank AS r1, b.rank AS r2 FROM ranked a JOIN ranked b ON a.metric = b.metric AND a.model = b.model AND a.language < b.language),
flips AS (SELECT i.metric, i.l1, i.l2, count(*) AS pairs, count(*) FILTER ((i.r1 < j.r1) <> (i.r2 < j.r2)) AS inversions FROM both_ i JOIN both_ j ON i.metric = j.metric AND i.l1 = j.l1 AND i.l2 = j.l2 AND i.model < j.model GROUP BY ALL)"""


@query(f"{_PAIR} SELECT metric, l1, l2, pairs, inversions FROM flips WHERE metric = 'length' AND l1 = 'de' AND l2 = 'fr'", "scores")
def fn_lookup_pair(spark, sf):
    """One metric and two languages, given in the other order."""
    return R.of_pair(R.inversions(R.ranks(view(spark, sf, "scores"))), "length", "fr", "de").select("metric", "l1", "l2", "pairs", "inversions")


@query(f"{_PAIR} SELECT metric, l1, l2, pairs, inversions, round(1 - 2 * inversions / pairs, 6) AS tau, (SELECT count(DISTINCT conversation_id) FROM scores WHERE metric IN ('length', 'quality') AND language <> 'es') AS total_conversations, (SELECT count(DISTINCT model) FROM scores WHERE metric IN ('length', 'quality') AND language <> 'es') AS total_models FROM flips WHERE metric IN ('length', 'quality') AND l1 <> 'es' AND l2 <> 'es'", "scores")
def drv_ranking(spark, sf):
    """The analysis of two metrics and three languages, without resampling."""
    statistics, _, about = R.analyse(view(spark, sf, "scores"), ["length", "quality"], ["de", "en", "fr"], 0, 0)
    return rounded(statistics, "tau").select("metric", "l1", "l2", "pairs", "inversions", "tau", *(F.lit(about[c]).cast("long").alias(c) for c in ("total_conversations", "total_models")))


@query()
def drv_ranking_resampled(spark, sf):
    """The whole analysis with bootstrap intervals and permutation p at their defaults."""
    return R.analyse(view(spark, sf, "scores"))[0]


@query("SELECT language, model, metric, score, conversation_id FROM scores UNION ALL SELECT lang, source, 'extra', NULL, doc_id FROM documents", "scores")
def set_union_scores(spark, sf):
    """Score frames one under the other, one of which lacks a column."""
    extra = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("lang").alias("language"), F.col("source").alias("model"), F.lit("extra").alias("metric"), F.col("doc_id").alias("conversation_id"))
    return H.stacked(view(spark, sf, "scores"), extra).select("language", "model", "metric", "score", "conversation_id")


# -- metrics ------------------------------------------------------------------------------------------


def _turns(spark, sf):
    return conversations(spark, sf).select("language", F.col("model").alias("model_name"), "conversation_id", X.turns(F.col("messages")).alias("turns"))


_FILLERS = "CASE language " + " ".join(f"WHEN '{name}' THEN {list(p.fillers)}" for name, p in X.PROFILES.items()) + " END"
_METRICS = rf"""c AS (SELECT language, model AS model_name, conv_id AS conversation_id, count(*) AS n, chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) || '        ' AS whole FROM turns WHERE trim(text) <> '' GROUP BY ALL),
cl AS (SELECT language, model_name, conversation_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(whole, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\[.*?\]', '', 'g'), '\(.*?\)', '', 'g') AS t FROM c WHERE n >= 2),
tok AS (SELECT language, model_name, conversation_id, list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+'), lambda x: NOT list_contains({_FILLERS}, x)) AS t FROM cl),
w AS (SELECT language, model_name, conversation_id, t, len(t) AS n, least(100, len(t)) AS w FROM tok WHERE len(t) > 0), s AS (SELECT language, model_name, conversation_id, w, unnest(range(1, CAST(n - w + 2 AS BIGINT))) AS i, t FROM w),
m AS (SELECT language, model_name, conversation_id, sum(len(list_distinct(t[i : i + w - 1]))) / (max(w) * count(*)) AS mattr FROM s GROUP BY ALL),
metrics AS (SELECT language, model_name, conversation_id, CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_distinct(t)) / len(t) END AS ttr, coalesce(mattr, 0.0) AS mattr FROM tok LEFT JOIN m USING (language, model_name, conversation_id))"""


@query(f"WITH {_METRICS} SELECT language, model_name, conversation_id, round(ttr, 6) AS ttr, round(mattr, 6) AS mattr FROM metrics", "turns")
def drv_conversation_metrics(spark, sf):
    return rounded(C.metrics_of_languages(_turns(spark, sf), bleu=False), "ttr", "mattr")


@query()
def drv_conversation_metrics_bleu(spark, sf):
    return C.metrics_of_languages(_turns(spark, sf))


_ALIKE = """u AS (SELECT language, model_name, conversation_id FROM (SELECT *, row_number() OVER (PARTITION BY language, model_name, whole ORDER BY conversation_id) AS rn FROM c WHERE n >= 2) WHERE rn = 1),
v AS (SELECT u.*, CAST(embedding AS DOUBLE[]) AS e FROM u JOIN embeddings ON vec_id = conversation_id),
alike AS (SELECT a.model_name, avg(list_cosine_similarity(a.e, b.e)) AS avg_similarity, stddev_pop(list_cosine_similarity(a.e, b.e)) AS std_similarity, max(list_cosine_similarity(a.e, b.e)) AS max_similarity, quantile_cont(list_cosine_similarity(a.e, b.e), 0.5) AS median_similarity FROM v a JOIN v b ON a.language = b.language AND a.model_name = b.model_name AND a.conversation_id < b.conversation_id GROUP BY a.model_name)"""


def _alike(spark, sf):
    """The metrics with the similarity of each model's conversations, whose vectors are those of the same number."""
    turns = _turns(spark, sf)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("conversation_id"), "embedding")
    own = turns.select("model_name", "conversation_id").join(vectors, "conversation_id")
    return C.metrics_of_languages(turns, own, bleu=False)


@query(f"WITH {_METRICS}, {_ALIKE} SELECT model_name, count(*) AS conversations, round(avg(ttr), 6) AS ttr, round(avg(mattr), 6) AS mattr, round(coalesce(any_value(avg_similarity), 0.0), 6) AS avg_similarity, round(coalesce(any_value(std_similarity), 0.0), 6) AS std_similarity FROM metrics LEFT JOIN alike USING (model_name) GROUP BY model_name", "turns")
def agg_model_table(spark, sf):
    """Means by model, and columns of the whole model by its first row, 0 where absent."""
    return rounded(C.model_table(_alike(spark, sf)), "ttr", "mattr", "avg_similarity", "std_similarity")


@query(f"WITH {_METRICS}, {_ALIKE} SELECT language, model_name, conversation_id, round(ttr, 6) AS ttr, round(max_similarity, 6) AS max_similarity, round(median_similarity, 6) AS median_similarity FROM metrics LEFT JOIN alike USING (model_name)", "turns")
def drv_conversation_similarity(spark, sf):
    found = _alike(spark, sf)
    return rounded(found.select("language", "model_name", "conversation_id", "ttr", "max_similarity", "median_similarity"), "ttr", "max_similarity", "median_similarity")


@query(f"WITH {_METRICS} SELECT model_name, {', '.join(f'round({f}({c}), 6) AS {n}_{c}' for c in ('ttr', 'mattr') for n, f in (('mean', 'avg'), ('std', 'stddev_samp'), ('min', 'min'), ('max', 'max'), ('median', 'median')))} FROM metrics GROUP BY model_name", "turns")
def agg_diversity_statistics(spark, sf):
    """Statistics of columns found by their aliases."""
    m = C.metrics_of_languages(_turns(spark, sf), bleu=False).withColumnRenamed("ttr", "type_token_ratio").withColumnRenamed("mattr", "lexical_diversity_moving_avg_ttr")
    found = C.diversity_statistics(m)
    return rounded(found, *(c for c in found.columns if c != "model_name"))


@query("SELECT source AS model_name, arg_min(n_chars, doc_id) FILTER (doc_id % 4 <> 1) AS avg_similarity, arg_min(lang, doc_id) AS std_similarity FROM documents GROUP BY source")
def agg_first_by_model(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("model_name"), "doc_id", F.when(F.col("doc_id") % 4 != 1, F.col("n_chars")).alias("avg_similarity"), F.col("lang").alias("std_similarity"))
    return C.first_by_model(d, ["avg_similarity", "std_similarity"], "doc_id")


@query(r"""WITH t AS (SELECT language, model, conv_id, turn, role, text FROM turns WHERE trim(text) <> ''),
lev AS (SELECT language, model, CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'client' END AS level, conv_id || '-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS key, text FROM t WHERE language = 'et'),
et AS (SELECT language, model, level, key, text FROM lev WHERE level IS NOT NULL UNION ALL SELECT language, model, 'turns', key, text FROM lev),
oth AS (SELECT language, model, CASE role WHEN 'assistant' THEN 'agent' ELSE 'client' END AS level, CAST(conv_id AS VARCHAR) AS key, string_agg(text, ' ' ORDER BY turn) AS text FROM t WHERE language <> 'et' AND role IN ('user', 'assistant') GROUP BY ALL),
fu AS (SELECT language, model, 'full' AS level, CAST(conv_id AS VARCHAR) AS key, chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) || '        ' AS text FROM t GROUP BY ALL)
SELECT * FROM et UNION ALL SELECT * FROM oth UNION ALL SELECT * FROM fu""", "turns")
def prj_bleu_levels(spark, sf):
    """The texts of each Self-BLEU level by the languages' units."""
    out = None
    for language, profile in X.PROFILES.items():
        c = conversations(spark, sf).where(F.col("language") == language).select("language", "model", "conversation_id", X.turns(F.col("messages")).alias("turns"))
        levels = L.level_texts(c.where(F.size("turns") > 0), profile, ["language", "model"])
        out = levels if out is None else out.unionByName(levels)
    return out


@query(r"""WITH t AS (SELECT doc_id, lang, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\[.*?\]', '', 'g'), '\(.*?\)', '', 'g') AS c FROM documents),
w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2) AS et,
list_filter(regexp_extract_all(lower(c), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2 AND x NOT IN ('hmmm', 'mhm', 'aha', 'okei', 'ok', 'joo')) AS fi,
list_filter(regexp_extract_all(lower(c), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2 AND x NOT IN ('hmmm', 'mhm', 'aha', 'oké', 'ok') AND regexp_full_match(x, '\p{L}+')) AS hu FROM t)
SELECT doc_id, CAST(len(et) AS BIGINT) AS et, CAST(len(fi) AS BIGINT) AS fi, CAST(len(hu) AS BIGINT) AS hu, array_to_string(hu[1:5], ' ') AS head FROM w""")
def prj_bleu_tokens(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", *(L.bleu_tokens(F.col("text"), p).alias(c) for c, p in X.PROFILES.items()))
    return d.select("doc_id", *(F.size(c).cast("long").alias(c) for c in X.PROFILES), F.array_join(F.slice("hu", 1, 5), " ").alias("head"))


@query()
def stat_self_bleu_levels(spark, sf):
    """Self-BLEU statistics of every level, model and language, with the checks on the input."""
    out = None
    group = ["language", "model", "level"]
    every = stage(conversations(spark, sf).select("language", "model", "conversation_id", X.turns(F.col("messages")).alias("turns")).where(F.size("turns") > 0))
    for language, profile in X.PROFILES.items():
        own = L.with_bleu_tokens(L.level_texts(every.where(F.col("language") == language), profile, group[:2]), group, profile)
        out = own if out is None else out.unionByName(own)
    return L.checked_token_bleu(out, group)


@query("WITH j AS (SELECT DISTINCT judge_model FROM predictions), used AS (SELECT p.judge_model, unnest(['industry', 'problem', 'channel', 'agent_experience', 'agent_type']) AS category, unnest([t.industry, t.problem, t.channel, t.agent_experience, t.agent_type]) AS y_true, unnest([p.industry, p.problem, p.channel, p.agent_experience, p.agent_type]) AS y_pred FROM predictions p JOIN truth t ON p.generator_model = t.generator_model AND p.conversation_id = t.conversation_id WHERE p.judge_model <> 'judge2') SELECT judge_model, category, count(y_true) AS n, count(DISTINCT y_true) AS true_labels, count(DISTINCT y_pred) AS predicted_labels, round(coalesce(avg(CAST(y_true = y_pred AS INT)), 0.0), 6) AS accuracy FROM j CROSS JOIN (SELECT unnest(['industry', 'problem', 'channel', 'agent_experience', 'agent_type']) AS category) LEFT JOIN (SELECT * FROM used WHERE y_true IS NOT NULL AND y_pred IS NOT NULL) u USING (judge_model, category) GROUP BY ALL", "predictions", "truth")
def agg_label_summary(spark, sf):
    """Counts of labels by judge and category, zeros for a judge without usable rows (judge2)."""
    p = view(spark, sf, "predictions")
    pairs = S.paired(p.where("judge_model <> 'judge2'"), view(spark, sf, "truth"), ["generator_model", "conversation_id"], ["judge_model"])
    found = S.category_scores_of_all(pairs, p.select("judge_model").distinct(), ["judge_model"])
    return longs(rounded(found, "accuracy"), "n").select("judge_model", "category", "n", "true_labels", "predicted_labels", "accuracy")
