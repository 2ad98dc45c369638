"""Queries that write files as the library's formats have them and read them with its readers."""

from __future__ import annotations

from pyspark.sql import functions as F


from tandem.operators.shape import dataset_statistics
from tandem.plans.base import conversations, folder, longs, put, query
from tandem.plans.views import view
from tandem.schemas import CATEGORIES, CONVERSATION
from tandem.sources import io

_STAMP = "20260127-14305"


def _conversation_files(spark, sf, at):
    """A file a model with a blank and a broken line before the conversations."""
    rows = conversations(spark, sf).withColumn("value", F.to_json(F.struct(F.concat(F.lit("s"), "conversation_id").alias("subject"), "messages", "model", F.struct("language").alias("_metadata"))))
    broken = spark.createDataFrame([(-2, ""), (-1, '{"subject": ')], "conversation_id long, value string")
    for i in range(6):
        own = rows.where(F.col("model") == f"m{i}").select("conversation_id", "value")
        put(own.unionByName(broken), f"{at}/convo_m{i}_{('et', 'fi', 'hu')[i % 3]}_{_STAMP}{i}.jsonl", "conversation_id")
    return at


_C = "c AS (SELECT model, language, conv_id, count(*) AS n, arg_min(text, turn) AS first_text FROM turns GROUP BY ALL)"


@query(f"WITH {_C} SELECT format('{{}}_{{}}_{_STAMP}{{}}_{{:04d}}', model, language, substr(model, 2), row_number() OVER (PARTITION BY model ORDER BY conv_id) - 1) AS conversation_id, model AS file_model, language AS file_language, '{_STAMP}' || substr(model, 2) AS file_datetime, 's' || conv_id AS subject, language AS meta_language, n AS n_messages, first_text FROM c", "turns")
def src_conversations(spark, sf):
    at = _conversation_files(spark, sf, folder(spark))
    rows = io.read_conversations(spark, io.expand(spark, [f"{at}/convo_*.jsonl", f"{at}/convo_m1_*.jsonl"]))
    return rows.select("conversation_id", "file_model", "file_language", "file_datetime", "subject", F.col("metadata.language").alias("meta_language"), F.size("messages").cast("long").alias("n_messages"), F.element_at("messages", 1).message.alias("first_text"))


@query("SELECT language, count(DISTINCT conv_id) AS n FROM turns GROUP BY ROLLUP (language)", "turns")
def src_line_counts(spark, sf):
    at = _conversation_files(spark, sf, folder(spark))
    return io.line_counts(io.read_conversations(spark, io.expand(spark, [f"{at}/*.jsonl"])))


@query(f"SELECT DISTINCT 'convo_' || model || '_' || language || '_{_STAMP}' || substr(model, 2) || '.jsonl' AS name, CAST(1 AS BIGINT) AS broken FROM turns", "turns")
def src_broken_lines(spark, sf):
    """Broken lines by file; blank ones don't count."""
    at = _conversation_files(spark, sf, folder(spark))
    found = io.broken_lines(spark, io.expand(spark, [f"{at}/*.jsonl"]), CONVERSATION)
    return longs(found.select(io.file_name(F.col("path")).alias("name"), "broken"), "broken")


@query(f"SELECT model, language, '{_STAMP}' || substr(model, 2) AS datetime, 'convo_' || model || '_' || language || '_{_STAMP}' || substr(model, 2) || '.jsonl' AS name, count(DISTINCT conv_id) AS n FROM turns WHERE language = 'fi' GROUP BY ALL", "turns")
def src_find_files(spark, sf):
    """The files of one language among those of all conversations, and what is in them."""
    at = _conversation_files(spark, sf, folder(spark))
    found = io.conversation_files(spark, [f"{at}/*.jsonl", f"{at}/absent_*"], language="fi")
    held = io.read_conversations(spark, [r.path for r in found.select("path").collect()]).groupBy(F.col("file_model").alias("model")).agg(F.count("*").alias("n"))
    return found.select("model", "language", "datetime", io.file_name(F.col("path")).alias("name")).join(held, "model")


@query("SELECT 'combined_et.json' AS one, 'none' AS several, 'fi,hu' AS languages, 'combined_et.json|absent.json' AS kept, count(*) AS n FROM judgements", "judgements")
def src_detect(spark, sf):
    """The one input of a folder, none of two; the languages of result files, by their rows or their names; a pattern kept without match."""
    a, b = folder(spark), folder(spark)
    for path in (f"{a}/combined_et.json", f"{b}/combined_et.json", f"{b}/combined_fi.json"):
        put(io.combined_json(_subjects(spark, sf)), path)
    results = view(spark, sf, "judgements")
    for odd, name, source in ((0, "judge_m_x", "data/combined_hu.json"), (1, "judge_m_fi_2026", "plain")):
        io.write_jsonl(results.where(F.col("conversation_id") % 2 == odd).withColumn("source_file", F.lit(source)), f"{a}/{name}.jsonl")
    one, several = io.combined_input(spark, a), io.combined_input(spark, b)
    paths = io.expand(spark, [f"{a}/judge_*.jsonl"])
    languages = ",".join(r.language for r in io.detect_languages(spark, paths).orderBy("language").collect())
    kept = "|".join(sorted((p.split("/")[-1] for p in io.expand(spark, [f"{a}/combined_*.json", "absent.json"], keep_unmatched=True)), reverse=True))
    return io.read_judge_results(spark, paths).agg(F.lit(one.split("/")[-1]).alias("one"), F.lit(several or "none").alias("several"), F.lit(languages).alias("languages"), F.lit(kept).alias("kept"), F.count("*").alias("n"))


_G = "g AS (SELECT model AS generator_model, row_number() OVER (PARTITION BY model ORDER BY conv_id) - 1 AS conversation_id, conv_id, n FROM c)"


def _subjects(spark, sf):
    return conversations(spark, sf).select("model", "conversation_id", F.concat(F.lit("s"), "conversation_id").alias("subject"), "messages")


@query(f"WITH {_C}, {_G} SELECT generator_model, conversation_id, 's' || conv_id AS subject, n AS n_messages FROM g", "turns")
def snk_grouped(spark, sf):
    """Conversations by model, written by all tasks and read back."""
    at = f"{folder(spark)}/combined"
    io.write_grouped(_subjects(spark, sf), at)
    return longs(io.read_grouped(spark, at), "conversation_id").select("generator_model", "conversation_id", "conversation.subject", F.size("conversation.messages").cast("long").alias("n_messages"))


@query(f"WITH {_C}, {_G} SELECT generator_model, conversation_id, 's' || conv_id AS subject, n AS n_messages FROM g", "turns")
def src_grouped(spark, sf):
    """The same as one JSON object in a file of its own."""
    path = put(io.combined_json(_subjects(spark, sf)), f"{folder(spark)}/combined_et.json")
    return longs(io.read_grouped(spark, path), "conversation_id").select("generator_model", "conversation_id", "conversation.subject", F.size("conversation.messages").cast("long").alias("n_messages"))


@query(f"WITH {_C}, {_G} SELECT conversation_id, n AS n_turns, 'file' AS origin FROM g WHERE generator_model = 'm3' UNION ALL SELECT * FROM (VALUES (0, 2, 'sample'), (1, 2, 'sample'), (2, 2, 'sample')) s", "turns")
def src_model_conversations(spark, sf):
    """The conversations of one model, none of a model that isn't there, and the sample where there is no file."""
    path = f"{folder(spark)}/combined_fi"
    io.write_grouped(_subjects(spark, sf), path)
    own = io.model_conversations(spark, path, "fi", "m3").withColumn("origin", F.lit("file"))
    own = own.unionByName(io.model_conversations(spark, path, "fi", "nobody").withColumn("origin", F.lit("absent")))
    sample = io.model_conversations(spark, path + ".absent", "fi").withColumn("origin", F.lit("sample"))
    count = lambda d: d.select("conversation_id", F.size("turns").cast("long").alias("n_turns"), "origin")
    return count(own).unionByName(count(sample))


_J = "j AS (SELECT conversation_id, generator_model, judge_model, G, R, C, CASE WHEN conversation_id % 5 <> 0 THEN F END AS F, CASE conversation_id % 3 WHEN 0 THEN 'data/combined_et.json' WHEN 1 THEN 'judge_x_fi_2026.jsonl' ELSE 'plain' END AS source_file FROM judgements)"


@query(f"WITH {_J}, l AS (SELECT CASE conversation_id % 3 WHEN 0 THEN 'et' WHEN 1 THEN 'fi' ELSE 'unknown' END AS language, generator_model AS model, conversation_id, unnest(['G', 'R', 'C', 'F']) AS metric, unnest([G, R, C, F]) AS score FROM j) SELECT language, model, CAST(conversation_id AS INT) AS conversation_id, metric, CAST(score AS DOUBLE) AS score FROM l WHERE score IS NOT NULL", "judgements")
def src_judge_scores(spark, sf):
    at = f"{folder(spark)}/judge.jsonl"
    k = F.col("conversation_id")
    io.write_jsonl(view(spark, sf, "judgements").withColumn("F", F.when(k % 5 != 0, F.col("F"))).withColumn("source_file", F.when(k % 3 == 0, "data/combined_et.json").when(k % 3 == 1, "judge_x_fi_2026.jsonl").otherwise("plain")), at)
    return io.judge_scores(io.read_judge_results(spark, at))


@query("SELECT 'unknown' AS language, p.generator_model AS model, 'LRA' AS metric, CAST(p.conversation_id AS INT) AS conversation_id, CASE WHEN p.industry = t.industry AND p.problem = t.problem THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM predictions p JOIN truth t ON p.conversation_id = t.conversation_id WHERE p.conversation_id % 3 <> 0", "predictions", "truth")
def src_label_scores(spark, sf):
    at = folder(spark)
    p = view(spark, sf, "predictions").withColumnRenamed("industry", "predicted_industry").withColumn("source_file", F.lit("plain"))
    io.write_jsonl(p, f"{at}/labels.jsonl")
    io.write_jsonl(view(spark, sf, "truth").where("conversation_id % 3 <> 0").select("conversation_id", "industry", "problem"), f"{at}/truth.jsonl")
    truth = io.read_ground_truth(spark, [f"{at}/truth.jsonl"], "C")
    return io.label_scores(io.read_label_results(spark, f"{at}/labels.jsonl"), truth)


@query("SELECT CAST(conversation_id AS INT) AS conversation_id, CASE conversation_id % 2 WHEN 0 THEN generator_model ELSE 'unknown' END AS generator_model, CASE conversation_id % 3 WHEN 0 THEN judge_model ELSE 'gpt-5' END AS judge_model, industry FROM predictions", "predictions")
def src_label_results(spark, sf):
    """Absent models are unknown; a judge that is absent or unknown is named by the file."""
    k = F.col("conversation_id")
    p = view(spark, sf, "predictions")
    p = p.withColumn("generator_model", F.when(k % 2 == 0, F.col("generator_model"))).withColumn("judge_model", F.when(k % 3 == 0, F.col("judge_model")).when(k % 3 == 1, "unknown"))
    path = put(p.select(F.to_json(F.struct(*p.columns)).alias("value")), f"{folder(spark)}/label_recovery_gpt-5_et_20260127-143052.jsonl")
    return io.read_label_results(spark, path).select("conversation_id", "generator_model", "judge_model", "industry")


_LABELS = ", ".join(f"coalesce({c}, '') AS {c}" for c in CATEGORIES)


@query(f"WITH f AS (SELECT conversation_id, {', '.join(CATEGORIES)}, 1 AS o FROM truth WHERE conversation_id % 2 = 0 UNION ALL SELECT conversation_id, 'changed', {', '.join(CATEGORIES[1:])}, 2 FROM truth WHERE conversation_id % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY o DESC) AS rn FROM f) SELECT 'A' AS kind, NULL::VARCHAR AS generator_model, CAST(conversation_id AS VARCHAR) AS conversation_id, {_LABELS} FROM r WHERE rn = 1", "truth")
def src_ground_truth_tickets(spark, sf):
    """Two files with ids in common: the last file's row stays."""
    at, paths = folder(spark), []
    for i, own in enumerate((view(spark, sf, "truth").where("conversation_id % 2 = 0"), view(spark, sf, "truth").where("conversation_id % 3 = 0").withColumn("industry", F.lit("changed")))):
        paths.append(f"{at}/truth_{i}.jsonl")
        io.write_jsonl(own.select(F.concat(F.lit("id_"), "conversation_id").alias("ticket_id"), F.struct(*CATEGORIES).alias("config")), paths[-1])
    return io.read_ground_truth(spark, paths, "A").select(F.lit("A").alias("kind"), "generator_model", "conversation_id", *CATEGORIES)


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY generator_model ORDER BY conversation_id) - 1 AS place FROM truth) SELECT kind, generator_model, CAST(place AS VARCHAR) AS conversation_id, {_LABELS} FROM r CROSS JOIN (SELECT unnest(['B', 'D']) AS kind)", "truth")
def src_ground_truth_models(spark, sf):
    """Labels by model and place, and the same in the metadata of conversations."""
    at, out = folder(spark), None
    for kind in ("B", "D"):
        t = view(spark, sf, "truth").withColumnRenamed("generator_model", "model")
        rows = t.select("model", "conversation_id", *CATEGORIES) if kind == "B" else t.select("model", "conversation_id", F.struct(*CATEGORIES).alias("_metadata"))
        io.write_grouped(rows, f"{at}/{kind}")
        found = io.read_ground_truth(spark, [f"{at}/{kind}"], kind).withColumn("kind", F.lit(kind))
        out = found if out is None else out.unionByName(found)
    return out.select("kind", "generator_model", "conversation_id", *CATEGORIES)


@query("SELECT 'a, \"b\"' AS model_name, doc_id AS conversation_id, round(n_chars / 7.0, 3) AS ttr, NULL::DOUBLE AS mattr FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'c', doc_id, NULL, round(n_chars / 3.0, 3) FROM documents WHERE doc_id % 2 = 1")
def snk_metrics(spark, sf):
    """Metric rows of two models in one CSV file, each without a column of the other's, read by the language's code."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    at = folder(spark)
    own = lambda odd, column, by: d.where(F.col("doc_id") % 2 == odd).select(F.col("doc_id").alias("conversation_id"), F.round(F.col("n_chars") / by, 3).alias(column))
    io.write_metrics({'a, "b"': own(0, "ttr", 7.0), "c": own(1, "mattr", 3.0)}, f"{at}/finnish_conversation_metrics.csv")
    rows = longs(io.metrics_of(spark, at, "fi"), "conversation_id")
    return rows.select("model_name", "conversation_id", F.col("ttr").cast("double").alias("ttr"), F.col("mattr").cast("double").alias("mattr"))


@query("SELECT reviewer_name, conversation_id, rating_category_name, rating_value, data_source FROM ratings", "ratings")
def src_ratings(spark, sf):
    at, r = folder(spark), view(spark, sf, "ratings").withColumnRenamed("conversation_id", "conversation_external_id")
    main = r.where("data_source = 'main'").drop("data_source")
    other = r.where("data_source = 'calibration'").drop("data_source").withColumnRenamed("reviewer_name", "calibration_reviewer_name")
    for name, rows in (("main", main), ("calibration", other)):
        rows.write.option("header", "true").csv(f"{at}/{name}.csv")
    rows = io.read_ratings(spark, f"{at}/main.csv", f"{at}/calibration.csv")
    return rows.select("reviewer_name", F.col("conversation_id").cast("long").alias("conversation_id"), "rating_category_name", F.col("rating_value").cast("double").alias("rating_value"), "data_source")


@query("SELECT 'row' AS kind, lang AS language, doc_id FROM documents WHERE lang IN ('de', 'fr') UNION ALL SELECT 'missing', 'xx', NULL")
def snk_languages(spark, sf):
    """Rows by language, some languages read again, and those asked for that aren't there."""
    at = f"{folder(spark)}/base"
    io.write_languages(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("language")), at)
    rows = io.read_languages(spark, at, ["de", "fr", "xx"]).select(F.lit("row").alias("kind"), "language", "doc_id")
    asked = spark.createDataFrame([("de",), ("xx",)], "language string")
    missing = io.missing_languages(io.read_languages(spark, at), asked)
    return rows.unionByName(missing.select(F.lit("missing").alias("kind"), "language", F.lit(None).cast("long").alias("doc_id")))


@query("WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT '# Data' || chr(10) || chr(10) || '| lang | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' |', chr(10) ORDER BY lang) || chr(10) AS card FROM s")
def snk_card(spark, sf):
    stats = spark.read.parquet(f"{sf}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(io.dataset_card(stats, "Data"),)], "card string")


@query(r"""WITH e AS (SELECT language, conv_id, count(*) AS n FROM turns GROUP BY ALL), l AS (SELECT language, count(DISTINCT role) AS kinds FROM turns GROUP BY 1),
s AS (SELECT language, CASE language WHEN 'et' THEN 'Estonian' WHEN 'fi' THEN 'Finnish' ELSE 'Hungarian' END AS name, CAST(sum(n) AS BIGINT) AS m, count(*) AS c, avg(n) AS a, min(n) AS lo, max(n) AS hi, any_value(kinds) AS k FROM e JOIN l USING (language) GROUP BY language),
t AS (SELECT CAST(sum(m) AS BIGINT) AS m, CAST(sum(c) AS BIGINT) AS c, count(*) AS n FROM s)
SELECT '---' || chr(10) || 'language:' || chr(10) || (SELECT string_agg('- ' || language, chr(10) ORDER BY language) FROM s) || chr(10) || 'tags:' || chr(10) || '- customer-support' || chr(10) || '- synthetic-data' || chr(10) || '- multilingual' || chr(10) || '- conversation' || chr(10) || '- cross-lingual' || chr(10) || '- finno-ugric' || chr(10) || '- org-my-model-4-1' || chr(10)
|| 'size_categories:' || chr(10) || '- ' || CASE WHEN m < 1000 THEN 'n<1K' WHEN m < 10000 THEN '1K<n<10K' WHEN m < 100000 THEN '10K<n<100K' ELSE '100K<n<1M' END || chr(10) || '---' || chr(10) || chr(10) || '# Conversations by org/My_model-4.1' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10)
|| '- **Languages**: ' || (SELECT string_agg(name, ', ' ORDER BY language) FROM s) || chr(10) || '- **Generator Model**: org/My_model-4.1' || chr(10) || format('- **Total Messages**: {:,}', m) || chr(10) || format('- **Total Conversations**: {:,}', c) || chr(10) || chr(10) || '## Languages' || chr(10)
|| (SELECT string_agg(chr(10) || '### ' || name || ' (' || language || ')' || chr(10) || chr(10) || format('- **Messages**: {:,}', m) || chr(10) || format('- **Conversations**: {:,}', c) || chr(10) || format('- **Avg. conversation length**: {:.1f} messages', a) || chr(10) || '- **Conversation length range**: ' || lo || '-' || hi || ' messages' || chr(10) || '- **Industries covered**: ' || k || chr(10) || '- **Problem types**: N/A', chr(10) ORDER BY language) FROM s)
|| chr(10) || chr(10) || '## Statistics' || chr(10) || chr(10) || '| Metric | Value |' || chr(10) || '|---|---|' || chr(10) || '| **Total Languages** | ' || n || ' |' || chr(10) || format('| **Total Messages** | {:,} |', m) || chr(10) || format('| **Total Conversations** | {:,} |', c) || chr(10) || format('| **Average Messages per Conversation** | {:.1f} |', m / c) || chr(10) || chr(10)
|| '| Language | Messages | Conversations | Avg. Length |' || chr(10) || '|---|---|---|---|' || chr(10) || (SELECT string_agg('| ' || name || ' (' || language || format(') | {:,} | {:,} | {:.1f} |', m, c, a), chr(10) ORDER BY language) FROM s) || chr(10) AS card FROM t""", "turns")
def snk_model_card(spark, sf):
    """The card of a model's dataset; industries are the roles here, problems aren't there."""
    messages = view(spark, sf, "turns").withColumnRenamed("conv_id", "conversation_id").withColumn("industry", F.col("role"))
    return spark.createDataFrame([(io.model_card(dataset_statistics(messages), "org/My_model-4.1"),)], "card string")


@query("SELECT CASE count(DISTINCT language) WHEN 1 THEN 'combined_' || min(language) ELSE 'combined_mixed' END AS name, which FROM (SELECT language, 'all' AS which FROM turns UNION ALL SELECT language, 'one' FROM turns WHERE language = 'fi') GROUP BY which", "turns")
def snk_combined_name(spark, sf):
    t = view(spark, sf, "turns")
    return io.combined_name(t).withColumn("which", F.lit("all")).unionByName(io.combined_name(t.where("language = 'fi'")).withColumn("which", F.lit("one")))


@query("WITH m AS (SELECT language, model, metric, avg(score) AS mean FROM scores GROUP BY ALL) SELECT metric, language, model, CASE WHEN model <> 'src1' THEN round(mean, 6) END AS mean FROM m", "scores")
def snk_analysis(spark, sf):
    """An analysis as one JSON object, in which null values are left out, and its statistics read again."""
    stats = view(spark, sf, "scores").groupBy("metric", "language", "model").agg(F.round(F.avg("score"), 6).alias("mean"))
    stats = stats.withColumn("mean", F.when(F.col("model") != "src1", F.col("mean")))
    path = f"{folder(spark)}/analysis.json"
    io.write_analysis(stats, stats.limit(0), {"n_bootstrap": 0}, path)
    assert '"mean":null' not in spark.read.text(path).first().value
    return io.read_analysis(spark, path, "metric: string, language: string, model: string, mean: double")


@query("SELECT CASE WHEN conv_id % 2 = 0 THEN model ELSE 'file-model' END AS model, conv_id AS conversation_id, count(*) AS n_messages, string_agg(text, chr(10) ORDER BY turn) AS texts, CASE WHEN conv_id % 4 = 0 THEN arg_min(language, turn) ELSE 'hub' END AS language, '' AS industry, 'hf://data/hub' AS source_file FROM turns GROUP BY conv_id, model", "turns")
def snk_loader_output(spark, sf):
    """Messages of a dataset as conversations: model and language of the row, else of the file, else of the subset."""
    k = F.col("conv_id")
    m = view(spark, sf, "turns").select(F.when(k % 2 == 0, F.col("model")).otherwise("").alias("model"), F.lit("file-model").alias("file_model"), k.alias("conversation_id"), F.col("turn").alias("message_id"), F.col("text").alias("message"), F.when(k % 4 == 0, F.col("language")).when(k % 4 == 1, "").alias("language"))
    found = io.loader_output(m, "data", "hub")
    return found.select("model", "conversation_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda x: x["message"]), "\n").alias("texts"), "metadata.language", "metadata.industry", "source_file")


@query("SELECT doc_id, coalesce(source, '—') AS source, CASE WHEN doc_id % 2 = 0 THEN printf('%,.2f', n_chars / 3.0) ELSE '—' END AS size FROM documents")
def snk_display(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") / 3.0).alias("size"))
    return longs(io.display(d, 2), "doc_id")


@query("SELECT 'one' AS kind, CAST(5 AS BIGINT) AS n UNION ALL SELECT 'many', count(DISTINCT conv_id) FROM conversations")
def snk_generated(spark, sf):
    """One generated conversation is an indented object, several are JSON lines."""
    at = folder(spark)
    c = conversations(spark, sf).select("conversation_id", F.lit("x").alias("subject"), F.lit(None).cast("string").alias("note")).orderBy("conversation_id")
    io.write_generated(c.limit(1).withColumn("note", F.lit("é")), f"{at}/one")
    io.write_generated(c, f"{at}/many")
    lines = lambda name: spark.read.text(f"{at}/{name}").agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return lines("one").unionByName(lines("many"))


