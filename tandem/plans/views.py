"""The library's tables over the test tables: one SQL text each, run by Spark here and by DuckDB as the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "turns": """SELECT concat('m', CAST(conv_id % 6 AS STRING)) AS model, conv_id, turn, role, text,
        CASE conv_id % 3 WHEN 0 THEN 'et' WHEN 1 THEN 'fi' ELSE 'hu' END AS language FROM conversations""",
    "scores": """SELECT d.lang AS language, d.source AS model, m.metric, d.doc_id AS conversation_id,
        CASE m.metric WHEN 'quality' THEN CAST(l.quality AS DOUBLE) WHEN 'toxic' THEN CAST(l.toxic AS DOUBLE) ELSE CAST(d.n_chars % 100 AS DOUBLE) END AS score
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN (SELECT 'quality' AS metric UNION ALL SELECT 'toxic' UNION ALL SELECT 'length') m""",
    "judgements": """SELECT l.doc_id AS conversation_id, d.source AS generator_model, 'j1' AS judge_model,
        CAST((l.doc_id + d.n_chars) % 5 AS INT) AS G, CAST(l.quality * 2 + d.n_chars % 3 AS INT) AS R, CAST(l.doc_id % 4 AS INT) AS C, CAST(l.toxic + d.n_chars % 3 AS INT) AS F
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "truth": """SELECT d.source AS generator_model, l.doc_id AS conversation_id, d.lang AS industry, concat('p', CAST(d.doc_id % 4 AS STRING)) AS problem,
        CASE WHEN l.quality = 1 THEN 'email' ELSE 'chat' END AS channel, CASE WHEN d.n_chars % 2 = 0 THEN 'junior' ELSE 'senior' END AS agent_experience,
        CASE WHEN l.toxic = 1 THEN 'bot' ELSE 'human' END AS agent_type FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "predictions": """SELECT d.source AS generator_model, l.doc_id AS conversation_id, concat('judge', CAST(j.j AS STRING)) AS judge_model,
        CASE WHEN (l.doc_id + j.j) % 17 = 0 THEN NULL WHEN (l.doc_id + j.j) % 5 = 0 THEN 'en' ELSE d.lang END AS industry,
        CASE WHEN (l.doc_id + j.j) % 17 = 0 THEN NULL ELSE concat('p', CAST((l.doc_id + CASE WHEN l.doc_id % 7 = j.j THEN 1 ELSE 0 END) % 4 AS STRING)) END AS problem,
        CASE WHEN (l.doc_id + j.j) % 17 = 0 THEN NULL WHEN l.doc_id % 11 = j.j THEN 'phone' WHEN l.quality = 1 THEN 'email' ELSE 'chat' END AS channel,
        CASE WHEN (l.doc_id + j.j) % 17 = 0 THEN NULL WHEN (d.n_chars + CASE WHEN l.doc_id % 9 = j.j THEN 1 ELSE 0 END) % 2 = 0 THEN 'junior' ELSE 'senior' END AS agent_experience,
        CASE WHEN (l.doc_id + j.j) % 17 = 0 THEN NULL WHEN l.toxic = 1 OR l.doc_id % 13 = j.j THEN 'bot' ELSE 'human' END AS agent_type,
        CASE WHEN (l.doc_id + j.j) % 17 = 0 THEN CASE WHEN l.doc_id % 2 = 0 THEN 'timeout' END END AS error, CAST(l.doc_id % 10 AS DOUBLE) / 4 AS processing_time
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) j""",
    "ratings": """SELECT concat('Annotator', CAST(a.a AS STRING)) AS reviewer_name, l.doc_id AS conversation_id, c.c AS rating_category_name,
        CAST((l.doc_id + l.quality + CASE WHEN (l.doc_id + a.a) % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN c.c = 'Is it fluent?' THEN d.n_chars % 2 ELSE 0 END) % 3 AS DOUBLE) AS rating_value,
        CASE WHEN a.a = 1 THEN 'calibration' ELSE 'main' END AS data_source
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id CROSS JOIN (SELECT 1 AS a UNION ALL SELECT 2 UNION ALL SELECT 4) a
        CROSS JOIN (SELECT 'Is it fluent?' AS c UNION ALL SELECT 'Does the content make sense?') c""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("conversations", "documents", "labels")}
    text = VIEWS[name]
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **{t: f for t, f in tables.items() if f"{{{t}}}" in text})


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views as common table expressions before it."""
    heads = ", ".join(f"{n} AS ({VIEWS[n].replace('STRING', 'VARCHAR')})" for n in names)
    start = next((w for w in ("WITH RECURSIVE ", "WITH ") if sql.startswith(w)), "")
    return f"{start or 'WITH '}{heads}{', ' + sql[len(start) :] if start else ' ' + sql}"
