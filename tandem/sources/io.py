"""Readers and writers of conversation, judge, label, ground-truth, metric and rating files."""

from __future__ import annotations

import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem import schemas as S
from tandem.functions import text as X


LOG = logging.getLogger(__name__)


def expand(spark: SparkSession, patterns: list[str], keep_unmatched: bool = False) -> list[str]:
    """Paths that the patterns match in whatever store Spark reads, once each and sorted; a pattern without match stays if asked for."""
    context, out = spark.sparkContext, set()
    for pattern in patterns:
        path = context._jvm.org.apache.hadoop.fs.Path(pattern)
        found = [str(s.getPath()) for s in path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path) or ()]
        if not found:
            LOG.warning("no file matches %s", pattern)
        out.update(found or ([pattern] if keep_unmatched else []))
    return sorted(out)


def combined_input(spark: SparkSession, folder: str) -> str | None:
    """The one ``combined_*.json`` of a folder, if there is exactly one."""
    found = expand(spark, [f"{folder}/combined_*.json"])
    return found[0] if len(found) == 1 else None


def conversation_files(spark: SparkSession, patterns: list[str], model: str | None = None, language: str | None = None) -> DataFrame:
    """path, model, language, datetime of the conversation files, of one model or language if asked."""
    paths = spark.createDataFrame([(p,) for p in expand(spark, patterns)], "path string")
    found = paths.withColumn("f", X.file_parts(F.regexp_replace(file_name(F.col("path")), r"\.jsonl$", ""))).select("path", "f.*")
    for column, value in (("model", model), ("language", language)):
        found = found.where(F.col(column) == value) if value else found
    return found.orderBy("path")


def planned(frame: DataFrame) -> dict[str, int | None]:
    """Bytes, and rows where they are known, that the optimised plan's statistics expect of a frame. No job is started."""
    stats = frame._jdf.queryExecution().optimizedPlan().stats()
    rows = stats.rowCount()
    return {"bytes": int(str(stats.sizeInBytes())), "rows": int(str(rows.get())) if rows.isDefined() else None}


def detect_languages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The languages of result files, by the source of their first rows or else by their names; unknown ones go."""
    rows = read_jsonl(spark, paths, S.JUDGE).withColumn("path", F.input_file_name())
    first = rows.groupBy("path").agg(F.min("source_file").alias("source_file"))
    return first.select(X.source_language(F.col("source_file"), F.col("path")).alias("language")).where("language <> 'unknown'").distinct()


def line_counts(conversations: DataFrame) -> DataFrame:
    """Valid rows by language of the file, and in total (language null)."""
    return conversations.rollup(F.col("file_language").alias("language")).agg(F.count("*").alias("n"))


def _json_lines(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """Lines that aren't blank: ``r``, with ``_corrupt`` where a line is broken, the file, and the place of its block in it."""
    lines = spark.read.option("ignoreMissingFiles", "true").text(paths).where(~X.blank(F.col("value")))
    row = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(row.alias("r"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))


def broken_lines(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """Broken lines by file, which the readers leave out."""
    return _json_lines(spark, paths, schema).where("r._corrupt is not null").groupBy(F.col("_path").alias("path")).agg(F.count("*").alias("broken"))


def _valid(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    return _json_lines(spark, paths, schema).where("r._corrupt is null").select("r.*", "_path", "_block").drop("_corrupt")


def _sourced(rows: DataFrame) -> DataFrame:
    source = F.coalesce("source_file", "_path") if "source_file" in rows.columns else F.col("_path")
    return rows.withColumn("source_file", source).drop("_path", "_block")


def read_jsonl(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank and broken lines go. Adds ``source_file`` where the row has none."""
    return _sourced(_valid(spark, paths, schema))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def numbered(rows: DataFrame, file: str, block: str) -> DataFrame:
    """The rows with ``index``, their place in their file (or model) from 0, where ``block`` tells the order of its splits.

    A row's place in its split is known to the task that reads it. The splits of all files are a small table of their sizes, whose sums
    before each split are added, so a file of any size is numbered by all tasks that read it, and nothing is sorted.
    """
    counted = rows.withColumn("_at", F.monotonically_increasing_id())
    splits = counted.groupBy(F.col(file).alias("_file"), F.col(block).alias("_split")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    of_file = splits.groupBy("_file").agg(F.sort_array(F.collect_list(F.struct("_split", "_n", "_first"))).alias("_splits"))
    before = F.transform("_splits", lambda s: F.struct(s["_split"].alias("_split"), s["_first"].alias("_first"), F.aggregate(F.filter("_splits", lambda o: o["_split"] < s["_split"]), F.lit(0).cast("long"), lambda sum_, o: sum_ + o["_n"]).alias("_before")))
    places = of_file.select("_file", F.explode(before).alias("_s")).select("_file", "_s.*")
    joined = counted.join(places, (F.col(file) == F.col("_file")) & (F.col(block) == F.col("_split")))
    return joined.withColumn("index", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_file", "_split", "_first", "_before")


def read_conversations(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Conversations with file_model, file_language, file_datetime and the id ``model_lang_datetime_0000``.

    The index counts the valid rows of a file in the order of its lines.
    """
    rows = numbered(_valid(spark, paths, S.CONVERSATION), "_path", "_block")
    rows = _sourced(rows)
    name = F.regexp_replace(file_name(F.col("source_file")), r"\.jsonl$", "")
    rows = rows.withColumn("file", X.file_parts(name))
    rows = rows.withColumn("conversation_id", X.conversation_name(F.col("file.model"), F.col("file.language"), F.col("file.datetime"), F.col("index")))
    return rows.select("conversation_id", *(F.col(f"file.{c}").alias(f"file_{c}") for c in ("model", "language", "datetime")), "subject", "messages", "model", F.col("_metadata").alias("metadata"), "source_file")


def read_grouped(spark: SparkSession, path: str) -> DataFrame:
    """(generator_model, conversation_id, conversation) of a file {model: [conversation, ...]}, which is one row while it is read.

    A folder that ``write_grouped`` has written is read by many tasks; its files and lines are in order.
    """
    if not path.endswith(".json"):
        lines = spark.read.schema(f"conversation_id long, conversation {S.GROUPED}, generator_model string").json(path)
        split = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
        placed = numbered(lines.select("generator_model", "conversation", split.alias("_block")), "generator_model", "_block")
        return placed.select("generator_model", F.col("index").alias("conversation_id"), "conversation")
    whole = spark.read.option("wholetext", "true").text(path)
    models = whole.select(F.explode(F.from_json("value", f"map<string, array<{S.GROUPED}>>")).alias("generator_model", "list"))
    return models.select("generator_model", F.posexplode("list").alias("conversation_id", "conversation"))


def read_judge_results(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return read_jsonl(spark, paths, S.JUDGE)


def read_label_results(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Label rows; absent models are ``unknown``, an unknown judge is read from the file's name."""
    rows = read_jsonl(spark, paths, S.LABEL)
    judge = F.when(F.coalesce("judge_model", F.lit("unknown")) != "unknown", F.col("judge_model"))
    return rows.select(*(c for c in rows.columns if c not in ("generator_model", "judge_model", "industry", "problem", "predicted_industry", "predicted_problem")), F.coalesce("generator_model", F.lit("unknown")).alias("generator_model"), F.coalesce(judge, X.judge_of_file(file_name(F.col("source_file"))), F.lit("unknown")).alias("judge_model"), F.coalesce("industry", "predicted_industry").alias("industry"), F.coalesce("problem", "predicted_problem").alias("problem"))


def judge_scores(results: DataFrame) -> DataFrame:
    """Long scores (language, model, metric, conversation_id, score); absent scores go."""
    language = X.source_language(F.coalesce("source_file", F.lit("")), F.coalesce("source_file", F.lit("")))
    wide = results.select(language.alias("language"), F.col("generator_model").alias("model"), "conversation_id", *(F.col(m).cast("double").alias(m) for m in S.METRICS))
    return wide.unpivot(["language", "model", "conversation_id"], list(S.METRICS), "metric", "score").where("score is not null")


def label_scores(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Label-recovery scores: 1 where industry and problem are both right; rows without truth go."""
    right = (F.col("r.industry") == F.col("t.industry")) & (F.col("r.problem") == F.col("t.problem"))
    joined = results.alias("r").join(truth.alias("t"), F.col("r.conversation_id").cast("string") == F.col("t.conversation_id").cast("string"))
    return joined.select(X.source_language(F.coalesce("r.source_file", F.lit("")), F.coalesce("r.source_file", F.lit(""))).alias("language"), F.col("r.generator_model").alias("model"), F.lit("LRA").alias("metric"), F.col("r.conversation_id").alias("conversation_id"), F.when(right, 1.0).otherwise(0.0).alias("score"))


def _items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """The items (i) of a JSON list, or of JSON lines, and their places (at), a row each."""
    rows = spark.read.schema(item).option("multiLine", str(path.endswith(".json"))).json(path)
    split = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    placed = numbered(rows.select(F.struct(*rows.columns).alias("i"), F.lit(path).alias("_path"), split.alias("_block")), "_path", "_block")
    return placed.select("i", F.col("index").alias("at"))


def read_ground_truth(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """(generator_model, conversation_id, five labels) of the four layouts.

    A: a list of {ticket_id, config}, keyed by ticket_id without ``id_``, else by place; of an id in several files
    the last file's row stays. B: {model: [labels]}. C: a list of {conversation_id, industry, problem}.
    D: {model: [conversation]} with labels in ``_metadata``. B and D may be folders of ``write_grouped``, A and C JSON
    lines in files or folders, which many tasks read.
    """
    labels = [F.coalesce(f"x.{c}", F.lit("")).alias(c) for c in S.CATEGORIES]
    if kind in ("B", "D"):
        rows = [read_grouped(spark, p) for p in paths]
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        own = F.col("conversation") if kind == "B" else F.col("conversation._metadata")
        return out.withColumn("x", own).select("generator_model", F.col("conversation_id").cast("string").alias("conversation_id"), *labels)
    config = "struct<industry: string, problem: string, channel: string, agent_experience: string, agent_type: string>"
    item = f"ticket_id string, conversation_id string, industry string, problem string, config {config}"
    parts = None
    for order, path in enumerate(paths):
        rows = _items(spark, path, item).withColumn("order", F.lit(order))
        parts = rows if parts is None else parts.unionByName(rows)
    if kind == "C":
        return parts.select(F.lit(None).cast("string").alias("generator_model"), F.col("i.conversation_id").alias("conversation_id"), "i.industry", "i.problem", *(F.lit(None).cast("string").alias(c) for c in S.CATEGORIES[2:]))
    ident = F.when(F.startswith("i.ticket_id", F.lit("id_")), F.substring("i.ticket_id", 4, 1 << 20)).otherwise(F.col("at").cast("string"))
    rows = parts.withColumn("x", F.col("i.config")).select(F.lit(None).cast("string").alias("generator_model"), ident.alias("conversation_id"), *labels, "order", "at")
    last = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("order"), F.desc("at")))
    return rows.withColumn("rn", last).where("rn = 1").drop("rn", "order", "at")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)


def read_stopwords(spark: SparkSession, built_in: tuple[str, ...], path: str | None) -> tuple[str, ...]:
    """The built-in words and those of a text file, one a line."""
    if not path:
        return built_in
    words = {r.value.strip().lower() for r in spark.read.text(path).collect()}
    return tuple(sorted({*built_in, *words} - {""}))


def read_languages(spark: SparkSession, base: str, languages: list[str] | None = None) -> DataFrame:
    """Flattened messages, of some languages only if asked (pruned by partition)."""
    rows = spark.read.parquet(base)
    return rows.where(F.col("language").isin(languages)) if languages else rows


def missing_languages(available: DataFrame, requested: DataFrame) -> DataFrame:
    return requested.select("language").exceptAll(available.select("language").distinct())


def write_grouped(conversations: DataFrame, path: str) -> None:
    """A folder a model with a line a conversation, in order of conversation_id; no model's conversations meet in one task."""
    own = F.struct(*(c for c in conversations.columns if c != "conversation_id"))
    rows = conversations.select(F.col("model").alias("generator_model"), "conversation_id", own.alias("conversation"))
    rows.repartitionByRange("generator_model", "conversation_id").sortWithinPartitions("generator_model", "conversation_id").write.mode("overwrite").partitionBy("generator_model").json(path)


def combined_json(conversations: DataFrame) -> DataFrame:
    """The text {model: [conversation, ...]} of few conversations, for programs that want one file."""
    own = F.struct("conversation_id", F.struct(*(c for c in conversations.columns if c != "conversation_id")).alias("c"))
    lists = conversations.groupBy("model").agg(F.transform(F.sort_array(F.collect_list(own)), lambda x: x.c).alias("list"))
    return lists.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "list"))))).alias("value"))


def loader_output(messages: DataFrame, dataset: str, subset: str) -> DataFrame:
    """Flattened messages as conversations by model, with metadata from the row or else from its file or subset."""
    own = lambda *names: F.coalesce(*(X.truthy(F.col(n)) for n in names if n in messages.columns))
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in messages.columns else F.lit("")
    metadata = F.struct(F.coalesce(own("language", "file_language"), F.lit(subset)).alias("language"), *(text(c).alias(c) for c in S.CATEGORIES))
    rows = messages.select(F.coalesce(own("model", "file_model"), F.lit("unknown")).alias("model"), "conversation_id", "message_id", F.struct(text("from_name").alias("from_name"), text("from_type").alias("from_type"), text("message").alias("message")).alias("m"), text("subject").alias("subject"), metadata.alias("metadata"))
    first = [F.min_by(c, "message_id").alias(c) for c in ("subject", "metadata")]
    found = rows.groupBy("model", "conversation_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("message_id", "m"))), lambda x: x.m).alias("messages"), *first)
    return found.withColumn("source_file", F.lit(f"hf://{dataset}/{subset}"))


def write_generated(conversations: DataFrame, path: str) -> None:
    """JSON lines; one conversation alone is an indented object."""
    few = conversations.select(F.to_json(F.struct(*conversations.columns)).alias("value")).limit(2).collect()
    if len(few) == 1:
        conversations.sparkSession.createDataFrame([(json.dumps(json.loads(few[0].value), indent=2, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        write_jsonl(conversations, path)


def write_analysis(statistics: DataFrame, ranking: DataFrame, metadata: dict[str, int], path: str) -> None:
    """One JSON object of an analysis; values that are null are left out. Its size is that of models, metrics and languages."""
    pairs = statistics.agg(F.collect_list(F.struct(*statistics.columns)).alias("pairwise_stats"))
    ranks = ranking.agg(F.collect_list(F.struct(*ranking.columns)).alias("ranking_results"))
    about = F.struct(*(F.lit(v).alias(k) for k, v in metadata.items()))
    pairs.crossJoin(ranks).select(F.to_json(F.struct("pairwise_stats", "ranking_results", about.alias("metadata"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_analysis(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the pairwise statistics of a saved analysis."""
    whole = spark.read.option("wholetext", "true").text(path)
    return whole.select(F.inline(F.from_json("value", f"pairwise_stats array<struct<{schema}>>")["pairwise_stats"]))


def read_ratings(spark: SparkSession, path: str, calibration: str) -> DataFrame:
    """Ratings of both files; the calibration file names its reviewer in another column, and ``data_source`` tells them apart."""
    main = read_csv(spark, path).withColumn("data_source", F.lit("main"))
    other = read_csv(spark, calibration).withColumnRenamed("calibration_reviewer_name", "reviewer_name").withColumn("data_source", F.lit("calibration"))
    return main.unionByName(other, allowMissingColumns=True).withColumnRenamed("conversation_external_id", "conversation_id")


def metrics_of(spark: SparkSession, folder: str, language: str) -> DataFrame:
    """The metric file of a language code, by the language's name."""
    return read_csv(spark, f"{folder}/{X.LANGUAGE_FILES[language]}_conversation_metrics.csv")


def model_conversations(spark: SparkSession, path: str, language: str, model: str | None = None) -> DataFrame:
    """(conversation_id, turns) of a grouped file, of one model if asked; of a file that isn't there, the built-in sample."""
    if not expand(spark, [path]):
        return spark.createDataFrame([(i, t) for i, t in enumerate(X.SAMPLES[language])], "conversation_id long, text string").select("conversation_id", X.parse_labelled(F.col("text"), X.SPEAKERS[language]).alias("turns"))
    rows = read_grouped(spark, path)
    rows = rows.where(F.col("generator_model") == model) if model else rows
    return rows.select(F.col("conversation_id").cast("long"), X.turns(F.col("conversation.messages")).alias("turns"))


def display(frame: DataFrame, digits: int = 3) -> DataFrame:
    """A table to show: numbers with fractions in ``digits`` decimals, absent values as a dash."""
    shown = [F.coalesce(F.format_number(c, digits) if t in ("double", "float") else F.col(c).cast("string"), F.lit("—")).alias(c) for c, t in frame.dtypes]
    return frame.select(*shown)


def combined_name(languages: DataFrame) -> DataFrame:
    one = F.count_distinct("language") == 1
    return languages.agg(F.concat(F.lit("combined_"), F.when(one, F.min("language")).otherwise("mixed")).alias("name"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_metrics(frames: dict[str, DataFrame] | DataFrame, path: str) -> None:
    """Metric rows of all models in one CSV with ``model_name``: one frame that has it, or frames by model; columns that a model lacks are empty."""
    out = frames if isinstance(frames, DataFrame) else None
    for model, frame in ({} if out is not None else frames).items():
        named = frame.withColumn("model_name", F.lit(model))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_languages(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("language").parquet(path)


def dataset_card(stats: DataFrame, title: str) -> str:
    """Markdown with one table row a language; ``stats`` is as small as the number of languages."""
    names = stats.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(str(row[c]) for c in names) + " |" for row in stats.orderBy(names[0]).collect())]) + "\n"


# What every card says, and the names that it has for languages.
CARD_TAGS = ("customer-support", "synthetic-data", "multilingual", "conversation", "cross-lingual", "finno-ugric")
CARD_LANGUAGES = {"et": "Estonian", "fi": "Finnish", "hu": "Hungarian", "en-us": "English (US)"}


def size_category(messages: int) -> str:
    """The name of a dataset's size."""
    return next((name for most, name in ((1000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M")) if messages < most), "n>1M")


def model_card(stats: DataFrame, model: str) -> str:
    """The card of a model's dataset from ``dataset_statistics``: header, summary, languages and statistics. It has a row a language, few."""
    rows = [r.asDict() for r in stats.orderBy("language").collect()]
    messages, talks = sum(r["n_messages"] for r in rows), sum(r["n_conversations"] for r in rows)
    name = lambda code: CARD_LANGUAGES.get(code, code.title())
    tag = model.replace("/", "-").replace("_", "-").replace(".", "-").lower()
    lines = ["---", "language:", *(f"- {r['language']}" for r in rows), "tags:", *(f"- {t}" for t in (*CARD_TAGS, tag)), "size_categories:", f"- {size_category(messages)}", "---", "", f"# Conversations by {model}", ""]
    lines += ["## Summary", "", f"- **Languages**: {', '.join(name(r['language']) for r in rows)}", f"- **Generator Model**: {model}", f"- **Total Messages**: {messages:,}", f"- **Total Conversations**: {talks:,}", "", "## Languages"]
    for r in rows:
        lines += ["", f"### {name(r['language'])} ({r['language']})", "", f"- **Messages**: {r['n_messages']:,}", f"- **Conversations**: {r['n_conversations']:,}", f"- **Avg. conversation length**: {r['mean_length']:.1f} messages", f"- **Conversation length range**: {r['min_length']}-{r['max_length']} messages"]
        lines += [f"- **Industries covered**: {r.get('n_industry', 'N/A')}", f"- **Problem types**: {r.get('n_problem', 'N/A')}"]
    average = f"{messages / talks:.1f}" if talks else "0.0"
    lines += ["", "## Statistics", "", "| Metric | Value |", "|---|---|", f"| **Total Languages** | {len(rows)} |", f"| **Total Messages** | {messages:,} |", f"| **Total Conversations** | {talks:,} |", f"| **Average Messages per Conversation** | {average} |"]
    lines += ["", "| Language | Messages | Conversations | Avg. Length |", "|---|---|---|---|", *(f"| {name(r['language'])} ({r['language']}) | {r['n_messages']:,} | {r['n_conversations']:,} | {r['mean_length']:.1f} |" for r in rows)]
    return "\n".join(lines) + "\n"
