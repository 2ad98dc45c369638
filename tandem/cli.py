"""The analyses from the command line: ``python -m tandem.cli rank --judge 'out/judge_*.jsonl' --output analysis.json``."""

from __future__ import annotations

import argparse
import logging
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tandem.functions import text as X
from tandem.operators import agreement as A
from tandem.operators import metrics as C
from tandem.operators import ranking as R
from tandem.operators import scoring
from tandem.sources import io


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tandem", description=__doc__)
    out.add_argument("--quiet", action="store_true")
    out.add_argument("--verbose", action="store_true")
    out.add_argument("--dry-run", action="store_true", help="show the inputs and what the plan expects of them, start no job")
    sub = out.add_subparsers(dest="command", required=True)

    def add(name: str, text: str) -> argparse.ArgumentParser:
        own = sub.add_parser(name, help=text)
        own.add_argument("input", nargs="+")
        own.add_argument("--output")
        return own

    add("combine", "conversation files to one folder by model")
    rank = add("rank", "judge results to ranks, inversions, intervals")
    rank.add_argument("--metrics", default="G,R,C,F")
    rank.add_argument("--languages")
    rank.add_argument("--bootstrap", type=int, default=2000)
    rank.add_argument("--permutations", type=int, default=5000)
    rank.add_argument("--seed", type=int, default=42)
    metrics = add("metrics", "grouped conversations to TTR, MATTR and Self-BLEU")
    metrics.add_argument("--language", choices=sorted(X.PROFILES), required=True)
    metrics.add_argument("--limit", type=int)
    metrics.add_argument("--window", type=int, default=100)
    add("judge", "judge results to statistics by model and metric")
    recovered = add("evaluate", "label results against the truth: accuracy and F1 by judge, generator and category")
    recovered.add_argument("--truth", nargs="+", required=True)
    judges = add("agreement", "label results of several judges against each other")
    judges.add_argument("--truth", nargs="*", default=[])
    return out


def preview(spark: SparkSession, options: argparse.Namespace) -> list[Row]:
    """For a dry run: the input files by model and language, and what the command's plan expects to read and return. No job is started."""
    paths = io.expand(spark, options.input)
    named = [re.match(X.FILE_PARTS, path.rsplit("/", 1)[-1]) for path in paths]
    files = Counter(m.groups()[:2] if m else ("unknown", "unknown") for m in named)
    rows = [Row(part="files", model=model, language=language, rows=count, bytes=None) for (model, language), count in sorted(files.items())]
    for what, frame in (("input", source(spark, options, paths)), ("result", result(spark, options, paths)[0])) if paths else ():
        rows.append(Row(part=what, model=None, language=None, **io.planned(frame)))
    return rows


def source(spark: SparkSession, options: argparse.Namespace, paths: list[str]) -> DataFrame:
    """What a command reads."""
    if options.command == "combine":
        return io.read_conversations(spark, paths).withColumn("model", F.coalesce(X.truthy(F.col("model")), F.lit("unknown")))
    if options.command in ("rank", "judge"):
        return io.read_judge_results(spark, paths)
    if options.command == "metrics":
        rows = None
        for path in paths:
            own = io.read_grouped(spark, path).select(F.col("generator_model").alias("model_name"), "conversation_id", X.turns(F.col("conversation.messages")).alias("turns"))
            rows = own if rows is None else rows.unionByName(own)
        return rows
    return io.read_label_results(spark, paths)


def result(spark: SparkSession, options: argparse.Namespace, paths: list[str]) -> tuple[DataFrame, Callable[[], None]]:
    """The table that a command shows, and what writes its output."""
    rows = source(spark, options, paths)
    nothing = lambda: None
    if options.command == "combine":
        folder = lambda: f"{options.output}/{io.combined_name(rows.withColumnRenamed('file_language', 'language')).first().name}"
        return io.line_counts(rows), lambda: io.write_grouped(rows.drop("source_file"), folder())
    if options.command == "rank":
        languages = options.languages.split(",") if options.languages else None
        if options.dry_run:  # resampling and metadata are jobs
            return R.inversions(R.ranks(io.judge_scores(rows))), nothing
        statistics, ranked, about = R.analyse(io.judge_scores(rows), options.metrics.split(","), languages, options.bootstrap, options.permutations, options.seed)
        return statistics, lambda: io.write_analysis(statistics, ranked, about, options.output)
    if options.command == "metrics":
        if options.dry_run:
            return rows.groupBy("model_name").count(), nothing
        found = C.conversation_metrics(rows, options.language, limit=options.limit, window=options.window)
        return C.model_table(found), lambda: io.write_metrics(found, options.output)
    if options.command == "judge":
        long = io.judge_scores(rows)
        table = scoring.score_statistics(long, ["model", "metric"])
        return table, lambda: long.write.mode("overwrite").json(options.output)
    if options.command == "evaluate":
        truth = io.read_ground_truth(spark, options.truth, "A")
        pairs = scoring.paired(rows.withColumn("conversation_id", F.col("conversation_id").cast("string")), truth, ["conversation_id"], ["judge_model", "generator_model"])
        table = scoring.category_scores(pairs, ["judge_model", "generator_model", "category"])
        return table, lambda: table.write.mode("overwrite").json(options.output)
    if options.truth:
        judged = A.judged(rows.withColumn("conversation_id", F.col("conversation_id").cast("string")), io.read_ground_truth(spark, options.truth, "B"))
        return A.judge_consistency(rows, judged), nothing
    many = not options.dry_run and rows.select("judge_model").distinct().limit(2).count() > 1
    # of a judge's repeated rows the last counts
    ordered = rows.withColumn("_row", F.monotonically_increasing_id())
    return (A.pairwise_agreement(ordered, "_row") if many else scoring.success_statistics(rows, ["judge_model"])), nothing


def run(spark: SparkSession, options: argparse.Namespace):
    """The table to show; results are written where an output is named."""
    if options.dry_run:
        return preview(spark, options)
    paths = io.expand(spark, options.input)
    if not paths:
        raise ValueError("no input file")
    table, write = result(spark, options, paths)
    if options.output:
        write()
    return table


def main(arguments: list[str] | None = None) -> None:
    options = parser().parse_args(arguments)
    if options.quiet and options.verbose:
        parser().error("--quiet and --verbose exclude each other")
    logging.basicConfig(level=logging.ERROR if options.quiet else logging.DEBUG if options.verbose else logging.INFO)
    spark = SparkSession.builder.appName("tandem").getOrCreate()
    table = run(spark, options)
    if options.dry_run:
        print("\n".join(map(str, table)))
    elif not options.quiet:
        io.display(table).show(100, truncate=False)


if __name__ == "__main__":
    main()
