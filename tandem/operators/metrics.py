"""Metrics by conversation and model: the batch, its table, and statistics of metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import text as X
from tandem.operators import lexical as L
from tandem.operators import similarity as M
from tandem.operators.quantiles import quantiles, with_quantiles
from tandem.sources.staging import stage

# The names a column may have in a metric file, the first that is there counts.
ALIASES = {
    "ttr": ("ttr", "type_token_ratio", "lexical_diversity_type_token_ratio"),
    "mattr": ("mattr", "moving_avg_ttr", "lexical_diversity_moving_avg_ttr"),
    "full_self_bleu": ("full_self_bleu", "dataset_full_conversation_self_bleu_self_bleu"),
    "agent_self_bleu": ("agent_self_bleu", "dataset_agent_response_self_bleu_self_bleu"),
    "client_self_bleu": ("client_self_bleu", "dataset_client_response_self_bleu_self_bleu"),
}
#: What Self-BLEU gives for a level, as columns of every row of its model.
STATISTICS = ("self_bleu", "std", "median", "min", "max", "num_texts", "num_empty", "num_duplicates")
SIMILARITY = ("avg_similarity", "std_similarity", "min_similarity", "max_similarity", "median_similarity")


def require(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The frame, if it has all columns."""
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return frame


def resolve(frame: DataFrame, names: list[str]) -> DataFrame:
    """model_name and the columns ``names``, from whatever alias the frame has."""
    require(frame, ["model_name"])
    found = {n: next((a for a in ALIASES[n] if a in frame.columns), None) for n in names}
    missing = [" or ".join(ALIASES[n]) for n, a in found.items() if a is None]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return frame.select("model_name", *(F.col(a).alias(n) for n, a in found.items()))


def first_by_model(frame: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first value that isn't null of each column by model, in the order of ``order``."""
    require(frame, ["model_name", *columns])
    return frame.groupBy("model_name").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def diversity_statistics(frame: DataFrame) -> DataFrame:
    """Mean, sample deviation, least, greatest and median of TTR and MATTR by model, from any alias."""
    named = resolve(frame, ["ttr", "mattr"])
    base = named.groupBy("model_name").agg(*(x for c in ("ttr", "mattr") for x in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))))
    return with_quantiles(base, quantiles(named, ["model_name"], ["ttr", "mattr"]), ["model_name"], {f"{c}_0.5": f"median_{c}" for c in ("ttr", "mattr")})


def conversation_metrics(conversations: DataFrame, language: str, **options) -> DataFrame:
    """``metrics_of_languages`` of conversations (model_name, conversation_id, turns) of one language."""
    return metrics_of_languages(conversations.withColumn("language", F.lit(language)), **options).drop("language")


def metrics_of_languages(conversations: DataFrame, embeddings: DataFrame | None = None, limit: int | None = None, bleu: bool = True, window: int = 100) -> DataFrame:
    """TTR and MATTR of each conversation (language, model_name, conversation_id, turns) of two turns or more, and the Self-BLEU of its model's levels.

    Every language by its own profile; others go. ``limit`` keeps the first conversations of each model. A level that fails
    has null statistics. With ``embeddings`` (model_name, conversation_id, embedding) the similarity of the model's
    different texts is there too, null where there are fewer than two.
    """
    group = ["language", "model_name"]
    keys = [*group, "conversation_id"]
    kept = conversations.where((F.size("turns") >= 2) & F.col("language").isin(*X.PROFILES))
    if limit:
        kept = kept.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy("conversation_id"))).where(F.col("_at") <= limit).drop("_at")
    kept = stage(kept)  # read for the tokens and for every language's levels
    whole, cleaned = X.formatted(F.col("turns")), F.lit(None).cast("string")
    for language, profile in X.PROFILES.items():
        cleaned = F.when(F.col("language") == language, X.clean(whole, profile)).otherwise(cleaned)
    tokens = stage(kept.select(*keys, X.tokens(cleaned).alias("tokens")))
    out = tokens.select(*keys, L.ttr(F.col("tokens")).alias("ttr")).join(L.mattr(tokens, keys, window=window), keys)
    if bleu:
        found = None
        for language, profile in X.PROFILES.items():
            texts = L.level_texts(kept.where(F.col("language") == language), profile, group)
            own = L.with_bleu_tokens(texts, [*group, "level"], profile)
            found = own if found is None else found.unionByName(own)
        scores = L.checked_token_bleu(found, [*group, "level"])
        names = {"full": "full_conversation", "agent": "agent_response", "client": "client_response", "turns": "all_turns"}
        held = F.map_from_entries(F.collect_list(F.struct("level", F.struct(*STATISTICS).alias("s"))))  # a row a level
        wide = scores.groupBy(*group).agg(held.alias("held"))
        named = [F.try_element_at("held", F.lit(level))[c].alias(f"dataset_{name}_self_bleu_{c}") for level, name in names.items() for c in STATISTICS]
        out = out.join(wide.select(*group, *named), group, "left")
    if embeddings is not None:
        texts = M.distinct_texts(kept.select(*keys, whole.alias("text")), group, "text", "conversation_id")
        alike = M.similarity_summary(texts.join(embeddings, ["model_name", "conversation_id"]).select(*keys, "embedding"), group, "conversation_id", "embedding")
        out = out.join(alike, group, "left")
    return out


def model_table(metrics: DataFrame) -> DataFrame:
    """By model: conversations, mean TTR and MATTR, and the columns that hold for the whole model, 0 where they are absent."""
    whole = [c for c in ("dataset_full_conversation_self_bleu_self_bleu", "dataset_agent_response_self_bleu_self_bleu", "dataset_client_response_self_bleu_self_bleu", "avg_similarity", "std_similarity") if c in metrics.columns]
    found = metrics.groupBy("model_name").agg(F.count("*").alias("conversations"), F.avg("ttr").alias("ttr"), F.avg("mattr").alias("mattr"), *(F.min_by(c, "conversation_id").alias(c) for c in whole))
    return found.na.fill(0.0)
