"""Lexical diversity: TTR, MATTR and Self-BLEU over arrays of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions import text as X
from tandem.operators.quantiles import quantiles, with_quantiles
from tandem.sources.staging import stage


def ttr(tokens) -> Column:
    """Distinct tokens to all; 0 for none."""
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(0.0)


def ttr_statistics(docs: DataFrame, group: list[str], tokens: str = "tokens") -> DataFrame:
    """Mean, sample deviation, least, greatest and median TTR of the whole texts of each group."""
    each = docs.select(*group, ttr(F.col(tokens)).alias("ttr"))
    base = each.groupBy(*group).agg(F.avg("ttr").alias("mean"), F.stddev_samp("ttr").alias("std"), F.min("ttr").alias("min"), F.max("ttr").alias("max"))
    return with_quantiles(base, quantiles(each, group, ["ttr"]), group, {"ttr_0.5": "median"})


def mattr(docs: DataFrame, keys: list[str], tokens: str = "tokens", window: int = 100) -> DataFrame:
    """Mean TTR of all windows of ``window`` tokens; of a shorter text its TTR, of an empty one 0.

    A token at place i whose like stood last at p is the first of its kind in every window that starts after p and holds
    i. So the last places of all tokens give the kinds of all windows at once: one pass over a batch of texts, in the task
    that read them. No token is shuffled.
    """
    plain = docs.select(*keys, F.col(tokens).alias("_t"))
    kinds = T.StructType([*(docs.schema[k] for k in keys), T.StructField("mattr", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_t")
            n = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            found = window_kinds(lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False), n, window)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found)], [*keys, "mattr"])

    return plain.mapInArrow(run, kinds)


def window_kinds(code: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """MATTR of texts that stand one after the other: tokens by number, and the texts' sizes."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = (np.cumsum(sizes) - sizes)[text]
    order = np.lexsort((code, text))  # equal tokens of a text side by side, in their order
    like = np.zeros(len(code), bool)
    like[1:] = (code[order][1:] == code[order][:-1]) & (text[order][1:] == text[order][:-1])
    last = np.full(len(code), -1, np.int64)
    last[order[like]] = (order - start[order])[np.flatnonzero(like) - 1]
    at, n = np.arange(len(code)) - start, sizes[text]
    width = np.minimum(window, n)
    held = np.minimum(at, n - width) - np.maximum(np.maximum(last + 1, at - width + 1), 0) + 1
    total = np.bincount(text, np.maximum(held, 0), len(sizes))
    width = np.minimum(window, sizes)
    return np.where(sizes > 0, total / np.maximum(width * (sizes - width + 1), 1), 0.0)


#: Tokens whose n-grams are counted at once in a task, and n-grams of a task after the shuffle.
SLICE, GRAMS = 1 << 18, 1 << 22


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits spread over all of the word (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal codes together, and where their runs begin in it."""
    order = np.argsort(code)
    return order, np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]]) if len(code) else np.zeros(0, np.int64)


def gram_layers(tokens: np.ndarray, sizes: np.ndarray, group: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for the t-th time that an n-gram stands in a text (its code, how many of these texts have it so often, the least of them)."""
    text, start = np.repeat(np.arange(len(sizes)), np.maximum(sizes - n + 1, 0)), np.cumsum(sizes) - sizes
    many = np.maximum(sizes - n + 1, 0)
    at = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + start[text]
    golden = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        gram = _mixed(group + np.uint64(n) * golden)[text]
        for i in range(n):
            gram = _mixed(gram * np.uint64(3) + tokens[at + i])
        order, edge = _places(_mixed(gram + _mixed((text + 1).astype(np.uint64))))  # equal n-grams of one text
        layer = np.empty(len(gram), np.uint64)
        layer[order] = np.arange(len(gram)) - np.repeat(edge, np.diff(np.r_[edge, len(gram)]))
        gram = _mixed(gram + layer * golden)
    order, edge = _places(gram)
    return gram[order][edge], np.diff(np.r_[edge, len(gram)]), np.minimum.reduceat(doc[text][order], edge) if len(edge) else doc[:0]


def _layers(order: int):
    names = ["n", "g", "k", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("_h").value_lengths().to_numpy().astype(np.int64)
            total, low = np.cumsum(sizes), 0
            while low < len(sizes):
                high = max(low + 1, int(np.searchsorted(total, total[low] - sizes[low] + SLICE, "right")))
                part = batch.slice(low, high - low)
                own = [part.column(c).to_numpy() for c in ("_group", "_d")]
                tokens = part.column("_h").flatten().to_numpy().view(np.uint64)
                for n in range(1, order + 1):
                    g, k, d = gram_layers(tokens, sizes[low:high], own[0].view(np.uint64), own[1], n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), n, np.int32)), pa.array(g.view(np.int64)), pa.array(k), pa.array(d)], names)
                low = high

    return run


def hashed_tokens(group: list[str], key: str, tokens: str = "tokens") -> list[Column]:
    """What ``bleu_leads`` reads of a text: its tokens, its group and itself, as 64-bit hashes."""
    return [F.transform(tokens, lambda t: F.xxhash64(t)).alias("_h"), F.xxhash64(*group).alias("_group"), F.xxhash64(*group, key).alias("_d")]


def bleu_leads(hashed: DataFrame, order: int) -> DataFrame:
    """By document ``_d`` its leads ``_1``, ``_2``, ...: how many of its n-grams no other document of the group has so often.

    A document's rival for an n-gram is the greatest count among the others, so its lead over them is the number of times t
    for which it alone holds the n-gram t times or more. A row stands for an n-gram and a t; a task counts those of
    many texts at once, so a common word sends a row a slice of texts. N-grams are 64-bit hashes.
    """
    total = hashed.agg(F.sum(F.size("_h"))).first()[0] or 0
    shuffled = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = hashed.select("_h", "_group", "_d").mapInArrow(_layers(order), "n int, g long, k long, d long")
    alone = rows.repartition(max(shuffled, -(-total * order // GRAMS)), "g").groupBy("g", "n").agg(F.sum("k").alias("k"), F.min("d").alias("_d")).where("k = 1")
    return alone.groupBy("_d").agg(*(F.count_if(F.col("n") == n).alias(f"_{n}") for n in range(1, order + 1)))


def self_bleu_counts(docs: DataFrame, group: list[str], key: str, tokens: str = "tokens", order: int = 4) -> DataFrame:
    """By document and n: clipped n-grams against all other documents of the group, and all n-grams."""
    hashed = stage(docs.where(F.size(tokens) > 0).select(*group, key, *hashed_tokens(group, key, tokens)))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.coalesce(F.col(f"_{n}"), F.lit(0)).alias("lead")) for n in range(1, order + 1))))
    found = hashed.select(*group, key, "_d", F.size("_h").alias("_size")).join(bleu_leads(hashed, order), "_d", "left").select(*group, key, "_size", each.alias("_e"))
    total = (F.col("_size") - F.col("_e.n") + 1).cast("long")
    return found.where(F.col("_size") >= F.col("_e.n")).select(*group, key, F.col("_e.n").alias("n"), (total - F.col("_e.lead")).alias("clipped"), total.alias("total"))


def self_bleu(docs: DataFrame, group: list[str], key: str, tokens: str = "tokens", order: int = 4) -> DataFrame:
    """BLEU of each non-empty document against all others, with method-4 smoothing.

    A zero numerator of n > 1 becomes 1 / (2**k * 5 / ln(length)) at the k-th such n, if the text has more than one
    token; without a common word the score is 0. A text of one token with a common word is null (failed). The brevity
    penalty takes the length nearest to the text's among the others, the shorter of equals.
    """
    return hashed_bleu(stage(docs.select(*group, key, *hashed_tokens(group, key, tokens))), group, key, order)


def hashed_bleu(hashed: DataFrame, group: list[str], key: str, order: int = 4) -> DataFrame:
    """``self_bleu`` of texts with ``hashed_tokens``, staged, as they are read more than once."""
    hashed = hashed.where(F.size("_h") > 0)
    sized = hashed.select(*group, key, "_d", F.size("_h").alias("len"))
    lens = sized.groupBy(*group, "len").agg(F.count("*").alias("_k"))
    # of the different lengths in order only the neighbours can be nearest, or the same if another text has it
    by_length = Window.partitionBy(*group).orderBy("len")
    below, above = F.lag("len").over(by_length), F.lead("len").over(by_length)
    lower = F.when(above.isNull() | (F.col("len") - below <= above - F.col("len")), below).otherwise(above)
    near = lens.select(*group, "len", F.when(F.col("_k") > 1, F.col("len")).otherwise(lower).alias("ref"))
    wide = sized.join(near, [*group, "len"], "left").join(bleu_leads(hashed, order), "_d", "left")
    logs, zeros = F.lit(0.0), F.lit(0)
    hits = [F.greatest(F.col("len") - n + 1, F.lit(0)) - F.coalesce(F.col(f"_{n}"), F.lit(0)) for n in range(1, order + 1)]
    for n, hit in enumerate(hits, 1):
        total = F.greatest(F.col("len") - n + 1, F.lit(1))
        zeros = zeros + F.when(hit == 0, 1).otherwise(0) if n > 1 else zeros
        smooth = F.log(F.col("len").cast("double")) / (F.pow(F.lit(2.0), zeros) * 5)
        logs = logs + F.log(F.when(hit > 0, hit.cast("double")).otherwise(smooth) / total) / order
    penalty = F.when(F.col("len") > F.col("ref"), 0.0).otherwise(1 - F.col("ref") / F.col("len"))
    score = F.when(hits[0] == 0, 0.0).when(F.col("len") > 1, F.exp(penalty + logs))
    return wide.select(*group, key, "len", "ref", F.when(F.col("ref").isNotNull(), score).alias("bleu"))


def level_texts(conversations: DataFrame, profile: X.Profile, group: list[str]) -> DataFrame:
    """(group, level, key, text) of the Self-BLEU levels from turns (speaker, text, is_agent) and the whole text.

    Roles come from the flag, else from the speaker's name. Where the profile's unit is the turn, agent and client texts
    are single turns and ``turns`` is a level too; else they are the turns of a conversation joined by spaces.
    """
    ident = F.col("conversation_id").cast("string")
    full = conversations.select(*group, F.lit("full").alias("level"), ident.alias("key"), X.formatted(F.col("turns")).alias("text"))
    kept = F.filter("turns", lambda t: ~X.blank(t["text"]))
    rows = conversations.select(*group, ident.alias("key"), F.posexplode(kept).alias("at", "t"))
    rows = rows.select(*group, "key", "at", F.col("t.text").alias("text"), X.role(F.col("t.speaker"), F.col("t.is_agent"), profile).alias("level"))
    if profile.unit == "turn":
        each = rows.select(*group, "level", F.concat_ws("-", "key", "at").alias("key"), "text")
        return full.unionByName(each.where("level is not null")).unionByName(each.withColumn("level", F.lit("turns")))
    joined = rows.where("level is not null").groupBy(*group, "level", "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x.text), " ").alias("text"))
    return full.unionByName(joined)


def bleu_tokens(text: Column, profile: X.Profile) -> Column:
    """The tokens that Self-BLEU compares in a language: of the cleaned or raw text, of two characters or more, letters only if so."""
    found = X.tokens(X.clean(text, profile) if profile.bleu_clean else text, profile.stopwords, 2)
    return F.filter(found, lambda t: F.rlike(t, F.lit(r"^\p{L}+$"))) if profile.bleu_alpha else found


def checked_bleu(texts: DataFrame, group: list[str], profile: X.Profile, order: int = 4) -> DataFrame:
    """``checked_token_bleu`` of (group, key, text), with a language's tokens."""
    return checked_token_bleu(with_bleu_tokens(texts, group, profile), group, order)


def with_bleu_tokens(texts: DataFrame, group: list[str], profile: X.Profile) -> DataFrame:
    return texts.select(*group, "key", "text", F.when(~X.blank(F.col("text")), bleu_tokens(F.col("text"), profile)).alias("tokens"))


def checked_token_bleu(tokens: DataFrame, group: list[str], order: int = 4) -> DataFrame:
    """Self-BLEU statistics of (group, key, text, tokens) with the checks on its input.

    A group fails, with null statistics and the cause in ``failure``, when more than a fifth of its texts are blank, when
    fewer than two have tokens, or when more than a tenth of the scores fail. Duplicates are counted and stay.
    """
    if not 1 <= order <= 4:
        raise ValueError(f"order must be 1 to 4, not {order}")
    # all that is asked of a text, read once; texts are told apart by 128 bits
    name = F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")))
    held = stage(tokens.select(*group, "key", name.alias("_text"), X.blank(F.col("text")).alias("_blank"), *hashed_tokens(group, "key")))
    texts = held.groupBy(*group, "_text").agg(F.count("*").alias("_n"), F.count_if("_blank").alias("_empty"), F.count_if(F.size("_h") > 0).alias("_valid"))
    counts = texts.groupBy(*group).agg(F.sum("_n").alias("num_texts"), F.sum("_empty").alias("num_empty"), F.sum("_valid").alias("valid"), F.sum(F.when(F.col("_text").isNotNull(), F.col("_n") - 1).otherwise(0)).alias("num_duplicates"))
    scores = bleu_summary(hashed_bleu(held, group, "key", order), group).withColumnRenamed("mean", "self_bleu")
    cause = F.when(F.col("num_empty") * 5 > F.col("num_texts"), "too many empty texts").when(F.col("valid") < 2, "fewer than two valid texts").when(F.col("failed") * 10 > F.col("valid"), "too many failed scores")
    out = counts.join(scores, group, "left").withColumn("failure", cause)
    return out.select(*group, *(F.when(F.col("failure").isNull(), F.col(c)).alias(c) for c in ("self_bleu", "std", "median", "min", "max")), "num_texts", "num_empty", "num_duplicates", "failure")


def bleu_summary(scores: DataFrame, group: list[str]) -> DataFrame:
    scores = stage(scores.select(*group, "bleu"))  # read by every pass of the median
    base = scores.groupBy(*group).agg(F.avg("bleu").alias("mean"), F.stddev_pop("bleu").alias("std"), F.min("bleu").alias("min"), F.max("bleu").alias("max"), F.count("bleu").alias("n"), F.count_if(F.col("bleu").isNull()).alias("failed"))
    return with_quantiles(base, quantiles(scores, group, ["bleu"]), group, {"bleu_0.5": "median"})
