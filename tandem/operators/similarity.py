"""Cosine similarity: of two vectors, and statistics over all pairs in a group after exact duplicates are dropped."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators.quantiles import weighted_ranks
from tandem.sources.staging import stage

#: Bins of a histogram of cosines.
BINS = 4096


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """0 where a vector is absent or zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def distinct_texts(rows: DataFrame, group: list[str], text: str, order: str) -> DataFrame:
    """The first row of each text in its group."""
    at = F.row_number().over(Window.partitionBy(*group, text).orderBy(order))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def duplicate_counts(rows: DataFrame, group: list[str], text: str) -> DataFrame:
    return rows.groupBy(*group).agg((F.count(text) - F.count_distinct(text)).alias("num_duplicates"), F.count_if(F.coalesce(text, F.lit("")) == "").alias("num_empty"))


def _dealt(vectors: DataFrame, group: list[str], key: str, vector: str, block: int) -> DataFrame:
    """The vectors of each group, dealt to blocks of about ``block``; a row for every two blocks that meet (``_lo``, ``_hi``).

    A large group is spread over the cluster so, and no tile holds more than two blocks.
    """
    own = vectors.where(dot(vector, vector) > 0).select(F.struct(*group).alias("_g"), F.col(key).alias("_k"), F.transform(vector, lambda x: x.cast("double")).alias("_u"))
    sizes = own.groupBy("_g").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    dealt = own.join(sizes, "_g").withColumn("_b", F.pmod(F.xxhash64("_k"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("_lo", F.least("_b", "_o")).withColumn("_hi", F.greatest("_b", "_o")).drop("_o", "_blocks")


def _gram(frame: pd.DataFrame) -> np.ndarray:
    """The cosines of a tile's pairs, each pair of the group in one tile only."""
    frame = frame.sort_values("_k", kind="stable")
    x = np.array(frame["_u"].tolist(), float)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    b = frame["_b"].to_numpy()
    whole = frame["_lo"].iloc[0] == frame["_hi"].iloc[0]
    if whole:
        i, j = np.triu_indices(len(x), 1)
        return np.clip((x @ x.T)[i, j], -1, 1)
    return np.clip(x[b == b.min()] @ x[b != b.min()].T, -1, 1).ravel() if b.min() != b.max() else np.zeros(0)


def _bin(s: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.minimum(((s - low) / (high - low) * BINS).astype(np.int64), BINS - 1) if high > low else np.zeros(len(s), np.int64)


def _tile(frame: pd.DataFrame) -> pd.DataFrame:
    """One row: count, mean, squared deviations, extremes and the histogram of a tile's pairs."""
    s = _gram(frame)
    kinds, many = np.unique(_bin(s, -1.0, 1.0), return_counts=True)
    mean = s.mean() if len(s) else 0.0
    row = {"_n": len(s), "_mean": mean, "_m2": ((s - mean) ** 2).sum(), "_min": s.min(initial=2.0), "_max": s.max(initial=-2.0), "_bins": kinds.tolist(), "_many": many.tolist()}
    return pd.DataFrame({"_g": [frame["_g"].iloc[0]], **{k: [v] for k, v in row.items()}})


def _within(frame: pd.DataFrame) -> pd.DataFrame:
    """For the two bins that hold the middle ranks, the finer histogram of a tile."""
    s, rows = _gram(frame), []
    for side in ("_low", "_high"):
        at = int(frame[side].iloc[0])
        inside = s[_bin(s, -1.0, 1.0) == at]
        kinds, many = np.unique(_bin(inside, *edges(at)), return_counts=True)
        rows.append({"_g": frame["_g"].iloc[0], "_bin": at, "_bins": kinds.tolist(), "_many": many.tolist()})
        if frame["_low"].iloc[0] == frame["_high"].iloc[0]:
            break
    return pd.DataFrame(rows)


def _values(frame: pd.DataFrame) -> pd.DataFrame:
    """The different cosines of a tile in the finer bins, with their counts."""
    s, rows = _gram(frame), []
    for at, fine in sorted({(int(frame[f"_{side}"].iloc[0]), int(frame[f"_{side}_fine"].iloc[0])) for side in ("low", "high")}):
        inside = s[_bin(s, -1.0, 1.0) == at]
        kinds, many = np.unique(inside[_bin(inside, *edges(at)) == fine], return_counts=True)
        rows += [{"_g": frame["_g"].iloc[0], "_bin": at, "_fine": fine, "_x": x, "_w": w} for x, w in zip(kinds, many, strict=True)]
    return pd.DataFrame(rows, columns=["_g", "_bin", "_fine", "_x", "_w"])


def edges(at: int) -> tuple[float, float]:
    """The bounds of a bin of cosines."""
    return -1 + 2 * at / BINS, -1 + 2 * (at + 1) / BINS


def _ranked(histogram: DataFrame, keys: list[str], rank: str, names: tuple[str, str]) -> DataFrame:
    """The bin (names[0]) of a histogram (keys, _at, _n, rank) that holds the rank, and the rank in it (names[1])."""
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = histogram.withColumn("_before", before).where((F.col(rank) >= F.col("_before")) & (F.col(rank) < F.col("_before") + F.col("_n")))
    return placed.select(*keys, F.col("_at").alias(names[0]), (F.col(rank) - F.col("_before")).alias(names[1]))


def similarity_summary(vectors: DataFrame, group: list[str], key: str, vector: str, block: int = 1000) -> DataFrame:
    """Mean, extremes, deviation and median of the cosines of all pairs in each group, and their number.

    Every two blocks of a group are multiplied in a task of their own, which returns one row: count, moments, extremes and a
    histogram. No pair leaves it. The median is selected: of the bin that holds its rank a second product counts finer
    bins, and of that one a third gives the different values. Zero vectors are in no pair.
    """
    dealt = _dealt(vectors, group, key, vector, block)
    kind = dealt.schema["_g"].dataType.simpleString()
    moments = "_n long, _mean double, _m2 double, _min double, _max double, _bins array<bigint>, _many array<bigint>"
    tiles = stage(dealt.groupBy("_g", "_lo", "_hi").applyInPandas(_tile, f"_g {kind}, {moments}").where("_n > 0"))
    whole = tiles.groupBy("_g").agg(F.sum("_n").alias("n"), (F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).alias("mean"), F.min("_min").alias("min"), F.max("_max").alias("max"))
    spread = tiles.join(whole, "_g").groupBy("_g").agg(F.sum(F.col("_m2") + F.col("_n") * F.pow(F.col("_mean") - F.col("mean"), 2)).alias("m2"))
    sides = {"low": F.floor((F.col("n") - 1) / 2), "high": F.ceil((F.col("n") - 1) / 2)}
    ranks = whole.select("_g", *(c.cast("long").alias(f"_{side}_rank") for side, c in sides.items()))

    def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
        pair = rows.select(*keys, F.explode(F.arrays_zip("_bins", "_many")).alias("p"))
        return pair.groupBy(*keys, F.col("p._bins").alias("_at")).agg(F.sum("p._many").alias("_n"))

    histogram = counted(tiles, ["_g"]).join(ranks, "_g")
    low, high = (_ranked(histogram, ["_g"], f"_{side}_rank", (f"_{side}", f"_{side}_left")) for side in sides)
    bins = stage(low.join(high, "_g"))
    finer = dealt.join(bins.select("_g", "_low", "_high"), "_g").groupBy("_g", "_lo", "_hi").applyInPandas(_within, f"_g {kind}, _bin long, _bins array<bigint>, _many array<bigint>")
    fine = stage(counted(finer, ["_g", "_bin"]))
    chosen = bins
    for side in sides:
        own = fine.join(bins.select("_g", F.col(f"_{side}").alias("_bin"), f"_{side}_left"), ["_g", "_bin"])
        chosen = chosen.join(_ranked(own, ["_g"], f"_{side}_left", (f"_{side}_fine", f"_{side}_rest")), "_g")
    chosen = stage(chosen)
    values = dealt.join(chosen.select("_g", "_low", "_high", "_low_fine", "_high_fine"), "_g").groupBy("_g", "_lo", "_hi").applyInPandas(_values, f"_g {kind}, _bin long, _fine long, _x double, _w long")
    out = whole.join(spread, "_g")
    place = {side: chosen.select("_g", F.col(f"_{side}").alias("_bin"), F.col(f"_{side}_fine").alias("_fine"), F.col(f"_{side}_rest").alias("_rank")) for side in sides}
    counts = values.groupBy("_g", "_bin", "_fine", "_x").agg(F.sum("_w").alias("_w"))
    width, low = 2 / BINS / BINS, -1 + F.col("_bin") * (2 / BINS)
    ranks = place["low"].union(place["high"]).distinct().withColumns({"_low": low + (F.col("_fine") - 1) * width, "_high": low + (F.col("_fine") + 2) * width})
    # two passes come down to less than a rounding error of a cosine
    found = stage(weighted_ranks(counts, ["_g", "_bin", "_fine"], ranks, 3))
    for side in sides:
        out = out.join(found.join(place[side], ["_g", "_bin", "_fine", "_rank"]).select("_g", F.col("_value").alias(f"_{side}_value")), "_g")
    names = {"avg": F.col("mean"), "max": F.col("max"), "min": F.col("min"), "std": F.sqrt(F.col("m2") / F.col("n")), "median": (F.col("_low_value") + F.col("_high_value")) / 2}
    return out.select(*(F.col(f"_g.{g}").alias(g) for g in group), *(c.alias(f"{name}_similarity") for name, c in names.items()), F.col("n").alias("num_comparisons"))
