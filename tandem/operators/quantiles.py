"""Exact quantiles of groups of any size, by selection: no group's values meet in one place.

Each pass counts a histogram of the part that still holds the wanted rank and goes on with the one bucket that the rank is
in. The first deals values by sign and logarithm (``OCTAVE`` buckets for every doubling), the others deal the bucket to ``PARTS``
equal parts between its least and its greatest value. Both keep the order of doubles, and four passes come down to single values.
What an aggregation holds is a row a bucket, never a row a value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OCTAVE, PARTS, PASSES = 16, 1 << 17, 4
#: Above the exponent of the least double.
_EXPONENT = 1100


def _first_digit(x: Column) -> Column:
    size = F.floor((F.log2(F.abs(x)) + _EXPONENT) * OCTAVE)
    return F.when(x == 0, F.lit(0)).when(F.isnan(x), F.lit(1 << 30)).when(F.abs(x) == math.inf, F.signum(x) * (1 << 20)).otherwise(F.signum(x) * size).cast("long")


def _digit(x: Column, low: Column, high: Column) -> Column:
    """The part of [low, high] that x is in; halves are taken first, as the whole span may be no double."""
    share = (x / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(high == low, F.lit(0)).otherwise(F.floor(share * (PARTS - 1))).cast("long")


def _choose(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Of a histogram (keys, rank, digit, n, low, high) the bucket with the rank, which is then counted from its beginning."""
    before = F.sum("_n").over(Window.partitionBy(*keys, "_rank").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1))
    placed = histogram.withColumn("_before", F.coalesce(before, F.lit(0)))
    here = (F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_n"))
    return placed.where(here).select(*keys, "_rank", (F.col("_left") - F.col("_before")).alias("_left"), "_low", "_high")


def _bounds(x: str = "_x") -> list[Column]:
    return [F.sum("_w").alias("_n"), F.min(x).alias("_low"), F.max(x).alias("_high")]


def weighted_ranks(counts: DataFrame, keys: list[str], ranks: DataFrame, passes: int = PASSES) -> DataFrame:
    """(keys, _rank, _value): the values at the ranks (keys, _rank from 0) of values _x that stand for _w rows each. Keys aren't null.

    Ranks with _low and _high begin with values known to lie between them.
    """
    started = ranks.select(*keys, "_rank", F.col("_rank").alias("_left"), *(c for c in ("_low", "_high") if c in ranks.columns))
    first = counts.groupBy(*keys, _first_digit(F.col("_x")).alias("_digit")).agg(*_bounds())
    now = started if "_low" in started.columns else _choose(first.join(started, keys), keys)
    for _ in range(passes - 1):
        inside = counts.join(now, keys).where((F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_high")))
        found = inside.groupBy(*keys, "_rank", "_left", _digit(F.col("_x"), F.col("_low"), F.col("_high")).alias("_digit")).agg(*_bounds())
        now = _choose(found, keys)
    return now.select(*keys, "_rank", F.col("_low").alias("_value"))


def _needed(total: Column, q: float) -> tuple[Column, Column, Column]:
    """The two ranks around a quantile, and the way from one to the other."""
    at = (total - 1) * F.lit(float(q))
    return F.floor(at).cast("long"), F.ceil(at).cast("long"), at - F.floor(at)


def quantiles(rows: DataFrame, group: list[str], columns: list[str], shares: tuple[float, ...] = (0.5,), weight: str | None = None) -> DataFrame:
    """By group, ``column_share`` for each column and share (``ttr_0.5``): the value at that share of the way through, between two rows on the line between them.

    Nulls don't count; a group without values has null. Groups may be null. ``weight`` is how many rows a row stands for.
    """
    packed = rows.select(F.struct(*group).alias("_g"), *(F.col(c).cast("double").alias(c) for c in columns), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    long = packed.unpivot(["_g", "_w"], columns, "_column", "_x").where("_x is not null")
    counts = long.groupBy("_g", "_column", "_x").agg(F.sum("_w").alias("_w"))
    totals = counts.groupBy("_g", "_column").agg(F.sum("_w").alias("_total"))
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(*_needed(F.col("_total"), q)[:2]) for q in shares))))
    found = weighted_ranks(counts, ["_g", "_column"], totals.select("_g", "_column", F.explode(wanted).alias("_rank")))
    values = found.groupBy("_g", "_column").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_values")).join(totals, ["_g", "_column"])
    at = lambda rank: F.element_at("_values", rank)
    shown = []
    for q in shares:
        low, high, way = _needed(F.col("_total"), q)
        shown.append(F.when(way == 0, at(low)).otherwise(at(low) + (at(high) - at(low)) * way).alias(f"_{q}"))
    each = values.select("_g", "_column", F.struct(*shown).alias("_s"))
    wide = each.groupBy("_g").agg(*(F.first(F.when(F.col("_column") == c, F.col(f"_s.`_{q}`")), True).alias(f"{c}_{q}") for c in columns for q in shares))
    return wide.select(*(F.col(f"_g.{g}").alias(g) for g in group), *(f"`{c}_{q}`" for c in columns for q in shares))


def with_quantiles(base: DataFrame, found: DataFrame, group: list[str], names: dict[str, str]) -> DataFrame:
    """The rows of ``base``, one a group, with columns of ``quantiles`` under new names; groups may be null."""
    other = found.select(F.struct(*group).alias("_g"), *(F.col(f"`{old}`").alias(new) for old, new in names.items()))
    return base.withColumn("_g", F.struct(*group)).join(other, "_g", "left").drop("_g")
