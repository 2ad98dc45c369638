"""Ranks of models by language, their stability, and resampling."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.stats import kendall_p, spearman_p


#: About as many rows of a language and model are resampled in one task, and as many permutations of two languages dealt.
CHUNK, PERMUTED = 65_536, 1_000
#: Ranks of a range in which inversions are counted by one task.
SPAN = 65_536
#: Replicates ranked in one task, and most pairs of models, over replicates, that are held at once.
REPLICATES, PAIRED, DRAWN = 100, 4_000_000, 4_000_000
KEYS = ["metric", "language", "model"]


def means(scores: DataFrame) -> DataFrame:
    """Mean and count by language, model and metric; rows without a key go."""
    keyed = scores.where("language is not null and model is not null and metric is not null")
    return keyed.groupBy("language", "model", "metric").agg(F.avg("score").alias("mean"), F.count("score").alias("n"))


def ranks(scores: DataFrame) -> DataFrame:
    """Ranks 1..n by mean, highest first; models of equal mean in order of name."""
    at = F.row_number().over(Window.partitionBy("language", "metric").orderBy(F.desc(F.round("mean", 12)), "model"))
    return means(scores).withColumn("rank", at)


def average_ranks(values: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Ranks by ``by``, highest first, equals sharing their mean rank."""
    window = Window.partitionBy(*keys)
    peers = F.count("*").over(Window.partitionBy(*keys, by))
    return values.withColumn("rank", F.rank().over(window.orderBy(F.desc(by))) + (peers - 1) / 2)


def common(ranked: DataFrame) -> DataFrame:
    """(metric, l1, l2, model, r1, r2) of models that both languages of a pair have."""
    a = ranked.select("metric", F.col("language").alias("l1"), "model", F.col("rank").alias("r1"))
    b = ranked.select("metric", F.col("language").alias("l2"), "model", F.col("rank").alias("r2"))
    return a.join(b, ["metric", "model"]).where("l1 < l2")


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation; null where a side doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def count_inversions(values: np.ndarray) -> int:
    """Pairs in the wrong order, equal ones aside: merging counts for every right half how much of its left one is greater."""
    n = len(values)
    if n < 2:
        return 0
    x = np.unique(values, return_inverse=True)[1].astype(np.int64)
    size = 1 << (n - 1).bit_length()
    x = np.r_[x, np.full(size - n, n)]  # the filling is greatest and last, so it is in no such pair
    found, half = 0, 1
    while half < size:
        runs = x.reshape(-1, 2, half)  # halves are sorted
        base = np.arange(len(runs))[:, None] * (n + 1)
        left, right = (runs[:, 0] + base).ravel(), (runs[:, 1] + base).ravel()
        below = np.searchsorted(left, right, "right") - np.repeat(np.arange(len(runs)) * half, half)
        found += int((half - below).sum())
        x = np.sort(x.reshape(-1, 2 * half), axis=1, kind="stable").ravel()
        half *= 2
    return found


def _inside(frame: pd.DataFrame) -> int:
    """Pairs of one range of first ranks in opposite order."""
    return count_inversions(frame.sort_values("r1")["r2"].to_numpy())


def _between(frame: pd.DataFrame) -> int:
    """Pairs of one range of second ranks in opposite order whose first ranks lie in different ranges."""
    return count_inversions(frame.sort_values("r2")["b1"].to_numpy())


def _apart(frame: pd.DataFrame) -> int:
    """Pairs in different ranges of either rank and in opposite order, from the numbers of models by range."""
    grid = np.zeros((int(frame["b1"].max()) + 1, int(frame["b2"].max()) + 1))
    grid[frame["b1"], frame["b2"]] = frame["n"]
    above = grid.cumsum(0) - grid  # earlier first ranges
    later = above[:, ::-1].cumsum(1)[:, ::-1] - above  # of those, later second ranges
    return int((grid * later).sum())


def inversions(ranked: DataFrame, span: int = SPAN) -> DataFrame:
    """By metric and two languages: model pairs, those in opposite order, Kendall's tau, Spearman's rho, p-values.

    No pair of models is built. Models are dealt to ranges of ``span`` ranks on either side; inversions inside a range of first ranks,
    inside a range of second ranks but between ranges of first ones, and between ranges of both are counted apart, the
    first two by merging, the last from a table of the ranges' sizes.
    """
    keys = ["metric", "l1", "l2"]
    again = common(ranked)
    for side in ("r1", "r2"):
        again = again.withColumn(side, F.row_number().over(Window.partitionBy(*keys).orderBy(side)))
    again = again.withColumns({"b1": F.floor((F.col("r1") - 1) / span), "b2": F.floor((F.col("r2") - 1) / span)})
    kinds = "metric string, l1 string, l2 string, found long"
    of = lambda count: lambda frame: pd.DataFrame({**{k: [frame[k].iloc[0]] for k in keys}, "found": [count(frame)]})
    inside = again.groupBy(*keys, "b1").applyInPandas(of(_inside), kinds)
    between = again.groupBy(*keys, "b2").applyInPandas(of(_between), kinds)
    apart = again.groupBy(*keys, "b1", "b2").agg(F.count("*").alias("n")).groupBy(*keys).applyInPandas(of(_apart), kinds)
    flips = inside.unionByName(between).unionByName(apart).groupBy(*keys).agg(F.sum("found").alias("inversions"))
    rho = again.groupBy(*keys).agg(F.count("*").alias("models"), correlation("r1", "r2").alias("rho"))
    out = flips.join(rho, keys).withColumn("pairs", F.expr("models * (models - 1) div 2")).where("pairs > 0")
    return out.select(*keys, "models", "pairs", "inversions", (F.col("inversions") / F.col("pairs")).alias("rate"), (1 - 2 * F.col("inversions") / F.col("pairs")).alias("tau"), "rho")


def with_p_values(found: DataFrame) -> DataFrame:
    return found.withColumn("tau_p", kendall_p("models", "inversions")).withColumn("rho_p", spearman_p("models", "rho"))


def _order(x: np.ndarray) -> np.ndarray:
    """By replicate (row of ``x``): 1, 0 or -1 for each two models, as the first is above, equal or below."""
    a, b = x[:, :, None], x[:, None, :]
    return (a > b).astype(np.int8) - (a < b).astype(np.int8)


def _rank_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """Tau-b and rho of average ranks of two languages' common models, for the replicates of a block; NaN where a side doesn't vary.

    A model's place in the order, summed over all others, is its average rank but for a factor and a shift.
    """
    codes, names = [], []
    for column in ("language", "model"):
        name, code = np.unique(frame[column].to_numpy(), return_inverse=True)
        names.append(name)
        codes.append(code)
    names.insert(1, np.arange(len(frame["sums"].iloc[0])))
    held, there = np.zeros((len(names[0]), len(names[2]), len(names[1]))), np.zeros((len(names[0]), len(names[2])), bool)
    np.add.at(held, tuple(codes), np.stack(frame["sums"].to_list()) / frame["total"].to_numpy(float)[:, None])  # chunks of a model add up
    there[tuple(codes)] = True
    held = np.nan_to_num(held.round(12), nan=np.inf).transpose(0, 2, 1)
    there = np.repeat(there[:, None], len(names[1]), 1)
    found = []
    for i, j in zip(*np.triu_indices(len(names[0]), 1), strict=True):
        use = (there[i] & there[j]).all(0)
        size = int(use.sum())
        step = max(1, PAIRED // max(1, size * size))
        for low in range(0, len(names[1]) if size > 1 else 0, step):
            x, y = (_order(held[k, low : low + step][:, use]) for k in (i, j))
            rx, ry = (o.sum(2, dtype=np.float64) for o in (x, y))
            with np.errstate(invalid="ignore"):
                tau = (x * y).sum((1, 2), dtype=np.float64) / np.sqrt((x != 0).sum((1, 2), dtype=np.float64) * (y != 0).sum((1, 2)))
                rho = (rx * ry).sum(1) / np.sqrt((rx * rx).sum(1) * (ry * ry).sum(1))
            found.append(pd.DataFrame({"l1": names[0][i], "l2": names[0][j], "tau": tau, "rho": rho}))
    out = pd.concat(found) if found else pd.DataFrame({c: [] for c in ("l1", "l2", "tau", "rho")})
    return out.assign(metric=frame["metric"].iloc[0])[["metric", "l1", "l2", "tau", "rho"]]


def paths(sizes: pd.DataFrame) -> pd.DataFrame:
    """Of each chunk its way down a binary tree over all chunks of its group: first, middle and end of a node, rows on its left and in all."""
    sizes = sizes.sort_values("chunk")
    chunks = sizes["chunk"].to_numpy()
    before = np.r_[0, np.cumsum(sizes["n"].to_numpy())]
    rows = []
    for place, chunk in enumerate(chunks.tolist()):
        low, high, path = 0, len(chunks), []
        while high - low > 1:
            middle = (low + high) // 2
            path.append((low, middle, high, int(before[middle] - before[low]), int(before[high] - before[low])))
            low, high = (low, middle) if place < middle else (middle, high)
        rows.append({**{k: sizes[k].iloc[0] for k in KEYS}, "chunk": chunk, "place": place, "total": int(before[-1]), "path": path})
    return pd.DataFrame(rows)


def shares(name: str, place: int, total: int, path: list, replicates: int, seed: int) -> np.ndarray:
    """How many of each replicate's draws fall into a chunk: at every node of its path a binomial deals them to left and right.

    Nodes have seeds of their own, so all chunks below one see the same deal, and no chunk needs the sizes of all others.
    """
    left = np.full(replicates, total)
    for low, middle, high, own, every in path:
        rng = np.random.default_rng([seed, zlib.crc32(name.encode()), low, high])
        first = rng.binomial(left, own / every)
        left = first if place < middle else left - first
    return left


def resampled(score: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """By replicate the sum of as many draws with replacement as its share."""
    out, low = np.zeros(len(share)), 0
    while low < len(share):  # a bounded number of draws at once
        high = max(low + 1, int(np.searchsorted(np.cumsum(share[low:]), DRAWN, "right")) + low)
        some = share[low:high]
        drawn = score[rng.integers(0, len(score), int(some.sum()))]
        ends = np.cumsum(some)
        total = np.r_[0.0, np.cumsum(drawn)]
        out[low:high] = total[ends] - total[ends - some]
        low = high
    return out


def bootstrap(scores: DataFrame, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Tau and rho of average ranks over resampled conversations: mean, 2.5 and 97.5 percentiles, deviation.

    The rows of a language and model stand in chunks of bounded size. Each chunk finds its own share of a replicate's draws
    on its way down a tree of seeded binomials, in the logarithm of the number of chunks, and draws its own rows: together a draw
    with replacement from all rows. Only a block of sums a chunk is shuffled.
    """
    sizes = scores.groupBy(*KEYS).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = scores.join(sizes, KEYS).select(*KEYS, "conversation_id", "score", F.pmod(F.xxhash64("conversation_id"), F.col("chunks")).cast("int").alias("chunk"))
    node = "struct<low: int, middle: int, high: int, own: long, every: long>"
    ways = dealt.groupBy(*KEYS, "chunk").agg(F.count("*").alias("n")).groupBy(*KEYS).applyInPandas(paths, f"metric string, language string, model string, chunk int, place int, total long, path array<{node}>")

    def draw(frame: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        frame, own = frame.sort_values(["conversation_id", "score"]), way.iloc[0]
        name = "\x1f".join(map(str, own[KEYS]))
        path = [tuple(int(node[k]) for k in ("low", "middle", "high", "own", "every")) for node in own["path"]]
        share = shares(name, int(own["place"]), int(own["total"]), path, replicates, seed)
        rng = np.random.default_rng([seed, zlib.crc32(name.encode()), 1 << 32, int(own["place"])])
        sums = resampled(frame["score"].to_numpy(float), share, rng)
        blocks = [sums[i : i + REPLICATES] for i in range(0, replicates, REPLICATES)]
        return pd.DataFrame({**{k: own[k] for k in KEYS}, "block": np.arange(len(blocks)), "sums": blocks, "total": int(own["total"])})

    kinds = "metric string, language string, model string, block long, sums array<double>, total long"
    blocks = dealt.groupBy(*KEYS, "chunk").cogroup(ways.groupBy(*KEYS, "chunk")).applyInPandas(draw, kinds)
    both = blocks.groupBy("metric", "block").applyInPandas(_rank_pairs, "metric string, l1 string, l2 string, tau double, rho double")
    none = F.lit(float("nan"))
    out = both.select("metric", "l1", "l2", *(F.nullif(F.col(c), none).alias(c) for c in ("tau", "rho"))).groupBy("metric", "l1", "l2")
    # a row a replicate: a bounded number
    return out.agg(*(x for c in ("tau", "rho") for x in (F.avg(c).alias(f"{c}_mean"), F.percentile(c, 0.025).alias(f"{c}_low"), F.percentile(c, 0.975).alias(f"{c}_high"), F.stddev_pop(c).alias(f"{c}_std"))))


def flipped(a: np.ndarray, b: np.ndarray) -> list[int]:
    """By row the pairs of columns in opposite order on both sides, of the columns that both have; rows with fewer than two of them go."""
    both = ~np.isnan(a) & ~np.isnan(b)
    use = both.sum(1) > 1
    a, b, both = a[use], b[use], both[use]
    m = a.shape[1]
    if m * m > PAIRED:
        return [count_inversions(y[own][np.argsort(x[own])]) for x, y, own in zip(a, b, both, strict=True)]
    out: list[int] = []
    i, j = np.triu_indices(m, 1)
    for low in range(0, len(a), step := max(1, PAIRED // max(1, len(i)))):
        x, y, own = a[low : low + step], b[low : low + step], both[low : low + step]
        out += (((x[:, i] < x[:, j]) != (y[:, i] < y[:, j])) & own[:, i] & own[:, j]).sum(1).tolist()
    return out


def permutation(ranked: DataFrame, permutations: int = 5000, seed: int = 42) -> DataFrame:
    """p of as many inversions or more when the language labels of the ranking rows are dealt anew.

    Where a model then has two rows of one language, the last counts; models with both are compared.
    """
    pairs = ranked.select("metric", "language").distinct()
    lp = pairs.withColumnRenamed("language", "l1").join(pairs.withColumnRenamed("language", "l2"), "metric").where("l1 < l2")
    rows = lp.join(ranked.select("metric", "language", "model", "rank"), "metric").where("language = l1 or language = l2").select("metric", "l1", "l2", "language", "model", "rank")
    # a group is two languages' models; its permutations are dealt to several tasks
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-permutations // PERMUTED) - 1))).alias("block")

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["language", "model"])
        name, block = "\x1f".join(map(str, frame[["metric", "l1", "l2"]].iloc[0])), int(frame["block"].iloc[0])
        rng = np.random.default_rng([seed, zlib.crc32(name.encode()), block])
        models, code = np.unique(frame["model"].to_numpy(str), return_inverse=True)
        rank, first = frame["rank"].to_numpy(float), int((frame["language"] == frame["l1"]).sum())
        count, found = min(permutations, (block + 1) * PERMUTED) - block * PERMUTED, []
        step = max(1, PAIRED // len(models))
        for low in range(0, count, step):
            new = np.zeros((min(step, count - low), len(frame)), bool)
            new[:, :first] = True
            new = rng.permuted(new, axis=1)
            a, b = np.full((len(new), len(models)), np.nan), np.full((len(new), len(models)), np.nan)
            for k, at in enumerate(code.tolist()):  # the last row of a model counts
                a[new[:, k], at], b[~new[:, k], at] = rank[k], rank[k]
            found += flipped(a, b)
        return pd.DataFrame({**{k: frame[k].iloc[0] for k in ("metric", "l1", "l2")}, "x": found}, columns=["metric", "l1", "l2", "x"])

    got = rows.select("*", blocks).groupBy("metric", "l1", "l2", "block").applyInPandas(deal, "metric string, l1 string, l2 string, x long")
    seen = inversions(ranked).select("metric", "l1", "l2", "inversions")
    return got.join(F.broadcast(seen), ["metric", "l1", "l2"]).groupBy("metric", "l1", "l2").agg(F.count("*").alias("permutations"), F.least(2 * F.avg((F.col("x") >= F.col("inversions")).cast("int")), F.lit(1.0)).alias("p"))


def analyse(scores: DataFrame, metrics: list[str] | None = None, languages: list[str] | None = None, n_bootstrap: int = 2000, n_permutations: int = 5000, seed: int = 42) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The whole ranking analysis: statistics of language pairs (with intervals and permutation p unless their number is 0), ranks, metadata."""
    used = scores.where(F.col("metric").isin(metrics)) if metrics else scores
    used = used.where(F.col("language").isin(languages)) if languages else used
    ranked = ranks(used)
    statistics = with_p_values(inversions(ranked))
    keys = ["metric", "l1", "l2"]
    if n_bootstrap:
        statistics = statistics.join(bootstrap(used, n_bootstrap, seed), keys, "left")
    if n_permutations:
        statistics = statistics.join(permutation(ranked, n_permutations, seed).select(*keys, F.col("p").alias("inversion_p")), keys, "left")
    about = metadata(used).first()
    return statistics, ranked, {"n_bootstrap": n_bootstrap, "n_permutations": n_permutations, **about.asDict()}


def metadata(scores: DataFrame) -> DataFrame:
    """Different conversations and models of the scores."""
    return scores.agg(F.count_distinct("conversation_id").alias("total_conversations"), F.count_distinct("model").alias("total_models"))


def of_pair(statistics: DataFrame, metric: str, first: str, second: str) -> DataFrame:
    """The statistics of one metric and two languages, in either order."""
    l1, l2 = sorted((first, second))
    return statistics.where((F.col("metric") == metric) & (F.col("l1") == l1) & (F.col("l2") == l2))


def of_language(ranked: DataFrame, language: str, metric: str) -> DataFrame:
    return ranked.where((F.col("language") == language) & (F.col("metric") == metric))


def display_grid(ranked: DataFrame, languages: list[str], value: str = "rank") -> DataFrame:
    """A row a metric and model, a column a language, a dash where the model lacks it."""
    wide = ranked.groupBy("metric", "model").pivot("language", languages).agg(F.first(F.col(value).cast("string")))
    return wide.na.fill("—", languages)
