"""Operators that must not gather a group: exact quantiles, tiles, splits, inversions, draws; and calls that are paid once."""

from __future__ import annotations

import json
import math
import random
import re
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tandem.operators import generate as G
from tandem.operators import lexical as L
from tandem.operators import quantiles as Q
from tandem.operators import ranking as R
from tandem.operators import similarity as M
from tandem.sources import io


def test_quantiles_equal_numpy(spark):
    rng = random.Random(3)
    values = {"a": [rng.gauss(0, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(999)], "b": [0.0, -0.0, 1.5] * 40, "c": [math.pi], "d": [-1e308, 1e308], "e": [float(i % 7) for i in range(500)], "f": [5e-324, 0.0, -5e-324, 1e-310]}
    rows = [(g, v, v if i % 2 else None) for g, own in values.items() for i, v in enumerate(own)] + [(None, 4.0, 1.0), (None, 6.0, None), ("n", None, None)]
    shares = (0.0, 0.025, 0.5, 0.9, 1.0)
    got = {r["g"]: r for r in Q.quantiles(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], ["x", "y"], shares).collect()}
    assert "n" not in got and (got[None]["x_0.5"], got[None]["y_0.5"]) == (5.0, 1.0)
    for g, own in values.items():
        for q in shares:
            with np.errstate(over="ignore"):
                assert got[g][f"x_{q}"] == pytest.approx(np.quantile(own, q), rel=1e-12) or g == "d"
    assert got["c"]["y_0.5"] is None


def test_quantiles_hold_buckets_not_values(spark):
    rows = spark.range(60_000).select(F.lit("hot").alias("g"), F.rand(5).alias("x"))
    plan = Q.quantiles(rows, ["g"], ["x"])._jdf.queryExecution().optimizedPlan().toString()
    # what a group gathers is the few wanted ranks; no aggregation collects or sorts its values
    assert "percentile" not in plan.lower() and plan.count("collect_list(struct(") == 1 and "collect_list(_x" not in plan
    counts = rows.select(F.struct("g").alias("_g"), F.col("x").alias("_x"), F.lit(1).cast("long").alias("_w"))
    buckets = counts.groupBy("_g", Q._first_digit(F.col("_x")).alias("d")).count().count()
    assert buckets < 60_000 / 50


def test_weighted_quantile(spark):
    frame = spark.createDataFrame([(1, 1.0, 3), (1, 2.0, 1), (1, 9.0, 4)], "g int, x double, w long")
    assert Q.quantiles(frame, ["g"], ["x"], (0.5,), "w").first()["x_0.5"] == np.median([1, 1, 1, 2, 9, 9, 9, 9])


@pytest.mark.parametrize("block", [7, 1000])
def test_tile_statistics_against_all_pairs(spark, block):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for g, n in (("a", 41), ("b", 2), ("c", 1), ("d", 30)):
        x = rng.normal(size=(n, 6))
        if g == "d":
            x[:] = x[0]
        rows += [(g, i, v.tolist()) for i, v in enumerate(x)] + [(g, 1000, [0.0] * 6), (g, 1001, None)]
        u = x / np.sqrt((x * x).sum(1, keepdims=True))
        s = (u @ u.T)[np.triu_indices(n, 1)]
        if len(s):
            want[g] = (s.mean(), s.max(), s.min(), s.std(), np.median(s), len(s))
    frame = spark.createDataFrame(rows, "g string, id long, v array<double>")
    got = {r.g: tuple(r)[1:] for r in M.similarity_summary(frame, ["g"], "id", "v", block).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-9)


def test_a_tile_returns_one_row():
    frame = pd.DataFrame({"_g": [("x",)] * 300, "_k": range(300), "_u": list(np.random.default_rng(1).normal(size=(300, 4))), "_b": [0] * 300, "_lo": [0] * 300, "_hi": [0] * 300})
    out = M._tile(frame)
    assert len(out) == 1 and out["_n"][0] == 300 * 299 // 2 and len(out["_bins"][0]) <= M.BINS


def plain_inversions(x):
    return sum(a > b for i, a in enumerate(x) for b in x[i + 1 :])


def test_inversions_by_merging():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 17, 64, 101):
        x = rng.integers(0, max(1, n // 2), n)
        assert R.count_inversions(x) == plain_inversions(x.tolist())


@pytest.mark.parametrize("span", [4, 65_536])
def test_inversions_over_ranges(spark, span):
    rng = random.Random(1)
    order = {(m, lang): rng.sample(range(1, 24), 23) for m in "GR" for lang in ("et", "fi", "hu")}
    rows = [(m, lang, f"x{i}", r) for (m, lang), own in order.items() for i, r in enumerate(own) if not (lang == "hu" and i % 5 == 0)]
    got = {(r.metric, r.l1, r.l2): (r.models, r.pairs, r.inversions) for r in R.inversions(spark.createDataFrame(rows, "metric string, language string, model string, rank int"), span).collect()}
    for (m, a), (_, b) in [((m, a), (m, b)) for m in "GR" for a, b in (("et", "fi"), ("et", "hu"), ("fi", "hu"))]:
        both = [(x, y) for i, (x, y) in enumerate(zip(order[m, a], order[m, b], strict=True)) if not (b == "hu" and i % 5 == 0)]
        n = len(both)
        assert got[m, a, b] == (n, n * (n - 1) // 2, plain_inversions([y for _, y in sorted(both)]))


def test_inversions_of_many_models(spark):
    n = 100_000
    rows = spark.range(1, n + 1).select(F.lit("G").alias("metric"), F.explode(F.array(F.lit("et"), F.lit("fi"))).alias("language"), F.col("id").cast("string").alias("model"), F.col("id").alias("rank"))
    reverse = rows.withColumn("rank", F.when(F.col("language") == "fi", n + 1 - F.col("rank")).otherwise(F.col("rank")))
    row = R.inversions(reverse).first()
    assert (row.models, row.inversions, row.tau) == (n, n * (n - 1) // 2, -1.0)


def test_permuted_flips(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.permuted(np.tile(np.arange(9.0), (30, 1)), axis=1), rng.permuted(np.tile(np.arange(9.0), (30, 1)), axis=1)
    a[rng.random(a.shape) < 0.3] = np.nan
    want = R.flipped(a, b)
    monkeypatch.setattr(R, "PAIRED", 10)
    assert R.flipped(a, b) == want


def test_shares_of_a_splitting_tree_are_multinomial():
    n = [5, 1, 9, 3, 2]
    sizes = pd.DataFrame({"metric": "G", "language": "et", "model": "m", "chunk": range(5), "n": n})
    ways = R.paths(sizes)
    draws = np.array([R.shares("x", w.place, w.total, w.path, 20_000, 7) for w in ways.itertuples()])
    assert (draws.sum(0) == 20).all()
    p = np.array(n) / 20
    assert np.allclose(draws.mean(1), 20 * p, atol=0.08)
    want = 20 * (np.diag(p) - np.outer(p, p))
    assert np.allclose(np.cov(draws), want, atol=0.15)
    # what a chunk holds grows with the logarithm of the number of chunks
    many = R.paths(pd.DataFrame({"metric": "G", "language": "et", "model": "m", "chunk": range(1000), "n": 1}))
    assert max(map(len, many["path"])) == 10


def test_resampled_sums(monkeypatch):
    monkeypatch.setattr(R, "DRAWN", 50)
    score, share = np.arange(6.0), np.array([0, 3, 40, 200, 0, 1])
    got = R.resampled(score, share, np.random.default_rng(0))
    assert got[0] == got[4] == 0 and 0 <= got[1] <= 15 and abs(got[3] / 200 - 2.5) < 0.5


def test_bootstrap_doesnt_depend_on_chunks_in_distribution(spark, monkeypatch):
    rng = random.Random(0)
    rows = [(lang, m, "G", i, rng.random() + k * 0.02) for lang in ("et", "fi") for k, m in enumerate("abcd") for i in range(60)]
    frame = spark.createDataFrame(rows, "language string, model string, metric string, conversation_id long, score double")
    whole = R.bootstrap(frame, 400).first()
    monkeypatch.setattr(R, "CHUNK", 9)
    parts = R.bootstrap(frame, 400).first()
    assert abs(whole.tau_mean - parts.tau_mean) < 0.15 and abs(whole.tau_std - parts.tau_std) < 0.1
    assert R.bootstrap(frame, 400).first() == parts


def test_mattr_kernel():
    rng = random.Random(4)
    texts = [[rng.choice("abcdefgh") for _ in range(n)] for n in (0, 1, 5, 9, 30, 0)]
    code = np.array([ord(t) for text in texts for t in text])
    got = L.window_kinds(code, np.array(list(map(len, texts))), 9)
    for text, value in zip(texts, got.tolist(), strict=True):
        w = min(9, len(text))
        windows = [len(set(text[i : i + w])) / w for i in range(len(text) - w + 1)] if text else [0.0]
        assert value == pytest.approx(sum(windows) / len(windows))


def test_mattr_shuffles_no_token(spark):
    frame = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id long, tokens array<string>")
    found = L.mattr(frame, ["id"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.mattr for r in found.collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_rows_are_numbered_over_the_splits_of_a_file(spark, tmp_path):
    path = tmp_path / "convo_g_et_20260127-143052.jsonl"
    lines = []
    for i in range(300):
        lines.append(json.dumps({"subject": f"s{i}", "messages": []}))
        if i % 7 == 0:
            lines += ["", "{broken"]
    path.write_text("\n".join(lines) + "\n")
    (tmp_path / "convo_g_fi_20260127-143052.jsonl").write_text("\n".join(lines[:20]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = io.read_conversations(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        assert not re.search(r"\bWindow\b", rows._jdf.queryExecution().optimizedPlan().toString())
        got = {(r.file_language, r.conversation_id): r.subject for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {k: v for k, v in got.items() if k[0] == "et"} == {("et", f"g_et_20260127-143052_{i:04d}"): f"s{i}" for i in range(300)}
    assert sum(k[0] == "fi" for k in got) == sum(x not in ("", "{broken") for x in lines[:20])


SCHEMA = "id long, prompt string, score double, error string, processing_time double"


def test_calls_are_made_once_over_retries_and_restarts(spark, tmp_path):
    calls, mark = tmp_path / "calls", tmp_path / "failed"
    calls.mkdir()

    def make():
        def call(row):
            (calls / f"{row['id']}-{random.random()}").touch()
            if row["id"] == 13:
                raise ValueError("refused")
            return {"score": float(row["id"])}

        return call

    log = G.CallLog(f"file://{tmp_path}/log", "m")
    rows = spark.range(20).select("id", F.lit("p").alias("prompt")).coalesce(1)

    def dies(batches):
        for batch in batches:
            if not mark.exists():
                mark.touch()
                raise RuntimeError("the task is lost after its calls")
            yield batch

    out = G.apply_model(rows, make, SCHEMA, 2, log=log).mapInPandas(dies, SCHEMA)
    with pytest.raises(Exception, match="lost after its calls"):  # a local master doesn't try again: the job is started anew
        out.collect()
    got = {r.id: r for r in out.collect()}
    assert all(got[i].score == i for i in range(20) if i != 13) and got[13].error == "refused"
    made = [int(p.name.split("-")[0]) for p in calls.iterdir()]
    assert sorted(set(made)) == list(range(20)) and all(made.count(i) == 1 for i in range(20) if i != 13)
    # another model's answers are its own
    G.apply_model(rows, make, SCHEMA, 2, log=G.CallLog(f"file://{tmp_path}/log", "other")).collect()
    assert len(list(calls.iterdir())) >= 40


def test_a_pace_is_shared():
    now = [0.0]
    lock = threading.Lock()

    def sleep(seconds):
        with lock:
            now[0] += seconds

    pace = G.Pace(10, 2, lambda: now[0], sleep)  # 5 calls a second for each of two tasks
    for _ in range(11):
        pace()
    assert now[0] == pytest.approx(2.0)


def test_progress_on_the_driver(spark):
    progress = G.Progress(spark)
    out = G.apply_model(spark.range(40).select("id", F.lit("p").alias("prompt")).repartition(4), lambda: lambda row: {"score": 1.0}, SCHEMA, progress=progress)
    seen: list[int] = []
    with progress.watch(seen.append, 0.05):
        assert out.count() == 40
    with progress.watch(seen.append, 0.05):  # the same partitions again: they count once
        out.count()
    assert seen == sorted(seen) and seen[-1] == 40
    merged = G._Most().addInPlace({0: 5, 1: 2}, {0: 3, 2: 4})
    assert merged == {0: 5, 1: 2, 2: 4}
