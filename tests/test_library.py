"""Micro fixtures with known values, brute force, and properties."""

from __future__ import annotations

import inspect
import itertools
import json
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tandem.functions import stats
from tandem.functions import text as X
from tandem.operators import agreement as A
from tandem.operators import generate as G
from tandem.operators import lexical as L
from tandem.operators import metrics as C
from tandem.operators import ranking as R
from tandem.operators import scoring as S
from tandem.operators import shape as H
from tandem.plans import registry
from tandem.sources import io
from tandem.streaming.merge import Target, read_messages, stream_messages

DATA = "/root/testdata/sf0.001"


def one(frame):
    return frame.collect()[0]


def test_p_values():
    assert stats.kendall_exact_p(6, 0) == pytest.approx(0.0027778, abs=1e-6)
    assert stats.kendall_exact_p(6, 3) == pytest.approx(0.1361111, abs=1e-6)
    assert stats.kendall_exact_p(4, 1) == pytest.approx(1 / 3, abs=1e-6)
    # t = 2 with 10 degrees of freedom
    r = 2 / math.sqrt(10 + 4)
    assert stats.correlation_p(12, r) == pytest.approx(0.0733880, abs=1e-6)


def brute_bleu(docs):
    out = {}
    for key, hyp in docs.items():
        refs = [d for k, d in docs.items() if k != key and d]
        num = []
        for n in range(1, 5):
            grams = Counter(tuple(hyp[i : i + n]) for i in range(len(hyp) - n + 1))
            best = Counter()
            for ref in refs:
                for g, c in Counter(tuple(ref[i : i + n]) for i in range(len(ref) - n + 1)).items():
                    best[g] = max(best[g], c)
            num.append((sum(min(c, best[g]) for g, c in grams.items()), max(1, sum(grams.values()))))
        if num[0][0] == 0:
            out[key] = 0.0
            continue
        if len(hyp) < 2:
            out[key] = None
            continue
        inc, logs = 1, 0.0
        for a, b in num:
            if a == 0:
                a = 1 / (2**inc * 5 / math.log(len(hyp)))
                inc += 1
            logs += math.log(a / b) / 4
        ref = min((abs(len(r) - len(hyp)), len(r)) for r in refs)[1]
        out[key] = (1.0 if len(hyp) > ref else math.exp(1 - ref / len(hyp))) * math.exp(logs)
    return out


def test_self_bleu(spark):
    docs = {"a": "the cat sat on the mat".split(), "b": "the cat sat on a mat today".split(), "c": "dogs".split(), "d": "the".split(), "e": "a dog on the mat sat the the".split(), "f": "the cat sat on the mat".split()}
    frame = spark.createDataFrame([("m", k, v) for k, v in docs.items()], "model string, key string, tokens array<string>")
    got = {r.key: r.bleu for r in L.self_bleu(frame, ["model"], "key").collect()}
    want = brute_bleu(docs)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == (pytest.approx(want[k], abs=1e-9) if want[k] is not None else None)


def test_ttr_mattr(spark):
    frame = spark.createDataFrame([(1, "a a b b".split()), (2, []), (3, "a b a c".split())], "id int, tokens array<string>")
    got = {r.id: r.mattr for r in L.mattr(frame, ["id"], window=2).collect()}
    assert got == {1: pytest.approx(2 / 3), 2: 0.0, 3: 1.0}
    assert {r.id: r.t for r in frame.select("id", L.ttr(F.col("tokens")).alias("t")).collect()} == {1: 0.5, 2: 0.0, 3: 0.75}


def test_ttr_by_model(spark):
    import duckdb

    frame = spark.createDataFrame([("m", "a a b b".split()), ("m", "a b a c".split()), ("m", []), ("n", ["a"])], "model string, tokens array<string>")
    got = {r.model: tuple(r)[1:] for r in L.ttr_statistics(frame, ["model"]).collect()}
    assert got["m"] == pytest.approx((1.25 / 3, math.sqrt(0.4375 / 3), 0.0, 0.75, 0.5)) and got["n"] == (1.0, None, 1.0, 1.0, 1.0)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["agg_ttr_by_model"]).fetchall())
    rows = sorted(map(tuple, registry.queries()["agg_ttr_by_model"](spark, DATA).collect()))
    assert [r[0] for r in rows] == [w[0] for w in want]
    assert all(r[1:] == pytest.approx(w[1:], abs=2e-6) for r, w in zip(rows, want, strict=True))


def test_clean_and_names(spark):
    row = one(spark.range(1).select(X.clean(F.lit("Tere  [x] (y)  ok !"), X.PROFILES["et"]).alias("c"), X.file_parts(F.lit("convo_gpt-4.1-mini_en-us_20260127-143052")).alias("p"), X.file_language(F.lit("convo_a_b_et_20260127-143052.jsonl")).alias("l"), X.source_language(F.lit("x_en-us_y"), F.lit("x_en-us_y")).alias("s"), X.conversation_name(F.lit("m"), F.lit("et"), F.lit("d"), F.lit(3)).alias("i"), X.parse_labelled(F.lit("Agent: Tere!\nKlient: Hi: a"), ("Agent", "Klient")).alias("t"), *(X.size_bucket(F.lit(n)).alias(f"b{n}") for n in (999, 1000, 1_000_000))))
    assert row.c == "Tere    !"
    assert tuple(row.p) == ("gpt-4.1-mini", "en-us", "20260127-143052")
    assert (row.l, row.s, row.i) == ("et", "us", "m_et_d_0003")
    assert [tuple(t) for t in row.t] == [("Agent", "Tere!"), ("Klient", "Hi: a")]
    assert (row.b999, row.b1000, row.b1000000) == ("n<1K", "1K<n<10K", "n>1M")


def test_f1_kappa_ranks(spark):
    pairs = spark.createDataFrame([("x", t, p) for t, p in (("a", "a"), ("a", "b"), ("b", "b"), ("c", "d"))], "category string, y_true string, y_pred string")
    row = one(S.category_scores(pairs, ["category"]))
    assert (row.accuracy, row.macro_f1, row.weighted_f1) == (0.5, pytest.approx(1 / 3), 0.5)
    ratings = [("q", i, v) for i, values in enumerate(([1, 1, 1], [1, 2, 2], [2, 2, 2])) for v in values]
    frame = spark.createDataFrame(ratings, "rating_category_name string, conversation_id int, rating_value int")
    assert one(A.fleiss_kappa(frame)).kappa == pytest.approx(0.55)
    ranked = spark.createDataFrame([("k", lang, m, r) for lang, order in (("l1", "ABCD"), ("l2", "BACD")) for r, m in enumerate(order, 1)], "metric string, language string, model string, rank int")
    row = one(R.inversions(ranked))
    assert (row.pairs, row.inversions, row.tau, row.rho) == (6, 1, pytest.approx(2 / 3), pytest.approx(0.8))
    assert one(R.with_p_values(R.inversions(ranked))).tau_p == pytest.approx(1 / 3)
    assert one(R.permutation(ranked, 200)).p == pytest.approx(1.0, abs=0.99)
    means = spark.createDataFrame([(m, v) for m, v in zip("ABCD", (3.0, 2.0, 2.0, 1.0), strict=True)], "model string, mean double").withColumn("k", F.lit(1))
    assert [r["rank"] for r in R.average_ranks(means, ["k"], "mean").orderBy("model").collect()] == [1, 2.5, 2.5, 4]


def test_bootstrap_covers(spark):
    rows = [(lang, f"m{m}", "q", i, float(m * 10 + i % 3)) for lang in ("a", "b") for m in range(4) for i in range(8)]
    frame = spark.createDataFrame(rows, "language string, model string, metric string, conversation_id int, score double")
    first, again = one(R.bootstrap(frame, 40)), one(R.bootstrap(frame, 40))
    assert first == again and first.tau_low <= 1.0 <= first.tau_high + 1e-9


def test_ranks_of_replicates_against_plain_ones(monkeypatch):
    """Tau-b and rho of average ranks, with equal means, a model that one language lacks, and a side that doesn't vary."""
    rng = np.random.default_rng(2)
    rows = [("q", rep, lang, m, 1.0 if lang == "c" else float(rng.integers(0, 5))) for rep in range(7) for lang in "abc" for m in "uvwxyz" if (lang, m) != ("b", "v")]
    frame = pd.DataFrame(rows, columns=["metric", "rep", "language", "model", "mean"]).sample(frac=1, random_state=1)
    monkeypatch.setattr(R, "PAIRED", 60)  # replicates in several slices
    # sums of a block's replicates, of models of four rows in two chunks
    blocks = []
    for (lang, m), own in frame.groupby(["language", "model"]):
        sums = own.sort_values("rep")["mean"].to_numpy() * 4
        blocks += [("q", lang, m, sums * 0.25, 4), ("q", lang, m, sums * 0.75, 4)]
    got = R._rank_pairs(pd.DataFrame(blocks, columns=["metric", "language", "model", "sums", "total"]))
    assert len(got) == 3 * 7 and got[got["l2"] == "c"][["tau", "rho"]].isna().all().all()
    mine = got[got["l2"] == "b"]
    for rep, (tau, rho) in enumerate(zip(mine["tau"], mine["rho"], strict=True)):
        wide = frame[frame["rep"] == rep].pivot(index="model", columns="language", values="mean")[["a", "b"]].dropna()
        signs = [(np.sign(x.a - y.a), np.sign(x.b - y.b)) for i, x in enumerate(wide.itertuples()) for y in list(wide.itertuples())[i + 1 :]]
        a, b = (np.array(x) for x in zip(*signs, strict=True))
        assert tau == pytest.approx((a * b).sum() / np.sqrt((a != 0).sum() * (b != 0).sum()))
        assert rho == pytest.approx(wide["a"].rank().corr(wide["b"].rank()))


def test_resampling_queries_do_the_whole_job(spark, monkeypatch):
    calls = {}

    def spy(name, many, few):
        real = getattr(R, name)

        def call(frame, *args, **named):
            bound = inspect.signature(real).bind(frame, *args, **named)
            bound.apply_defaults()
            calls[name] = bound.arguments[many]
            return real(frame, **{many: few})

        monkeypatch.setattr(R, name, call)

    spy("bootstrap", "replicates", 20)
    spy("permutation", "permutations", 20)
    for query in ("stat_bootstrap", "stat_permutation"):
        assert {r.metric for r in registry.queries()[query](spark, DATA).collect()} == {"quality", "toxic", "length"}
    assert calls == {"bootstrap": 2000, "permutation": 5000}


def test_histogram_and_merge(spark):
    scores = spark.createDataFrame([("m", "C", s) for s in (0, 2, 2)], "model string, metric string, score int")
    assert [r.n for r in S.score_histogram(scores, {"C": 3}).orderBy("score").collect()] == [1, 0, 2, 0]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), spark.createDataFrame([(2, "z"), (3, "c")], "id int, x string")
    merged = H.merge_new(old, new, ["id"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, H.merge_new(merged, new, ["id"]).collect())) == sorted(map(tuple, merged.collect()))


def test_files_round_trip(spark, tmp_path):
    lines = [{"subject": "s", "model": "g", "messages": [{"from_name": "A", "from_type": "agent", "message": "hi"}], "_metadata": {"language": "et", "industry": "x"}}, {"subject": "t", "messages": []}]
    path = tmp_path / "convo_g_et_20260127-143052.jsonl"
    path.write_text(json.dumps(lines[0]) + "\n\n{broken\n" + json.dumps(lines[1]) + "\n")
    rows = io.read_conversations(spark, str(path))
    assert [r.conversation_id for r in rows.orderBy("conversation_id").collect()] == ["g_et_20260127-143052_0000", "g_et_20260127-143052_0001"]
    assert H.flatten(rows).count() == 1
    grouped = tmp_path / "combined_et.json"
    grouped.write_text(json.dumps({"g": lines}))
    got = io.read_grouped(spark, str(grouped)).orderBy("conversation_id").collect()
    assert [(r.generator_model, r.conversation_id, r.conversation.subject) for r in got] == [("g", 0, "s"), ("g", 1, "t")]
    truth = tmp_path / "gt.json"
    truth.write_text(json.dumps([{"ticket_id": "id_7", "config": {"industry": "a"}}, {"config": {"industry": "b"}}]))
    assert {r.conversation_id: r.industry for r in io.read_ground_truth(spark, [str(truth)], "A").collect()} == {"7": "a", "1": "b"}
    assert {r.industry for r in io.read_ground_truth(spark, [str(grouped)], "D").collect()} == {"x", ""}


def test_models_and_configs(spark):
    configs = G.sample_configs(spark, 4000, {"language": ["et", "fi"]}, ["A", "B"])
    share = configs.where("n_messages = 4").count() / 4000
    assert abs(share - 0.4) < 0.04
    rows = spark.createDataFrame([(i,) for i in range(6)], "id long")

    def make():
        def call(row):
            if row["id"] % 2:
                raise ValueError("bad row")
            return {"score": int(row["id"])}

        return call

    out = {r.id: (r.score, r.error) for r in G.apply_model(rows, make, "id long, score double, error string, processing_time double", 2).collect()}
    assert out[2] == (2.0, None) and out[3] == (None, "bad row") or math.isnan(out[3][0])
    calls = itertools.count()
    waits = []

    def limited():
        if next(calls) < 2:
            raise RuntimeError("429")
        return 1

    assert G.with_retry(limited, sleep=waits.append)() == 1 and len(waits) == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = json.dumps({"conversation_id": "a", "message_id": 1, "message": "x"})
    (tmp_path / "in/1.json").write_text(row + "\n" + row + "\n")
    target = str(tmp_path / "out")
    go = lambda: stream_messages(spark, str(tmp_path / "in"), "conversation_id string, message_id int, message string", target, str(tmp_path / "cp")).awaitTermination(60)
    go()
    (tmp_path / "in/2.json").write_text(row + "\n" + row.replace('"a"', '"b"') + "\n")
    go()
    assert read_messages(spark, target).count() == 2


def test_a_batch_that_died_half_written_is_replayed_once(spark, tmp_path, monkeypatch):
    frame = lambda *ids: spark.createDataFrame([(i, 1, f"m{i}") for i in ids], "conversation_id string, message_id int, message string")
    target = Target(spark, str(tmp_path / "table"))
    assert target.read() is None
    target.append(frame("a", "b", "a"), 0)

    def die(self, batch):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:  # rows and bits are written, the manifest isn't
        patch.setattr(Target, "commit", die)
        with pytest.raises(RuntimeError):
            target.append(frame("b", "c", "x"), 1)
    read = lambda: sorted(r.conversation_id for r in read_messages(spark, target.path).collect())
    assert read() == ["a", "b"]
    target.append(frame("b", "c"), 1)  # the replay has other rows than the dead try
    assert read() == ["a", "b", "c"]
    target.append(frame("d"), 1)  # a batch that is there isn't written again
    target.append(frame("a", "c", "e"), 2)
    assert read() == ["a", "b", "c", "e"] and len(target.manifests()) == 3
    # another stream has batches of its own; keys are new only once over all streams
    Target(spark, target.path, "other").append(frame("e", "f"), 1)
    assert read() == ["a", "b", "c", "e", "f"]
    assert sorted(r.conversation_id for r in target.fresh(frame("f", "g")).collect()) == ["g"]


def test_bleu_checks(spark):
    rows = [("ok", "a", "the cat sat there"), ("ok", "b", "the cat sat here"), ("ok", "c", "the cat sat here"), ("blank", "a", "one two three"), ("blank", "b", " "), ("blank", "c", None), ("few", "a", "only one text")]
    frame = spark.createDataFrame(rows, "g string, key string, text string")
    got = {r.g: r for r in L.checked_bleu(frame, ["g"], X.Profile()).collect()}
    assert got["ok"].failure is None and got["ok"].num_duplicates == 1 and 0 < got["ok"].min <= got["ok"].self_bleu <= got["ok"].max
    assert got["blank"].failure == "too many empty texts" and got["blank"].self_bleu is None and got["blank"].num_empty == 2
    assert got["few"].failure == "fewer than two valid texts"
    with pytest.raises(ValueError):
        L.checked_bleu(frame, ["g"], X.Profile(), 5)
    want = brute_bleu({"a": "the cat sat there".split(), "b": "the cat sat here".split(), "c": "the cat sat here".split()})
    assert got["ok"].self_bleu == pytest.approx(sum(want.values()) / 3)


def test_bleu_levels(spark):
    turns = [("Agent A", "hello you", True), ("Klient", "hi", None), ("Agent A", "bye now", True), ("x", "  ", True)]
    frame = spark.createDataFrame([("m", 1, turns)], "model string, conversation_id long, turns array<struct<speaker: string, text: string, is_agent: boolean>>")
    et = {(r.level, r.text) for r in L.level_texts(frame, X.PROFILES["et"], ["model"]).where("level <> 'full'").collect()}
    assert et == {("agent", "hello you"), ("agent", "bye now"), ("client", "hi"), ("turns", "hello you"), ("turns", "bye now"), ("turns", "hi")}
    fi = {(r.level, r.text) for r in L.level_texts(frame, X.PROFILES["fi"], ["model"]).where("level <> 'full'").collect()}
    assert fi == {("agent", "hello you bye now"), ("client", "hi")}


def test_columns_by_alias(spark):
    frame = spark.createDataFrame([("m", 0.5, 1.0)], "model_name string, type_token_ratio double, mattr double")
    assert one(C.diversity_statistics(frame)).mean_ttr == 0.5
    for bad, names in ((frame.drop("mattr"), ["ttr", "mattr"]), (frame.drop("model_name"), ["ttr"])):
        with pytest.raises(ValueError):
            C.resolve(bad, names)
    with pytest.raises(ValueError):
        C.first_by_model(frame, ["avg_similarity"], "mattr")


def test_clients_and_embeddings(spark, monkeypatch):
    config = G.ClientConfig("m", "org", key_variable="TANDEM_TEST_KEY")
    assert config.name == "org/m" and G.ClientConfig("org/m", "org").name == "org/m" and "key" not in repr(config).replace("key_variable", "")
    configure = lambda spark, n: G.sample_configs(spark, n, {"language": ["et"]}, ["A"])
    prompt = lambda rows: X.config_prompt({"language": rows["language"], "n_messages": rows["n_messages"]})
    make = G.client(config, lambda prompt, key, config: json.dumps({"score": len(prompt) % 9}))
    rows = G.generated(spark, 20, configure, prompt, make, "id long, prompt string, score double, error string, processing_time double", check=G.within({"score": 4})).collect()
    for r in rows:
        expected = len(r.prompt) % 9
        assert r.prompt.startswith("- Language: Estonian (et)\n") and (r.score == expected if expected <= 4 else "must be" in r.error)
    texts = spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string")
    assert {r.id: r.embedding for r in G.embedded(texts, "t", lambda: lambda batch: [[float(len(t))] for t in batch]).collect()} == {1: [2.0], 2: [0.0]}


def test_pluggable_tokenizer(spark):
    frame = spark.createDataFrame([("Cats x ran 9",)], "t string")
    own = X.pluggable_tokens(lambda: lambda text: text.replace("s", "").split(), ("ran",))
    assert one(frame.select(own(F.col("t")).alias("w"))).w == ["cat"]

    def absent():
        raise ImportError("no such model")

    assert one(frame.select(X.pluggable_tokens(absent, (), 2)(F.col("t")).alias("w"))).w == ["cats", "ran"]
    assert X.parse_languages("et, FI,et", ("et", "fi")) == ["et", "fi"]
    for bad in ("", "xx"):
        with pytest.raises(ValueError):
            X.parse_languages(bad, ("et",))


def test_bootstrap_in_chunks(spark, monkeypatch):
    """Means of resampled rows, drawn in several chunks, spread as those drawn at once."""
    monkeypatch.setattr(R, "CHUNK", 50)
    rows = [(lang, m, "q", i, float((i * k) % 17)) for lang in ("a", "b") for k, m in ((1, "x"), (3, "y"), (5, "z")) for i in range(300)]
    frame = spark.createDataFrame(rows, "language string, model string, metric string, conversation_id int, score double")
    got = one(R.bootstrap(frame, 200))
    assert got.tau_low <= got.tau_mean <= got.tau_high and -1 <= got.rho_low <= got.rho_high <= 1 and got == one(R.bootstrap(frame, 200))


def test_commands(spark, tmp_path):
    from tandem import cli

    for lang in ("et", "fi"):
        lines = [{"conversation_id": i, "generator_model": f"m{m}", "judge_model": "j", "G": (i + m) % 5, "R": m, "source_file": f"combined_{lang}.json"} for i in range(6) for m in range(3)]
        (tmp_path / f"judge_{lang}.jsonl").write_text("\n".join(map(json.dumps, lines)))
        talk = {"subject": "s", "model": "g", "messages": [{"from_name": n, "from_type": t, "message": f"{n} says {lang}"} for n, t in (("A", "agent"), ("B", "customer"))], "_metadata": {"language": lang}}
        (tmp_path / f"convo_g_{lang}_20260127-143052.jsonl").write_text(json.dumps(talk) + "\n" + json.dumps(talk) + "\n")
    go = lambda *a: cli.run(spark, cli.parser().parse_args([*a]))
    ranked = go("rank", f"{tmp_path}/judge_*.jsonl", "--bootstrap", "20", "--permutations", "20", "--output", f"{tmp_path}/analysis.json")
    assert {(r.metric, r.l1, r.l2) for r in ranked.collect()} == {("G", "et", "fi"), ("R", "et", "fi")}
    assert io.read_analysis(spark, f"{tmp_path}/analysis.json", "metric: string, tau: double").count() == 2
    assert {(r.language, r.n) for r in go("combine", f"{tmp_path}/convo_*.jsonl", "--output", str(tmp_path / "out")).collect()} == {("et", 2), ("fi", 2), (None, 4)}
    assert io.read_grouped(spark, f"{tmp_path}/out/combined_mixed").count() == 4
    spark.sparkContext.setJobGroup("dry", "dry")
    try:  # a dry run starts no job
        shown = [go("--dry-run", *a) for a in (("combine", f"{tmp_path}/convo_*.jsonl"), ("rank", f"{tmp_path}/judge_*.jsonl"), ("metrics", f"{tmp_path}/out/combined_mixed", "--language", "et"))]
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("dry")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r.part, r.model, r.language, r.rows) for r in shown[0][:2]] == [("files", "g", "et", 1), ("files", "g", "fi", 1)]
    assert all(r.bytes > 0 for rows in shown for r in rows if r.part in ("input", "result"))
    assert {(r.model, r.metric, r.n) for r in go("judge", f"{tmp_path}/judge_*.jsonl").collect()} == {(f"m{m}", k, 12) for m in range(3) for k in "GR"}
    table = go("metrics", f"{tmp_path}/out/combined_mixed", "--language", "et", "--output", str(tmp_path / "m.csv"))
    assert one(table).conversations == 4 and io.read_csv(spark, str(tmp_path / "m.csv")).count() == 4
    with pytest.raises(ValueError):
        go("combine", f"{tmp_path}/absent_*")


def test_decimals_are_those_of_python(spark):
    values = [0.845, 8.495, 2.985, 0.125, 0.375, -0.125, 1.005, 2.675, -0.001, 0.0, 123456.785, 1e11 + 0.125, 5e-324, float("nan"), float("inf"), float("-inf")]
    values += [(2 * i + 1) / 200 for i in range(2000)]
    got = spark.createDataFrame(list(enumerate(values)), "i long, x double").select("i", X.fixed(F.col("x")).alias("x"), X.mean_std(F.col("x"), F.col("x") / 3).alias("s")).orderBy("i").collect()
    assert [r.x for r in got] == [f"{v:.2f}" for v in values]
    assert [r.s for r in got] == [f"{v:.2f}±{v / 3:.2f}" for v in values]


def test_layers_of_n_grams_of_many_texts():
    """A word that all of a slice's texts hold is one row for each time it stands in them, not a row a text."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 6, rng.integers(0, 9)).tolist() for _ in range(200)]
    sizes = np.array(list(map(len, texts)), np.int64)
    tokens = np.array([t for text in texts for t in text], np.uint64)
    group = np.array([i % 2 for i in range(len(texts))], np.uint64)
    doc = rng.permutation(len(texts)).astype(np.int64)
    for n in range(1, 5):
        code, many, least = L.gram_layers(tokens, sizes, group, doc, n)
        want = {}
        for i, text in enumerate(texts):
            for gram, c in Counter(tuple(text[j : j + n]) for j in range(len(text) - n + 1)).items():
                for t in range(c):
                    want.setdefault((i % 2, gram, t), []).append(int(doc[i]))
        assert len(set(code.tolist())) == len(code) == len(want)
        assert sorted(zip(many.tolist(), least.tolist())) == sorted((len(d), min(d)) for d in want.values())
    assert not len(L.gram_layers(tokens[:0], np.zeros(2, np.int64), group[:2], doc[:2], 1)[0])


def test_levels_read_each_text_once(spark):
    """The texts go to a task once, however many statistics are asked of them."""
    reads = spark.sparkContext.accumulator(0)

    def seen(text):
        reads.add(1)
        return text

    texts = spark.createDataFrame([("g", str(i), f"word w{i} more w{i % 3}") for i in range(20)] + [("g", "x", "word w1 more w1")], "g string, key string, text string")
    texts = texts.withColumn("text", F.udf(seen, "string").asNondeterministic()("text")).withColumn("tokens", X.tokens(F.col("text")))
    (row,) = L.checked_token_bleu(texts, ["g"]).collect()
    assert (row.num_texts, row.num_empty, row.num_duplicates, row.failure) == (21, 0, 1, None) and reads.value == 21
