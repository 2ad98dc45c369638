"""The pipeline, stage by stage, against brute force on its own input, with nulls, repeats, long texts, clashing columns and empty tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from test_minhash import brute as brute_groups
from test_models_packing import brute_contamination, tokenizer  # noqa: F401

ENGLISH = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split()


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        words, lang = ((ENGLISH, "en"), (GERMAN, "de"))[i % 2]
        rows.append((i + 10, " ".join(rng.choices(words, k=rng.randint(5, 160))), lang))
    passage = " ".join(rng.choices(ENGLISH, k=130))
    items = [(1, " ".join(rng.choices(GERMAN, k=20))), (2, "said if do"), (3, None), (4, "")]
    rows += [(100 + i, rows[i][1] + " extra" * (i % 3), rows[i][2]) for i in range(12)]  # copies and near copies
    rows += [(200 + i, " ".join(rng.choices(ENGLISH, k=60)) + " " + passage, "en") for i in range(4)]  # a shared passage
    rows += [(300 + i, " ".join(rng.choices(GERMAN, k=40 * i)) + " " + items[0][1], "de") for i in range(1, 5)]  # benchmark text
    rows += [(400, None, "en"), (401, "", None), (402, "12 !?", "de"), (None, rows[3][1] + " null id", None), (403, "é" * 300 + passage[:50], "en")]
    rows += [(404, " ".join(rng.choices(ENGLISH, k=30_000)), "en")] + [(405, "the same row twice and twice again", "en")] * 2
    return rows, items


def stages_by_hand(rows, items):
    """What each stage keeps, as (doc_id, text), computed from what the one before it kept."""
    rows = [(d, t) for d, t, _ in rows if t and any(c.isalpha() for c in t)]
    yield rows
    kept = {r[0] for r in brute_groups(rows, 5) if r[3]}
    out = []
    for row in rows:
        if row[0] in kept and row not in out:
            out.append(row)
    yield out
    removed = []
    data = [t.encode() for _, t in out]
    count: dict = {}
    for x in data:
        for i in range(len(x) - 399):
            count[x[i : i + 400]] = count.get(x[i : i + 400], 0) + 1
    for (d, _), x in zip(out, data, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 399):
            if count[x[i : i + 400]] > 1:
                gone[i : i + 400] = True
        removed.append((d, np.frombuffer(x, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    yield removed
    yield [row for row in removed if not brute_contamination([row], items)[0][4]]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, items = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    frame = spark.createDataFrame([(d, t, lang, "s", len(t or ""), i, "x") for i, (d, t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row long, k1 string")
    frame.drop("row").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_each_stage_on_what_the_one_before_kept(spark, made, tokenizer):  # noqa: F811
    path, rows, items = made
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], stages_by_hand(rows, items), strict=True):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str), name
        assert all(r.n_chars == len(r.text) for r in got)
        docs = spark.createDataFrame(got, out.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    expected = []
    for d, t in want:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        expected += [(d, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)]
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces), key=str) == sorted(expected, key=str)
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole), key=str) == sorted(expected, key=str)


def test_suffix_stage_takes_passages_of_over_50_words(spark):
    """A passage of 55 words, under 400 bytes, that four documents share goes from all; the others stay as they are."""
    rng = random.Random(5)
    prose = lambda k: " ".join(rng.choices(ENGLISH, k=k))
    passage, short = prose(55), prose(45)
    assert len(passage) < 400
    around = [(f"{prose(70)} before{i}", f"after{i} {prose(80)}") for i in range(4)]
    rows = [(i, f"{a} {passage} {b}", -1) for i, (a, b) in enumerate(around)] + [(10 + i, f"{prose(60)} {short} {prose(20)}", -1) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.suffix_stage(spark, docs, "").collect()}
    assert all(passage not in got[i].text and got[i].text == f"{a}  {b}" for i, (a, b) in enumerate(around))
    assert all(got[d].text == t for d, t, _ in rows if d >= 10) and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_empty_tables(spark, made, tmp_path):
    path = made[0]
    for kind, docs, items in (("docs", 0, 10), ("items", 100, 0), ("both", 0, 0)):
        spark.read.parquet(f"{path}/documents.parquet").limit(docs).write.parquet(f"{tmp_path}/{kind}/documents.parquet")
        spark.read.parquet(f"{path}/benchmark.parquet").limit(items).write.parquet(f"{tmp_path}/{kind}/benchmark.parquet")
        assert (corpus_pipeline.run(spark, f"{tmp_path}/{kind}").count() > 0) == bool(docs)
