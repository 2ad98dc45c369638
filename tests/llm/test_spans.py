"""Suffix-array dedup (bytes) and phrase dedup (words) against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tandem.llm import kernels as K
from tandem.llm import phrase_dedup, spans, suffix_dedup
from tandem.llm.phrase_dedup import dedup_phrases, phrase_digest
from tandem.llm.queries import queries
from tandem.llm.suffix_dedup import dedup_texts, suffix_digest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_bytes(rows, window):
    starts = defaultdict(int)
    data = [(t or "").encode() for _, t in rows]
    for x in data:
        for i in range(len(x) - window + 1):
            starts[x[i : i + window]] += 1
    out = []
    for (doc, _), x in zip(rows, data, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - window + 1):
            if starts[x[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans_ = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(x), sum(gone), spans_, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, window):
    least = {}
    words = [(d, WORD.findall((t or "").encode())) for d, t in rows]
    for d, ws in words:
        for i in range(len(ws) - window + 1):
            if d is not None:
                key = tuple(ws[i : i + window])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, ws in words:
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if d is not None and least[tuple(ws[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((d, len(ws), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefé", k=rng.randint(1, 6))) for _ in range(400)]
    passage = [" ".join(rng.choices(vocabulary, k=k)) for k in (70, 120, 40, 200)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(passage) if rng.random() < 0.4 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 150))))
        rows.append((i * 3 % n, rng.choice([" ", "\n", "\t  "]).join(parts)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1001, rows[5][1]), (1002, None), (1003, ""), (None, rows[6][1]), (1004, "x " * 300), (1005, "x " * 301), (1006, "aaaa" * 300), (1007, passage[3] + " q " + passage[3]), (-5, rows[8][1])]
    return rows


@pytest.mark.parametrize("hot", [1024, 3])
@pytest.mark.parametrize("seed", [3, 4])
def test_against_brute_force(spark, monkeypatch, hot, seed):
    monkeypatch.setattr(spans, "HOT", hot)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffix_digest(docs).collect()), key=str) == brute_bytes(rows, 400)
    assert sorted(map(tuple, phrase_digest(docs).collect()), key=str) == brute_words(rows, 50)


def test_texts_and_clashing_columns(spark):
    rows = [(i, t, "x", 1) for i, t in corpus()[:12]] + [(99, "é" * 500, None, 2), (98, "é" * 500, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut string, k1 long")
    out = dedup_texts(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert {r.text for r in out.where("doc_id in (98, 99)").collect()} == {""}
    kept = dedup_phrases(docs)
    assert kept.count() == len(rows) and kept.columns == docs.columns


def brute_texts(rows, window, words):
    """Texts without the bytes of windows of bytes, or of words, that start at two places."""
    starts = defaultdict(int)
    data = [(t or "").encode() for _, t in rows]
    found = [[(m.start(), m.end(), m.group()) for m in WORD.finditer(x)] for x in data]
    for x, ws in zip(data, found, strict=True):
        for i in range(len(x) - window + 1):
            starts[x[i : i + window]] += 1
        for i in range(len(ws) - words + 1):
            starts[tuple(w for _, _, w in ws[i : i + words])] += 1
    out = []
    for (doc, text), x, ws in zip(rows, data, found, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - window + 1):
            if starts[x[i : i + window]] > 1:
                gone[i : i + window] = True
        for i in range(len(ws) - words + 1):
            if starts[tuple(w for _, _, w in ws[i : i + words])] > 1:
                gone[ws[i][0] : ws[i + words - 1][1]] = True
        out.append((doc, text if text is None else np.frombuffer(x, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1024, 3])
@pytest.mark.parametrize("seed", [3, 4])
def test_passages_of_words_against_brute_force(spark, monkeypatch, hot, seed):
    """Passages of fifty words and more go whatever their bytes; some are under the 400 bytes of the other windows."""
    monkeypatch.setattr(spans, "HOT", hot)
    rng = random.Random(seed)
    words = lambda k: ["".join(rng.choices("abcdé", k=rng.randint(1, 5))) for _ in range(k)]
    passages = {k: words(k) for k in (49, 50, 53, 60, 90)}
    assert all(len(" ".join(p).encode()) < 400 for k, p in passages.items() if k <= 60)
    rows = [(i, " ".join(words(40) + passages[k] + words(30))) for i, k in enumerate([*passages] * 3)]
    rows += corpus(seed, 20) + [(2000, " ".join(words(9) + passages[53] + words(9) + passages[53])), (2001, "\n".join(passages[50])), (2002, "x " * 49), (None, " ".join(passages[60])), (2003, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_texts(rows, 400, 50)
    assert sorted(map(tuple, dedup_texts(docs, words=50).collect()), key=str) == expected
    assert sorted(map(tuple, dedup_texts(docs).collect()), key=str) == brute_texts(rows, 400, 10**9) != expected
    assert dedup_texts(docs.limit(0), words=50).count() == 0


def brute_passages(rows, words):
    """By row: the bytes under windows of so many words that start at two places."""
    starts = defaultdict(int)
    found = [[(m.start(), m.end(), m.group()) for m in WORD.finditer((t or "").encode())] for _, t in rows]
    for ws in found:
        for i in range(len(ws) - words + 1):
            starts[tuple(w for _, _, w in ws[i : i + words])] += 1
    out = []
    for (_, text), ws in zip(rows, found, strict=True):
        gone = np.zeros(len((text or "").encode()), bool)
        for i in range(len(ws) - words + 1):
            if starts[tuple(w for _, _, w in ws[i : i + words])] > 1:
                gone[ws[i][0] : ws[i + words - 1][1]] = True
        out.append(int(gone.sum()))
    return out


@pytest.mark.parametrize("hot", [1024, 3])
def test_query_counts_passages_of_words_beside_its_bytes(spark, monkeypatch, tmp_path, hot):
    """Planted passages of 50 to 60 words, under 400 bytes: the contract's columns leave them, the last column has them."""
    monkeypatch.setattr(spans, "HOT", hot)
    rng = random.Random(6)
    words = lambda k: ["".join(rng.choices("abcdé", k=rng.randint(1, 5))) for _ in range(k)]
    passages = {k: words(k) for k in (50, 52, 60)}
    assert all(len(" ".join(p).encode()) < 400 for p in passages.values())
    planted = [(i, " ".join(words(40) + passages[k] + words(30))) for i, k in enumerate([*passages] * 3)]
    clean = [(100 + i, " ".join(words(130))) for i in range(9)] + [(200 + i, " ".join(words(40) + passages[60][:49] + words(30))) for i in range(2)]
    rows = planted + clean + [(3000 + i, t) for i, (_, t) in enumerate(corpus(7, 15))] + [(4000, "\n".join(passages[50])), (4001, "  ")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries()["op3_suffix_dedup"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"]
    got = sorted(map(tuple, out.collect()), key=str)
    by_bytes = {r[0]: r for r in brute_bytes(rows, 400)}
    assert len(by_bytes) == len(rows)
    assert got == sorted(((*by_bytes[d], n) for (d, _), n in zip(rows, brute_passages(rows, 50), strict=True)), key=str)
    found = {r[0]: (r[2], r[5]) for r in got}
    assert all(found[d][0] == 0 < found[d][1] for d, _ in planted) and all(found[d] == (0, 0) for d, _ in clean)


def test_suffixes_that_are_given_twice():
    """A suffix given twice repeats itself and makes others repeat."""
    rng = np.random.default_rng(9)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    for depth in (5, 8, 19):
        starts = rng.integers(0, 400 - depth, 300)
        starts = np.r_[starts, starts[:90]]
        group = np.r_[rng.integers(0, 9, 300), np.zeros(90, np.int64)]
        group[300:] = group[:90]
        known = defaultdict(int)
        for s, g in zip(starts.tolist(), group.tolist(), strict=True):
            known[g, data[s : s + depth].tobytes()] += 1
        expected = [known[g, data[s : s + depth].tobytes()] > 1 for s, g in zip(starts.tolist(), group.tolist(), strict=True)]
        assert suffix_dedup.radix_repeats(data, starts, group, depth).tolist() == expected
    assert not len(suffix_dedup.radix_repeats(data, starts[:0], group[:0], 8))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_digest(docs).count() == 0 and phrase_digest(docs).count() == 0


def test_more_segments_of_an_anchor_than_one_task_takes(spark):
    """A passage in 1,300 surroundings: its anchors have more differing segments than ``HOT``."""
    rng = random.Random(8)
    text = lambda k: "".join(rng.choices("abcdefghij ", k=k))
    passage = text(430)
    rows = [(i, text(120) + passage + text(120)) for i in range(1300)] + [(5000, text(300) + passage[:300])]
    assert len(rows) > spans.HOT
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_removed for r in suffix_digest(docs).collect()}
    assert got.pop(5000) == 0 and min(got.values()) >= 430
    assert sorted(map(tuple, suffix_digest(docs).collect()), key=str) == brute_bytes(rows, 400)


def test_long_text_is_cut_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 700, 700, 4100, 4300, 5000])
    whole = K.anchors(data, offsets, 400, 32)
    monkeypatch.setattr(K, "PIECE", 900)
    pieces = K.anchors(data, offsets, 400, 32)
    by_window = lambda x: sorted((r, s, at, int(h)) for r, a, b, at, h in zip(*x, strict=True) for s in range(a, b + 1))
    assert by_window(whole) == by_window(pieces)


def segments(texts, anchors, copies, words):
    """A kernel's input: the segments of anchors, sorted."""
    units = spans.Units(words, 50, 8) if words else spans.Units(False, 400, 32)
    rows = []
    for i, (text, anchor, n) in enumerate(zip(texts, anchors, copies, strict=True)):
        data = np.frombuffer(text.encode(), np.uint8)
        tokens, _ = units.tokens(data, np.array([0, len(data)]))
        rows.append({"anchor": anchor, "g1": i, "g2": i, "n": n, "md": i, "rel": 0, "content": units.raw(data, tokens).tobytes()})
    return pa.Table.from_pylist(rows, pa.schema([*((c, pa.int64()) for c in ("anchor", "g1", "g2", "n", "md")), ("rel", pa.int32()), ("content", pa.binary())])), units


def test_nothing_is_found_without_the_method(monkeypatch):
    """Every removed byte or word comes out of the radix passes or the automata: a segment met by its copies as well."""
    text = " ".join(f"w{i}" for i in range(140))
    for words, kernel in ((False, suffix_dedup.byte_kernel), (True, phrase_dedup.phrase_kernel)):
        table, units = segments([text, text + " z", "q " * 300], [1, 1, 2], [1, 1, 3], words)
        found = kernel(table, units)
        assert set(found["g1"].tolist()) == {0, 1, 2}
        with monkeypatch.context() as gone:
            gone.setattr(suffix_dedup, "radix_repeats", lambda data, starts, group, depth: np.zeros(len(starts), bool))
            gone.setattr(phrase_dedup.ahocorasick, "Automaton", lambda kind: type("Silent", (), {"add_word": lambda *a: None, "make_automaton": lambda *a: None, "iter": lambda *a: ()})())
            assert not len(kernel(table, units)["g1"])


def test_repeated_rows_of_a_hot_anchor_are_one(spark, monkeypatch):
    """Rows that repeat give a segment again and again: its runs are found once, so they don't meet every copy in turn."""
    monkeypatch.setattr(spans, "HOT", 3)
    text = " ".join(f"w{i}" for i in range(140))
    table, units = segments([text, text + " z"], [1, 1], [20, 20], False)
    found = spark.createDataFrame([tuple(r.values()) for r in table.to_pylist()] * 20, spans.CONTENT)
    runs = spans._settle(spans.Scratch(spark, "test"), found, units, suffix_dedup.byte_kernel, 2000)
    assert runs.count() == runs.distinct().count() > 0
    rows = [(None, text)] * 30 + [(1, text), (2, "x " + text), (3, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_digest(docs).collect()), key=str) == brute_bytes(rows, 400)
    assert sorted(map(tuple, phrase_digest(docs).collect()), key=str) == brute_words(rows, 50)
