"""Packing, language ID, toxicity, decontamination and the pipeline on small tables and edge cases."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.llm import language_id, packing, toxicity
from tandem.llm.decontaminate import contamination_digest, decontaminate

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def known():
    import public_tokenizers

    return packing.words(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcXYZ éßIŻİſ'’.,!?0123²½_<|>\n\t  \x1cstrvemlld")), max_size=60))
def test_ids_are_the_tokenizers(tokenizer, known, text):
    assert known.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_strings(tokenizer, known):
    for text in ("a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|", "it's we'll I'VE"):
        assert known.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_first_fit_decreasing(sizes):
    sizes = np.array(sizes)
    bins, offsets = packing.first_fit_decreasing(sizes, 64)
    room, want = [], np.zeros(len(sizes), int)
    for i in np.argsort(-sizes, kind="stable"):
        spot = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if spot == len(room):
            room.append(64)
        room[spot] -= sizes[i]
        want[i] = spot
    assert bins.tolist() == want.tolist()
    for b in set(bins.tolist()):
        own = sorted(zip(offsets[bins == b], sizes[bins == b], strict=True))
        assert [int(o) for o, _ in own] == [0, *np.cumsum([s for _, s in own])[:-1].tolist()]


def test_packing_covers_all_ids(spark, tokenizer):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "Ünder", "x1", "don't", "日本", "á"], k=rng.choice([0, 3, 50, 900, 5000])))) for i in range(40)]
    rows += [(100, None), (101, ""), (5, rows[5][1]), (5, rows[5][1]), (None, "null id")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), group_tokens=30_000).collect()
    want = []
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(d, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out), key=str) == sorted(want, key=str)
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own[:-1], own[1:], strict=True)) and own[0][0] == 0 and own[-1][0] + own[-1][1] <= 4096


def phrases(text, own):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in own:
            j += 1
        n, i = n + 1, j
    return n


def test_packing_of_no_rows_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, length string")
    assert packing.pack(empty).collect() == []
    one = spark.createDataFrame([(1, "word " * 9000, "x", 3)], "doc_id long, text string, length string, grp int")
    rows = sorted(packing.pack(one).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [0, 4096, 8192] and sum(r.length for r in rows) == rows[0].doc_tokens == 9001


def test_automaton_and_entropy():
    text = "abcabxabcd"
    table = language_id.suffix_automaton([ord(c) - 97 for c in text])
    subs = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    for s in subs | {"abd", "xx", "dc", "cabx"}:
        state = 0
        for c in s:
            state = table[state].get(ord(c) - 97, -1) if state >= 0 else -1
        assert (state >= 0) == (s in subs)
    model = language_id.Model({"a": "abab cdcd", "b": "xyxy zwzw"})

    for t in ("abab", "abxyab", "ababcdcd"):
        got = model.entropies([t, "x"])[0]
        assert got == pytest.approx([phrases(t, own) * np.log2(9) / len(t) for own in ("abab cdcd", "xyxy zwzw")])


@pytest.mark.parametrize("letters", [40, 62, 63, 64, 500, 3000])
def test_large_alphabets_are_told_apart(letters):
    rng = random.Random(letters)
    alphabet = [chr(0x4E00 + i) for i in range(letters)]
    texts = {lang: "".join(rng.choices(own, k=900)) for lang, own in (("a", alphabet[: letters // 2]), ("b", alphabet[letters // 3 :]), ("c", alphabet))}
    model = language_id.Model(texts)
    samples = [texts[x][i : i + 40] + y for x in "abc" for i in (0, 333) for y in ("", "q", alphabet[0], alphabet[-1] * 3)] + ["qq", alphabet[5] * 4]
    want = [[phrases(t, texts[lang]) * np.log2(900) / len(t) for lang in "abc"] for t in samples]
    assert model.entropies(samples) == pytest.approx(np.array(want))


def test_more_languages_than_sixty_four(spark):
    rng = random.Random(4)
    words = {f"l{i:02}": ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(30)] for i in range(70)}
    rows = [(n, " ".join(rng.choices(words[lang], k=60)), lang) for n, lang in enumerate([*words] * 8)]
    rows += [(10_000, rows[0][1] * 2000, "l00")] * 3  # very long and repeated
    got = language_id.language_digest(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).toPandas()
    truth = {n: lang for n, _, lang in rows}
    assert len(got) == len(rows) and (got[got.held_out].lang_pred == got[got.held_out].doc_id.map(truth)).mean() > 0.98
    assert got[got.doc_id == 10_000].lang_pred.nunique() == 1


def test_language_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None), (9002, "", "en"), (9003, "12 !?", None), (9004, "1²", "de")], "doc_id long, text string, lang string")
    got = language_id.language_digest(docs.select("doc_id", "text", "lang").unionByName(extra)).toPandas().merge(docs.select("doc_id", "lang").toPandas(), "left", "doc_id")
    real = got[got.held_out & got.lang.notna()]
    assert (real.lang_pred == real.lang).mean() > 0.9
    assert set(got[got.doc_id > 9000].lang_pred) == {"und"} and got.score.between(0, 1).all()
    assert set(language_id.language_digest(extra).toPandas().lang_pred) == {"und"}
    assert language_id.language_digest(extra.limit(0)).count() == 0


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.92), ("sf0.1", 0.97)])
def test_toxicity(spark, sf, least):
    """Held-out accuracy, against that of always saying clean."""
    sf = f"/root/testdata/{sf}"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = "crc32(cast(doc_id as string)) % 4 = 2"
    got = toxicity.toxicity_digest(docs, labels.where(f"not ({held})")).join(labels.where(held).withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    right, clean = (got.toxic == (got.truth == 1)).mean(), (got.truth == 0).mean()
    found = got[got.truth == 1].toxic.mean()
    assert right > max(least, clean) and found > 0.7, (right, clean, found)


def plain_chain(rows, labels, fresh, most, target):
    """The chain in plain Python: dense loops over documents, folds and steps."""
    import math

    n, fold = len(rows), np.random.default_rng(11).permutation(len(rows)) % toxicity.FOLDS

    def words(text):
        folded = re.sub(r"[A-Z]", lambda m: m[0].lower(), text)
        out = set()
        for w in re.findall(r"[a-z\x80-\U0010ffff]+", folded):
            out |= {(0, w.encode())} | {(k, w.encode()[:k]) for k in toxicity.PREFIXES if len(w.encode()) > k}
        return out

    sets = [words(t) for t in rows]
    score = {}
    for kind in set().union(*sets):
        count = sum(kind in s for s in sets)
        for y in labels:
            rate = sum(y) / n
            hit = sum(v for s, v in zip(sets, y, strict=True) if kind in s)
            now = abs(hit - count * rate) / math.sqrt(count * rate * (1 - rate)) if 0 < rate < 1 and count >= 4 else 0.0
            score[kind] = max(score.get(kind, 0.0), now)
    known = sorted(score, key=score.get, reverse=True)[:most]

    def margin(s, before, w):
        return sum(w[k] for k in known if k in s) + sum(w[i] * p for i, p in enumerate(before)) + w["bias"]

    def fit(own, y, before):
        names = [*known, *range(len(before[0])), "bias"]
        w, m, v = (dict.fromkeys(names, 0.0) for _ in range(3))
        for t in range(1, 121):
            g = {k: toxicity.DECAY * w[k] for k in names}
            for i in own:
                e = (1 / (1 + math.exp(-margin(sets[i], before[i], w))) - y[i]) / len(own)
                for k in known:
                    g[k] += e * (k in sets[i])
                for j, p in enumerate(before[i]):
                    g[j] += e * p
                g["bias"] += e
            for k in names:
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] -= 0.2 * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.999**t)) + 1e-10)
        return w

    before, models = [[] for _ in rows], []
    for y in labels:
        outside = [0.0] * n
        for f in range(toxicity.FOLDS):
            w = fit([i for i in range(n) if fold[i] != f], y, before)
            for i in range(n):
                if fold[i] == f:
                    outside[i] = 1 / (1 + math.exp(-margin(sets[i], before[i], w)))
        models.append(fit(range(n), y, before))
        before = [[*b, p] for b, p in zip(before, outside, strict=True)]
    order = sorted(range(n), key=lambda i: -before[i][target])
    scores = [(2 * sum(labels[target][i] for i in order[: k + 1]) / (k + 1 + sum(labels[target])), -k) for k in range(n)]
    top = -max(scores)[1]
    threshold = (before[order[top]][target] + (before[order[top + 1]][target] if top + 1 < n else 0.0)) / 2
    out = []
    for text in fresh:
        own: list = []
        for w in models:
            own.append(1 / (1 + math.exp(-margin(words(text), own, w))))
        out.append((own[target] >= threshold, own))
    return out


def test_chain_against_plain_python():
    import pyarrow as pa

    rng = random.Random(6)
    # every word is four letters, so that no prefix of one is another's
    texts, low, toxic = [], [], []
    for i in range(50):
        low.append(int(rng.random() < 0.5))
        toxic.append(int(rng.random() < (0.6 if low[i] else 0.2)))
        own = rng.choices(["alfa", "Brav", "char", "delt"], k=6) + ["Idio"] * (toxic[i] and rng.random() < 0.9) + ["junk"] * (low[i] and rng.random() < 0.8)
        texts.append(" ".join(own))
    labels = [low, toxic]
    fresh = ["idio alfa", "junk", "", "delt junk IDIO!", "é 12"]
    chain = toxicity.train(pa.array(texts), np.array(labels, float).T, 1, 1000)
    data, offsets = toxicity.text_buffers(pa.array(fresh))
    got = chain.predict(data, offsets)
    want = plain_chain(texts, labels, fresh, 1000, 1)
    assert got == pytest.approx(np.array([p for _, p in want]), abs=1e-6)
    assert (got[:, 1] >= chain.threshold).tolist() == [t for t, _ in want]


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(0, 1, 0), (3, None, 1), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(i, "vile words" if i % 3 == 0 else "kind words", "x", True, 1.0) for i in range(60)] + [(i, t, "y", False, 2.0) for i, t in ((60, None), (61, ""), (62, "12 !"), (None, "vile"), (5, "kind words"), (5, "kind words"), (63, "kind " * 200_000 + "vile"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, is_toxic boolean, toxic double").repartition(3)
    got = toxicity.toxicity_digest(docs, labels).collect()
    again = toxicity.toxicity_digest(docs.coalesce(1), labels.coalesce(1)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)  # clashing labels have a defined result
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and len({(r.toxic, r.score) for r in by[5]}) == 1
    assert all(by[i][0].toxic == (i % 3 == 0) for i in range(60)) and by[None][0].toxic
    assert by[60][0].score == by[61][0].score == by[62][0].score
    assert toxicity.score_toxicity(docs, labels).count() == len(rows)
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.where("doc_id = 999")):
        assert {(r.toxic, r.score) for r in toxicity.toxicity_digest(docs, none).collect()} == {(False, 0.0)}
    assert toxicity.toxicity_digest(docs.limit(0), labels).count() == 0


def brute_contamination(docs, items):
    cut = lambda t: WORD.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode()))
    windows = {}
    for ident, t in items:
        w = cut(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(ident)
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_words", [1_000_000, 60])
def test_contamination(spark, part_words):
    from pyspark.sql import functions as F

    from tandem.llm.decontaminate import CONTAMINATED, contamination

    rng = random.Random(2)
    vocabulary = ["the", "a", "É", "x9", "Foo", "bar", "q"]
    texts = [" ".join(rng.choices(vocabulary, k=k)) for k in (1, 2, 5, 12, 13, 14, 40, 80, 13)]
    items = [*enumerate(texts, 1), (50, None), (51, ""), (52, "?!"), (53, texts[6])]
    docs = [(i, rng.choice(["", "", "pre-", " "]) + " ".join(rng.choices(vocabulary, k=rng.randint(0, 300))) + rng.choice(["", ", " + rng.choice(texts).upper().replace(" ", "-")])) for i in range(40)]
    docs += [(100, None), (101, ""), (102, texts[7]), (102, texts[7])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = contamination(d, b, part_words=part_words)
    got = [tuple(r) for r in found.select("row.doc_id", "n_words", "n_hit", F.size("items"), F.expr(CONTAMINATED)).collect()]
    assert sorted(got, key=str) == brute_contamination(docs, items)
    assert decontaminate(d, b).columns == ["doc_id", "text"]
    assert contamination_digest(d, b.limit(0)).where("contaminated").count() == 0
    assert contamination_digest(d.limit(0), b).count() == 0
