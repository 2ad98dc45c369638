from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tandem.llm import minhash_dedup as M

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, width=4):
    words = WORD.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def brute(rows, width=4):
    sets = [shingles(t, width) for _, t in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                part[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)), d is None or d == least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=50):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdEFé", k=rng.randint(1, 5))) for _ in range(300)]
    rows, texts = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(1, 120))
        texts.append(words)
        rows.append((i * 7 % n + 10, " ".join(words)))
    doc = 1000
    for words in texts[:12]:
        for _ in range(rng.randint(1, 12)):
            changed = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 15)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            rows.append((rng.choice([doc, doc - 998]), "\n".join(changed)))
            doc += 1
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (5003, rows[0][1].upper()), (5004, rows[1][1]), (5004, rows[1][1]), (5005, "one two"), (5006, "ONE  two")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, M.near_duplicate_digest(docs).collect()), key=str)
    assert got == brute(rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 3)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, M.near_duplicate_digest(docs).collect()), key=str) == brute(rows)


def test_keys_meet_within_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (200, M.COMPONENTS), dtype=np.uint32)
    b = a.copy()
    for row in b:
        row[rng.choice(M.COMPONENTS, M.DISTANCE, replace=False)] ^= np.uint32(1)
    assert (M._keyed(a) == M._keyed(b)).any(1).all()


def test_filter_keeps_columns(spark):
    rows = [(i, t, "z", 7) for i, t in corpus(3)[:30]] + [(900, corpus(3)[0][1], "y", 8)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string, row int")
    out = M.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = {r[0] for r in brute([r[:2] for r in rows], 5) if r[3]}
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept)
    empty = docs.limit(0)
    assert M.drop_near_duplicates(empty).count() == 0 and M.near_duplicate_digest(empty).count() == 0


def halves(seed, n=60):
    """A group of which many pairs lie on either side of the threshold, so that no leader links them all."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        changed = list(words)
        for _ in range(rng.randint(1, 5)):
            changed[rng.randrange(len(changed))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(changed)))
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_group_around_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = halves(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, M.near_duplicate_digest(docs).collect()), key=str) == brute(rows)


def test_block_links_are_fewer_than_components():
    """All members link with each other and each is a component of its own: one link less than members, not all pairs."""
    import pyarrow as pa

    n = 50
    grams = np.arange(100, dtype=np.uint64)
    sig = M.signatures(grams, np.array([0, 100])).tobytes()
    key = int(M._keyed(np.frombuffer(sig, np.uint32).reshape(1, -1))[0, 0])
    rows = [{"key": key, "pb": 0, "bb": 0, "probe": probe, "node": i, "comp": i, "n": 100, "stray": i > 0, "sig": sig, "grams": grams.tobytes()} for probe in (False, True) for i in range(n) if not probe or i]
    out = pa.Table.from_batches(M._joined(80)(iter(pa.Table.from_pylist(rows).to_batches())))
    assert out.num_rows == n - 1


def test_classes_that_share_half_a_hash(spark):
    scratch = M.Scratch(spark, "clash")
    rows = [(7, 1, 10, 1, 1, 4, b"a"), (7, 2, 11, 2, 2, 4, b"b"), (8, 1, 12, 3, 3, 4, b"c")]
    signed = spark.createDataFrame(rows, "c1 long, c2 long, doc_id long, k1 long, k2 long, n long, sig binary")
    named = {(r.c1, r.c2): r.node for r in M._classes_of(scratch, signed).collect()}
    assert len(set(named.values())) == 3 and named[7, 1] == 7 and named[8, 1] == 8
