from __future__ import annotations

import numpy as np

from tandem.llm import embedding_dedup as E


def brute(rows, threshold=0.95):
    good = {}
    for i, (v, e) in enumerate(rows):
        if v is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e):
            x = np.array(e, float)
            x = x / np.abs(x).max()
            good[i] = x / np.sqrt(x @ x)
    part = list(range(len(rows)))
    links = [0] * len(rows)

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in good:
        for j in good:
            if j < i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold:
                links[i] += 1
                links[j] += 1
                part[root(i)] = root(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[root(i)] = min(least.get(root(i), v), v)
    return sorted(((v, links[i], least.get(root(i)), v is None or v == least[root(i)]) for i, (v, _) in enumerate(rows)), key=str)


def vectors(seed=0, n=250):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 16))
    rows = [(int(i), x.astype(np.float32).tolist()) for i, x in enumerate(base)]
    for i in range(150):
        near = base[i % 25] + rng.normal(size=16) * 0.12
        rows.append((1000 + i, near.astype(np.float32).tolist()))
    rows += [(2000 + i, rows[3][1]) for i in range(20)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0, None] * 8), (3004, [float("nan")] * 16), (3005, [float("inf")] * 16), (None, rows[0][1]), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, [1e30] * 16), (3009, [1e-30] * 16)]
    return rows


def test_against_brute_force(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, E.near_vectors(frame, shard=100, overlap=3).collect()), key=str)
    want = brute(rows)
    total, hit = sum(r[1] for r in want), sum(min(g[1], w[1]) for g, w in zip(got, want, strict=True))
    assert all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert hit >= 0.97 * total
    one = sorted(map(tuple, E.near_vectors(frame).collect()), key=str)
    assert one == want


def test_doubles(spark):
    """Doubles that floats would round over the threshold or to infinity."""
    rows = vectors(3)
    a, b = np.zeros(16), np.zeros(16)
    a[0], b[0], b[1] = 1, 0.95, np.sqrt(1 - 0.95**2)
    rows += [(4000, a.tolist()), (4001, (b * (1 - 1e-12) + a * 1e-9).tolist()), (4002, (b - a * 1e-9).tolist()), (4003, [1e300] * 16), (4004, [1e300] * 15 + [1.0001e300])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    assert sorted(map(tuple, E.near_vectors(frame).collect()), key=str) == want
    links = {w[0]: w[1] for w in want}
    assert links[4001] == 2 and links[4000] == 1 and links[4003] == links[4004] > 0


def test_large_shards_are_dealt_to_blocks(spark, monkeypatch):
    """Most vectors in one cluster: its shard is far above the bound of a task, and every pair still counts once."""
    monkeypatch.setattr(E, "MOST_MEMBERS", 120)
    rows = groups(2)
    want = brute(rows)
    for shard in (1000, 200):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
        got = sorted(map(tuple, E.near_vectors(frame, shard=shard, overlap=2).collect()), key=str)
        assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
        assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
        assert [g[2:] for g in got] == [w[2:] for w in want]


def test_many_shards(spark):
    """Planted groups over some twenty shards: all links are found."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1500, 32))
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(base)]
    rows += [(5000 + i, (base[i % 120] + rng.normal(size=32) * 0.05).astype(np.float32).tolist()) for i in range(600)]
    rows += [(9000 + i, rows[7][1]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert sorted(map(tuple, E.near_vectors(frame, shard=100).collect()), key=str) == brute(rows)


def test_columns_of_any_name(spark):
    rows = [(i, [float(i + 1), 1.0], "x", 3) for i in range(5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string, shard int")
    assert E.near_vectors(frame).columns == ["vec_id", "n_links", "component_id", "kept"] and E.near_vectors(frame).count() == 5


def test_empty(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert [tuple(r) for r in E.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()] == [(1, 0, 1, True)]


def groups(seed=0, parts=8, size=60, dim=16):
    """Tight groups larger than the pool of candidates, all in range of each other, and vectors apart."""
    rng = np.random.default_rng(seed)
    root = rng.normal(size=dim)
    root /= np.linalg.norm(root)
    rows = []
    for _ in range(parts):
        middle = root + rng.normal(size=dim) * 0.12 / np.sqrt(dim)
        rows += [middle + rng.normal(size=dim) * 1e-3 for _ in range(size)]
    rows += list(rng.normal(size=(400, dim)))
    return [(int(i), x.astype(np.float32).tolist()) for i, x in enumerate(rows)]


def test_groups_larger_than_the_pool(spark):
    rows = groups()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, E.near_vectors(frame).collect()), key=str)
    want = brute(rows)
    assert sum(r[1] for r in want) > 200_000
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert [g[2:] for g in got] == [w[2:] for w in want]


def test_graph_leads_between_groups():
    x = E.unit(np.array([e for _, e in groups(1)])).astype(np.float32)
    found = E.range_search(x, E.robust_prune(x, 0.95), np.arange(len(x)), 0.95)
    true = x @ x.T >= 0.95
    assert (found & true).sum() >= 0.97 * true.sum()


def test_exact_where_recall_stays_low(spark, monkeypatch):
    monkeypatch.setattr(E, "range_search", lambda x, lists, queries, reach: np.zeros((len(queries), len(x)), bool))
    monkeypatch.setattr(E, "BLOCK", 150)
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for shard in (1000, 250):
        assert sorted(map(tuple, E.near_vectors(frame, shard=shard).collect()), key=str) == brute(rows)


def test_vectors_that_share_half_a_hash_are_told_apart(spark):
    scratch = E.Scratch(spark, "clash")
    rows = [(1, 5, 1, 10), (1, 3, 1, 11), (1, 9, 1, 12), (2, 1, 1, 13)]
    named = E._named(scratch, spark.createDataFrame(rows, "h1 long, h2 long, mult long, id long")).collect()
    nodes = {r.id: r.node for r in named}
    assert len(set(nodes.values())) == 4 and nodes[11] == 1 and nodes[13] == 2


def test_the_audit_sees_groups_that_the_method_misses(spark, monkeypatch):
    """Shards that find nothing: the second sample, drawn by hyperplanes, has links, so the search goes on until all is compared with all."""
    rng = np.random.default_rng(5)
    rows = [(int(i), x.tolist()) for i, x in enumerate(rng.normal(size=(600, 16)))]
    rows += [(1000 + i, (np.array(rows[i // 2][1]) + rng.normal(size=16) * 0.02).tolist()) for i in range(24)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    real = E._search
    monkeypatch.setattr(E, "_search", lambda threshold, exact_search=False: real(threshold, True) if exact_search else lambda batches: iter(()))
    for name, value in {"AUDIT": 8, "MOST_AUDIT": 8}.items():
        monkeypatch.setattr(E, name, value)
    got = sorted(map(tuple, E.near_vectors(frame, shard=100).collect()), key=str)
    assert got == brute(rows)
