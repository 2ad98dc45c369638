from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tandem.llm import anisotropic_search as S
from tandem.llm import merkle as M
from tandem.llm import token_align as T

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- Merkle manifest ------------------------------------------------------------------------------------


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        low = i - i % 3
        out.append(("".join(level[low:i]), "".join(level[i + 1 : low + 3])))
        i //= 3
    return out


def plain_manifest(rows):
    item = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda row, text: sha("".join(map(item, [*row[:4], text])))
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {name: plain_tree([leaf(r, r[4]) for r in groups[name]]) for name in names}
    top = plain_tree([trees[name][-1][0] for name in names]) if names else [[None]]
    out = []
    for j, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            path, text = plain_path(trees[name], i) + plain_path(top, j), row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(row, text)
            for left, right in path:
                node = sha(left + node + right)
            out.append((row[0], leaf(row, row[4]), trees[name][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def documents(seed=0):
    rng = random.Random(seed)
    rows = [(i, "hot" if i % 3 else f"s{rng.randrange(12)}", "en", 4, f"text {i}\nmore") for i in range(150)]
    rows += [(1, "hot", "en", 4, "same")] * 40 + [(1000 + i, f"single{i}", None, None, None) for i in range(15)]
    return rows + [(None, None, None, None, None), (None, None, "x", 1, ""), (7, "", "", 0, ""), (8, None, "é", -3, "ü\n" * 3), (9, "z" * 3000, "en", 1, "long " * 60_000 + "\n"), (9, "\U0001f600", "en", 1, "a")]


@pytest.mark.parametrize("part_rows", [5, 16_384])
def test_manifest_against_a_plain_tree(spark, part_rows, monkeypatch):
    monkeypatch.setattr(M.manifest, "__defaults__", (3, part_rows))
    rows = documents()
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted(map(tuple, M.manifest_digest(frame).collect()), key=str)
    assert got == plain_manifest(rows)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_manifest_of_few_and_no_rows_with_other_columns(spark):
    for rows in ([], [(1, "a", "en", 1, "x\ny")], [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "y")]):
        frame = spark.createDataFrame([(*r, 1, "k") for r in rows], f"{DOCS}, part int, leaf string")
        out = M.manifest_digest(frame)
        assert sorted(map(tuple, out.collect()), key=str) == plain_manifest(rows)
        assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_forests_merge_in_any_order():
    leaves = {0: 20, 1: 31, M.TOP: 2}
    trees = {t: [sha(f"{t} {i}") for i in range(leaves[t])] for t in (0, 1)}
    pieces = [({(0, 0, i): d for i, d in enumerate(trees[0][:7])}), {(0, 0, i): d for i, d in list(enumerate(trees[0]))[7:]}, {(1, 0, i): d for i, d in list(enumerate(trees[1]))[:11]}, {(1, 0, i): d for i, d in list(enumerate(trees[1]))[11:12]}, {(1, 0, i): d for i, d in list(enumerate(trees[1]))[12:]}]
    want = plain_tree([plain_tree(trees[0])[-1][0], plain_tree(trees[1])[-1][0]])[-1][0]
    for seed in range(6):
        own = [M.Fragment(dict(p)) for p in pieces]
        for fragment in own:  # as a partition leaves it
            fragment.resolve(list(fragment.waiting), leaves, 3)
        rng = random.Random(seed)
        while len(own) > 1:
            a = own.pop(rng.randrange(len(own)))
            b = own.pop(rng.randrange(len(own)))
            own.append(a.merge(b, leaves, 3).merge(M.Fragment(), leaves, 3))
        assert list(own[0].waiting.values()) == [want]


# -- alignment of tokenizers ----------------------------------------------------------------------------

TEXTS = [None, "", " ", "a  b\n\n  c   ", "x\t y\n z", "<|endoftext|> hi <s> </s>", "▁a b", "日本語 テキスト", "don't I'll 's", "a\x1c b", "  x", "é \r\n  q", "\x00 a", "😀 😀😀", " " * 50, "\n" * 20 + " a", "a" * 3000, "The quick brown fox, 12345 times; jumps.", "The quick brown fox, 12345 times; jumps."]


def plain_alignment(text, tools, json_tokenizer):
    """Ids of the JSON tokenizer and of whole texts, ends by addition, groups by common ends."""
    if not text:
        return None
    a, b = json_tokenizer.encode(f" {text}", add_special_tokens=False).ids, tools.b.encode(text)
    pieces = [bytes([int(p[3:5], 16)]) if tools.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(tools.b.id_to_piece, b), strict=True)]
    if b"".join(pieces) != f" {text}".encode():
        return None
    ends = [[], []]
    for own, parts in zip(ends, ([tools.a_bytes[i] for i in a], pieces), strict=True):
        at = 0
        for part in parts:
            at += len(part)
            own.append(at)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    i = j = 0
    groups, links = [], []
    for end in cuts:
        p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
        links.append((a[p - 1], b[q - 1]))
        i, j = p, q
    return a, b, ends, groups, links


@pytest.fixture(scope="module")
def json_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


def test_alignment_against_plain_lists(spark, json_tokenizer):
    tools = T.aligner()
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = [(i if i % 7 else None, t, 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, pairs int")
    want, counts = [], {}
    for _, text, _ in rows:
        found = plain_alignment(text, tools, json_tokenizer)
        want.append(found)
        for link in found[4] if found else ():
            counts[link] = counts.get(link, 0) + 1
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    lines = []
    for (doc, _, _), found in zip(rows, want, strict=True):
        if found is None:
            lines.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, _, groups, links = found
            lines.append((doc, len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha(";".join(groups))))
    got = T.alignment_digest(frame)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(lines, key=str)
    assert len(counts) <= tools.most_pairs()
    assert sum(found is None for found in want) >= 3 and any(found for found in want)


def test_alignment_lists_and_overlaps(spark, json_tokenizer):
    tools = T.aligner()
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for row in T.align(frame).collect():
        found = plain_alignment(TEXTS[row.doc_id], tools, json_tokenizer)
        if found is None:
            assert row.a_ids == row["first"] == []
            continue
        a, b, ends, _, links = found
        assert (row.a_ids, row.b_ids, [row.a_ends, row.b_ends]) == (a, b, ends)
        assert [(a[i - 1], b[j - 1]) for i, j in zip(row.a_cuts, row.b_cuts, strict=True)] == links
        starts = [[0, *x[:-1]] for x in ends]
        for i, (first, last) in enumerate(zip(row["first"], row["last"], strict=True)):
            over = [j for j in range(len(b)) if starts[1][j] < ends[0][i] and ends[1][j] > starts[0][i]]
            assert over == list(range(first, last + 1))


def test_pieces_dont_change_an_alignment(monkeypatch):
    tools = T.aligner()
    texts = [t for t in TEXTS if t] + ["one two  three\n four " * 30]
    whole = [tools.digest(t) for t in texts]
    monkeypatch.setattr(T, "PIECE", 4)
    assert [(*x[:4], x[4].tolist()) for x in map(tools.digest, texts)] == [(*x[:4], x[4].tolist()) for x in whole]


def test_alignment_of_no_rows(spark):
    assert T.alignment_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# -- nearest neighbours ---------------------------------------------------------------------------------


def plain_nearest(rows, k=10):
    sound = {(v, tuple(e)) for v, e in rows if v is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    out = {}
    for v, e in sound:
        if v % 100 == 0:
            near = []
            for w, f in sound:
                if w != v and len(e) == len(f):
                    gap = np.array(f) - np.array(e)
                    scale = np.abs(gap).max() or 1.0
                    near.append((float(scale * np.sqrt(((gap / scale) ** 2).sum())), w))
            out.setdefault(v, []).append(sorted(near)[:k])
    return out


def vectors(n=900, d=12, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    rows += [(1000 + i, (base[0] + rng.normal(size=d) * 0.01).astype(np.float32).tolist()) for i in range(120)]
    rows += [(2000 + i, rows[5][1]) for i in range(40)] + [rows[7]] * 3
    rows += [(3000, None), (3100, []), (3200, [0.0] * d), (3300, [1.0, None] * (d // 2)), (3400, [float("nan")] * d), (3500, [float("inf")] * d), (None, rows[0][1])]
    return rows + [(4000, [1.0, 2.0]), (4001, [2.0, 4.0]), (4002, [2.0, 4.0]), (4100, [1e30] * d), (4101, [2e30] * d), (100, [9.0] * d), (5000, [3.0] * 5)]


def check(found, rows, k, least):
    want, got = plain_nearest(rows, k), {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for query, lists in want.items():
        mine = got.pop(query, [])
        assert len(mine) == sum(map(len, lists))
        if len(lists) == 1:
            mine.sort()
            assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
            assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        if query == 4100:  # so far from all others that their distances differ by less than rounding
            continue
        truth = {x for one in lists for x in one}
        hit += len({(w, round(s, 6)) for _, w, s in mine} & {(w, round(s, 6)) for s, w in truth})
        total += len(truth)
    assert not got and hit >= least * total
    return hit / total


def test_nearest_on_a_small_table_are_exact(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", S.F.lit(1)).withColumn("node", S.F.lit("x"))
    check(S.nearest_of_hundredth(frame).collect(), rows, 10, 0.97)


def test_nearest_with_cells_blocks_and_parts(spark, monkeypatch):
    for name, value in {"BLOCK": 40, "QUERIES": 3, "LEAST": 64}.items():
        monkeypatch.setattr(S, name, value)
    rows = [(v, [float(x) for x in e] if e and None not in e else e) for v, e in vectors(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    index = S.Index(frame, 5, cell=60)
    assert index.cells > 5
    found = index.search(index.queries(S.F.col("vec_id") % 100 == 0), probe=2, rerank=8, recall=0.95)
    assert check(found.collect(), rows, 5, 0.9) >= 0.9


def test_few_and_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert S.nearest_of_hundredth(empty).collect() == []
    three = spark.createDataFrame([(100, [1.0, 0.0]), (1, [1.0, 1.0]), (200, [4.0, 4.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in S.nearest_of_hundredth(three).collect()) == [(100, 1, 1), (100, 2, 200), (200, 1, 1), (200, 2, 100)]


def test_anisotropic_codes_err_less_along_the_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    aware = S.train(x, 4)
    plain = S.Space(aware.centre, np.stack([S.k_means(np.ascontiguousarray(S.subspaces(x - aware.centre[S.nearest_centre(x, aware.centre)[:, 0]])[:, s]), 16) for s in range(16)]), 1.0)
    along = []
    for space in (aware, plain):
        cell = S.nearest_centre(x, space.centre)[:, 0]
        code = space.encode(x, cell)
        near = space.centre[cell] + np.take_along_axis(space.book[None], code[:, :, None, None], 2)[:, :, 0].reshape(len(x), -1)
        way = x / np.sqrt((x * x).sum(1, keepdims=True))
        along.append(float((((x - near) * way).sum(1) ** 2).mean()))
        # a scan gives the products with the words that the codes name
        packed = S.packed(code)
        assert np.allclose(S.scan(space.tables(x[:5]), packed) + (x[:5] @ space.centre.T)[:, cell], x[:5] @ near.T, atol=1e-3)
    assert aware.eta > 1 and along[0] < 0.7 * along[1]


def test_inner_product(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = S.Index(frame, 3, measure="ip")
    found = {}
    for r in index.search(index.queries(S.F.col("vec_id") < 5)).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in range(5):
        order = [i for i in np.argsort(-(x @ x[q])) if i != q][:3]
        assert [v for _, v in sorted(found[q])] == order


def test_codes_of_cells_of_two_scales():
    rng = np.random.default_rng(11)
    wide = rng.random(8000) < 0.005
    x = (rng.normal(size=(8000, 32)) * np.where(wide[:, None], 1.0, 1e-3)).astype(np.float32)
    space = S.train(x, 10)
    scale = np.ones(len(space.centre)) if getattr(space, "scale", None) is None else space.scale
    for own in (x[wide], x[~wide]):
        cell = S.nearest_centre(own, space.centre)[:, 0]
        words = np.take_along_axis(space.book[None], space.encode(own, cell)[:, :, None, None], 2)[:, :, 0].reshape(own.shape)
        rest = own - space.centre[cell]
        assert ((rest - scale[cell][:, None] * words) ** 2).sum() < 0.2 * (rest**2).sum()
