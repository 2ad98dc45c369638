"""Embedding near-dedup on robust-pruned flat graphs.

Equal vectors form a class with a count, so only distinct vectors are searched. A bounded sample gives
centroids; every class joins the shards of its ``overlap`` nearest ones. In each shard a flat proximity graph
is built: candidate neighbours are thinned by robust pruning (a candidate goes if a chosen neighbour is
nearer to it by the factor ``alpha`` than the node is) and edges run both ways. The adjacency lists that a
class got in its shards are united. A group of more than ``POOL`` near vectors takes all candidates from inside itself, so
it gets an edge to every group in range, between the nearest rows of both. Every class is then searched
for in each of its shards: greedy beam search from the class itself and the shard's medoid, and, from what lies
in range, on over all neighbours in range until no new one turns up. Candidates are verified by cosine in double precision. A pair is counted in the first shard
that both are in, so links are counted without ever listing the pairs of a group.

A shard of more than ``MOST_MEMBERS`` classes, as a large cluster makes it, is dealt to blocks, and every two blocks
are a shard for the graph and the search: its tasks stay bounded, and a pair still meets exactly once.

Recall is audited in every run against brute force for a sample of query vectors against all vectors. The sample grows
until ``AUDIT_LINKS`` true links are seen, up to ``MOST_AUDIT`` vectors; where it has fewer, vectors that share a bucket of
random hyperplanes' sides with another one are audited too: near ones do by chance, whatever the method has found. Below ``recall`` the overlap is widened and the search repeated. Where that can't
be widened any more, all vectors are compared with all. Only a table in which neither sample shows a single link has no
recall to measure, and that is logged.

The sample for the centroids and the centroids themselves are bounded in rows and in bytes. Vectors are compared as
they are given, floats or doubles. A table without rows gives none; other columns of any name aren't read; very long vectors are
compared whole, and the samples shrink by their bytes. Vectors that are null, empty or zero, or hold null or non-finite
components, link with nothing, nor does a row with null vec_id; vectors of different lengths aren't
comparable and don't link. Repeated rows are rows of their own.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import Scratch, by_group, components

#: Most vectors of the sample for the centroids, and centroids; and most bytes of either.
SAMPLE, MOST_CENTROIDS, MOST_BYTES = 100_000, 65_536, 64 << 20
AUDIT, MOST_AUDIT, AUDIT_LINKS = 256, 4096, 32
#: Sets of hyperplanes for the second sample.
TABLES = 4
#: Classes of a shard that are searched in one task.
MOST_MEMBERS = 2000
POOL, DEGREE, BEAM = 48, 20, 24
SLACK = 1e-4
#: Members of a block where all vectors are compared with all.
BLOCK = 4000


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    # scaled first, so that squares of very large or small components neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centroids(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(3)
    x = unit(sample).astype(np.float32)
    centre = x[rng.permutation(len(x))[:count]]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centre.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        centre = np.where(size > 0, total / np.maximum(size, 1e-12), centre)
    return centre


def robust_prune(x: np.ndarray, reach: float, alpha: float = 1.2) -> list[np.ndarray]:
    """Neighbours of each row of unit vectors: pruned candidates, and bridges between groups in range, both ways."""
    n = len(x)
    k = min(POOL, n - 1)
    sources, targets, near = [], [], []
    full = np.zeros(n, bool)
    for low in range(0, n, 256):
        rows = np.arange(low, min(n, low + 256))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -2
        pool = np.argpartition(-sims, k - 1, 1)[:, :k]
        own = np.take_along_axis(sims, pool, 1)
        order = np.argsort(-own, 1, kind="stable")
        pool, own = np.take_along_axis(pool, order, 1), np.take_along_axis(own, order, 1)
        among = np.einsum("aid,ajd->aij", x[pool], x[pool], optimize=True)
        # squared distances of unit vectors are 2 - 2 cos
        gone = np.zeros(pool.shape, bool)
        chosen = np.zeros(len(rows), np.int64)
        keep = np.zeros(pool.shape, bool)
        for i in range(k):
            take = ~gone[:, i] & (chosen < DEGREE)
            keep[:, i] = take
            chosen += take
            covered = alpha * alpha * (2 - 2 * among[:, i, :]) <= 2 - 2 * own
            gone |= take[:, None] & covered
        r, c = np.nonzero(keep)
        sources.append(rows[r])
        targets.append(pool[r, c])
        near.append(own[r, c] >= reach)
        full[rows] = own[:, -1] >= reach
    a, b, close = np.concatenate(sources), np.concatenate(targets), np.concatenate(near)
    c, d = bridges(x, least_labels(n, a[close], b[close]), full, reach)
    both = np.unique(np.stack([np.r_[a, b, c, d], np.r_[b, a, d, c]], 1), axis=0)
    return np.split(both[:, 1], np.searchsorted(both[:, 0], np.arange(1, n)))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is joined with by the links (a, b)."""
    root = np.arange(n)
    while len(a):  # least label over links, with jumps
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    return root


def bridges(x: np.ndarray, label: np.ndarray, full: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest rows of every two groups in range of each other, one of which has a row whose candidates were all in range."""
    sources, targets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for name in np.unique(label[full]).tolist():
        own, others = np.flatnonzero(label == name), np.flatnonzero(label != name)
        if not len(others):
            break
        best, near = np.full(len(others), -2, x.dtype), np.zeros(len(others), np.int64)
        for low in range(0, len(own), 256):
            sims = x[own[low : low + 256]] @ x[others].T
            top = sims.argmax(0)
            value = sims[top, np.arange(len(others))]
            near, best = np.where(value > best, own[low + top], near), np.maximum(value, best)
        others, near, best = others[best >= reach], near[best >= reach], best[best >= reach]
        order = np.lexsort((-best, label[others]))
        _, first = np.unique(label[others][order], return_index=True)
        sources.append(near[order[first]])
        targets.append(others[order[first]])
    return np.concatenate(sources), np.concatenate(targets)


def range_search(x: np.ndarray, neighbours: list[np.ndarray], queries: np.ndarray, reach: float) -> np.ndarray:
    """For each query (row numbers) the rows of cosine ``reach`` or more that the graph leads to."""
    n, q = len(x), len(queries)
    width = max(1, max(map(len, neighbours)))
    table = np.full((n + 1, width), n)
    for i, own in enumerate(neighbours):
        table[i, : len(own)] = own
    medoid = int((x @ x.mean(0)).argmax())
    padded = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    opened = np.zeros((q, n + 1), bool)
    found = np.zeros((q, n + 1), bool)
    beam = np.full((q, BEAM), n)
    score = np.full((q, BEAM), -2.0, x.dtype)
    live = np.arange(q)
    beam[:, 0], beam[:, 1] = medoid, np.where(queries == medoid, n, queries)
    score[:, 0] = x[queries] @ x[medoid]
    score[queries != medoid, 1] = 1
    seen[:, medoid] = seen[live, queries] = True
    found[score[:, 0] >= reach, medoid] = found[live, queries] = True
    while len(live):  # greedy: open the best of the beam that isn't open yet
        closed = ~opened[live[:, None], beam[live]] & (beam[live] < n)
        best = np.where(closed, score[live], -3).argmax(1)
        go = closed.any(1)
        live, best = live[go], best[go]
        if not len(live):
            break
        node = beam[live, best]
        opened[live, node] = True
        near = table[node]
        fresh = ~seen[live[:, None], near]
        near = np.where(fresh, near, n)
        seen[live[:, None], near] = True
        sims = np.einsum("ad,awd->aw", x[queries[live]], padded[near], optimize=True)
        sims[near == n] = -2
        r, c = np.nonzero(sims >= reach)
        found[live[r], near[r, c]] = True
        ids, values = np.concatenate([beam[live], near], 1), np.concatenate([score[live], sims], 1)
        top = np.argpartition(-values, BEAM - 1, 1)[:, :BEAM]
        beam[live], score[live] = np.take_along_axis(ids, top, 1), np.take_along_axis(values, top, 1)
    while True:  # range expansion: open all that is in range
        r, node = np.nonzero(found[:, :n] & ~opened[:, :n])
        if not len(r):
            return found[:, :n]
        opened[r, node] = True
        for low in range(0, len(r), 8192):
            rows, own = r[low : low + 8192], node[low : low + 8192]
            near = table[own]
            i, j = np.nonzero(~seen[rows[:, None], near])
            who, what = rows[i], near[i, j]
            if not len(who):
                continue
            seen[who, what] = True
            hit = np.einsum("ad,ad->a", x[queries[who]], x[what], optimize=True) >= reach
            found[who[hit], what[hit]] = True


def _assign(shared, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shared.value
        k = min(overlap, len(centre))
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                sims = unit(matrix(part.column("embedding"))).astype(np.float32) @ centre.T
                top = np.argpartition(-sims, k - 1, 1)[:, :k].astype(np.int64)
                top.sort(1)
                own = pa.array(np.repeat(np.arange(part.num_rows), k))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, k, dtype=np.int32)), pa.array(top.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(top.ravel()), lists.take(own), *(part.column(c).take(own) for c in ("node", "mult", "embedding"))], ["shard", "shards", "node", "mult", "embedding"])

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for table in by_group(batches, ["shard", "lo", "hi"], 2000):
        keys = np.stack([table.column(c).to_numpy() for c in ("shard", "lo", "hi")])
        edge = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0), True])
        for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield table.slice(low, high - low).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _build(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shards(batches):
            node = table.column("node").to_numpy()
            if len(node) < 2:
                continue
            lists = robust_prune(unit(matrix(_column(table, "embedding"))).astype(np.float32), threshold - SLACK)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([node[x].tolist() for x in lists], pa.list_(pa.int64()))], ["node", "near"])

    return run


def _search(threshold: float, exact_search: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Link counts and roots of the classes of each shard, by its graph or by comparing all with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shards(batches):
            node, mult = table.column("node").to_numpy(), table.column("mult").to_numpy()
            n = len(node)
            if n < 2:
                continue
            shards = np.array(table.column("shards").to_pylist())
            shard, whole = table.column("shard")[0].as_py(), table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
            block = table.column("block").to_numpy()
            exact = unit(matrix(_column(table, "embedding")))
            x = exact.astype(np.float32)
            order = np.argsort(node)
            lists = []
            for own in () if exact_search else table.column("near").to_pylist():
                own = np.array(own or [], np.int64)
                at = order[np.minimum(np.searchsorted(node[order], own), n - 1)]
                lists.append(at[node[at] == own])  # united lists also name classes of other shards
            links_a, links_b = [], []
            for low in range(0, n, 1024):
                queries = np.arange(low, min(n, low + 1024))
                a, b = np.nonzero(x[queries] @ x.T >= threshold - SLACK if exact_search else range_search(x, lists, queries, threshold - SLACK))
                a = queries[a]
                use = a != b
                a, b = a[use], b[use]
                links_a.append(np.minimum(a, b))
                links_b.append(np.maximum(a, b))
            pair = np.unique(np.concatenate(links_a) * n + np.concatenate(links_b))
            a, b = pair // n, pair % n
            sure = np.concatenate([np.einsum("ad,ad->a", exact[a[i : i + 65536]], exact[b[i : i + 65536]]) >= threshold for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
            a, b = a[sure], b[sure]
            mine = np.zeros(len(a), bool)
            for i in range(0, len(a), 16384):
                p, q = shards[a[i : i + 16384]], shards[b[i : i + 16384]]
                common = (p[:, :, None] == q[:, None, :]).any(2)
                mine[i : i + 16384] = np.where(common, p, np.iinfo(np.int64).max).min(1) == shard
            # of two blocks, the pairs inside one are counted where it stands alone
            mine &= whole | (block[a] != block[b])
            count = np.bincount(a[mine], mult[b[mine]], n) + np.bincount(b[mine], mult[a[mine]], n)
            root = least_labels(n, a, b)
            use = (count > 0) | (root != np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(node[use]), pa.array(count[use].astype(np.int64)), pa.array(node[root[use]])], ["node", "links", "root"])

    return run


def _audit(shared, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """True links of the sampled classes within each batch of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            node, mult = batch.column("node").to_numpy(), batch.column("mult").to_numpy()
            hit = unit(vectors) @ unit(matrix(batch.column("embedding"))).T >= threshold
            hit &= ids[:, None] != node[None]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((hit * mult[None]).sum(1))], ["node", "truth"])

    return run


def _all_pairs(classes: DataFrame, n: int) -> DataFrame:
    """Members of shards of which each holds two blocks of classes, so that every two classes have one in common."""
    count = -(-n // BLOCK)
    own = F.pmod(F.xxhash64(F.lit(4), "node"), F.lit(count))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>"), lambda other: F.least(own, other) * count + F.greatest(own, other))
    dealt = classes.select(pairs.alias("shards"), "node", "mult", "embedding")
    one = [F.lit(0).alias(c) for c in ("lo", "hi", "block")]
    return dealt.select(F.explode("shards").alias("shard"), *one, "shards", "node", "mult", "embedding").repartition("shard").sortWithinPartitions("shard", "node")


def _blocks(scratch: Scratch, member: DataFrame, tag: str) -> DataFrame:
    """The members with lo, hi and block: 0 in a shard of ``MOST_MEMBERS`` or fewer, else a row for every two blocks."""
    sizes = scratch.save(member.groupBy("shard").agg(F.ceil(F.count("*") * 2 / MOST_MEMBERS).cast("int").alias("nb")).where(F.col("nb") > 2), f"large-{tag}")
    one = [F.lit(0).alias(c) for c in ("lo", "hi", "block")]
    if sizes.isEmpty():
        return member.select("shard", *one, "shards", "node", "mult", "embedding")
    own = member.join(sizes, "shard", "left").withColumn("block", F.when(F.col("nb").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(6), "node"), F.col("nb"))).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce("nb", F.lit(1)) - 1)
    dealt = own.select("shard", F.explode(others).alias("other"), "block", "shards", "node", "mult", "embedding")
    return scratch.save(dealt.select("shard", F.least("other", "block").alias("lo"), F.greatest("other", "block").alias("hi"), "block", "shards", "node", "mult", "embedding"), f"blocks-{tag}")


def _truth(scratch: Scratch, classes: DataFrame, sample: DataFrame, threshold: float, name: str) -> DataFrame:
    """node and truth, its number of links by brute force, of the classes (node, embedding) of ``sample`` that have any."""
    audit = sample.toArrow()
    if not audit.num_rows:
        return scratch.spark.createDataFrame([], "node long, truth long")
    shared = scratch.spark.sparkContext.broadcast((audit.column("node").to_numpy(), matrix(audit.column("embedding").combine_chunks())))
    return scratch.save(classes.mapInArrow(_audit(shared, threshold), "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth")).where("truth > 0"), name)


def _sides(width: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sides of ``bits`` random hyperplanes that each vector is on, for every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(8).normal(size=(width, TABLES * bits))
        for batch in batches:
            if batch.num_rows:
                side = (unit(matrix(batch.column("embedding"))) @ planes > 0).reshape(batch.num_rows, TABLES, bits)
                bucket = (side << np.arange(bits)).sum(2) * TABLES + np.arange(TABLES)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), TABLES)), pa.array(bucket.ravel())], ["node", "bucket"])

    return run


def _likely(scratch: Scratch, classes: DataFrame, n: int, width: int, name: str) -> DataFrame:
    """About ``AUDIT`` classes (node, embedding) that share a bucket with another: found without the graphs, so that a group they miss is seen.

    With some bits more than the number of vectors has, unrelated ones seldom meet.
    """
    sides = scratch.save(classes.mapInArrow(_sides(width, min(40, n.bit_length() + 4)), "node long, bucket long"), f"sides-{name}")
    met = sides.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    likely = scratch.save(sides.join(met, "bucket").select("node").distinct(), f"likely-{name}")
    some = _some(likely, 7, AUDIT, likely.count())
    return classes.join(some, "node", "left_semi").select("node", "embedding")


def _some(classes: DataFrame, seed: int, most: int, n: int) -> DataFrame:
    """Some ``most`` of n classes, by a hash below a bound."""
    return classes.where(F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 30)) < int(min(1.0, most / max(1, n)) * (1 << 30)))


def _space(scratch: Scratch, classes: DataFrame, tag: str, threshold: float, shard: int, overlap: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Link counts (node, links) and edges (a, b) of classes of one vector length."""
    spark = scratch.spark
    kind = classes.schema["embedding"].dataType.simpleString()
    sizes = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    n, width = sizes[0], sizes[1]
    rows = max(1, min(SAMPLE, MOST_BYTES // (8 * width)))
    count = int(max(1, min(MOST_CENTROIDS, MOST_BYTES // (4 * width), rows // 2, round(n / shard))))
    centre = np.ones((1, 1), np.float32)
    if count > 1:
        centre = centroids(matrix(_some(classes, 1, rows, n).select("embedding").toArrow().column("embedding").combine_chunks()), count)
        count = len(centre)
    centre = spark.sparkContext.broadcast(centre)
    size, audited = AUDIT, 0
    while True:
        truth = _truth(scratch, classes, _some(classes, 2, size, n).select("node", "embedding"), threshold, f"truth-{tag}-{size}")
        audited = truth.agg(F.coalesce(F.sum("truth"), F.lit(0))).first()[0]
        if audited >= AUDIT_LINKS or size >= min(n, MOST_AUDIT):
            break
        size *= 4
    if audited < AUDIT_LINKS:
        truth = scratch.save(truth.union(_truth(scratch, classes, _likely(scratch, classes, n, width, tag), threshold, f"truth-{tag}-likely")).distinct(), f"truth-{tag}")
    while True:
        overlap = min(overlap, count)
        if count == 1:
            member = classes.select(F.lit(0).cast("long").alias("shard"), F.array(F.lit(0).cast("long")).alias("shards"), "node", "mult", "embedding")
        else:
            member = classes.mapInArrow(_assign(centre, overlap), f"shard long, shards array<long>, node long, mult long, embedding {kind}")
        member = _blocks(scratch, scratch.save(member, f"member-{tag}-{overlap}"), f"{tag}-{overlap}")
        graph = member.select("shard", "lo", "hi", "node", "embedding").repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi", "node").mapInArrow(_build(threshold), "node long, near array<long>")
        united = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        cells = member.join(united, "node", "left").repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi", "node")
        found = scratch.save(cells.mapInArrow(_search(threshold), "node long, links long, root long"), f"found-{tag}-{overlap}")
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        got = truth.join(links, "node", "left").agg(F.sum("truth"), F.sum(F.coalesce("links", F.lit(0)))).first()
        if not got[0]:
            logging.getLogger(__name__).warning("no link in the audited samples of %d vectors: recall isn't measured", n)
            break
        if got[1] >= recall * got[0]:
            break
        if overlap >= count:
            found = scratch.save(_all_pairs(classes, n).mapInArrow(_search(threshold, True), "node long, links long, root long"), f"found-{tag}-all")
            links = found.groupBy("node").agg(F.sum("links").alias("links"))
            break
        overlap += 2
    return links, found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _named(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """The classes with a node of 64 bits that is theirs alone: the first half of their hash, or for all but one of those that share it a hash of both halves."""
    clash = scratch.save(classes.groupBy("h1").agg(F.count("*").alias("same"), F.min("h2").alias("h0")).where("same > 1"), "clashes")
    if clash.isEmpty():
        return classes.withColumn("node", F.col("h1"))
    named = classes.join(clash.select("h1", "h0"), "h1", "left")
    return scratch.save(named.withColumn("node", F.when(F.col("h2") > F.col("h0"), F.xxhash64("h1", "h2")).otherwise(F.col("h1"))).drop("h0"), "named")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, shard: int = 500, overlap: int = 2, recall: float = 0.97) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    kind = vectors.schema["embedding"].dataType.simpleString()
    floats = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    sound = F.forall(floats, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(floats, lambda v: v != 0)
    keyed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), floats.alias("embedding"), F.coalesce(sound & F.col("vec_id").isNotNull(), F.lit(False)).alias("sound"))
    keyed = keyed.select("vec_id", F.when(F.col("sound"), F.xxhash64("embedding")).alias("node"), F.when(F.col("sound"), F.xxhash64(F.lit(3), "embedding")).alias("h2"), F.when(F.col("sound"), F.col("embedding")).alias("embedding"))
    classes = _named(scratch, scratch.save(keyed.where("node is not null").groupBy(F.col("node").alias("h1"), "h2").agg(F.count("*").alias("mult"), F.min("vec_id").alias("id"), F.first("embedding").alias("embedding")), "vectors"))
    keyed = keyed.withColumnRenamed("node", "h1")
    sizes = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]
    if not sizes:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    spaces = [_space(scratch, classes.where(F.size("embedding") == size).select("node", "mult", "embedding"), str(size), threshold, shard, overlap, recall) for size in sorted(sizes)]
    links, edges = spaces[0]
    for more_links, more_edges in spaces[1:]:
        links, edges = links.unionByName(more_links), edges.unionByName(more_edges)
    parts = components(scratch, edges, "cc").withColumnRenamed("id", "node")
    every = scratch.save(classes.select("node", "h1", "h2", "mult", "id").join(links, "node", "left").join(parts, "node", "left").select("h1", "h2", "id", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("part")), "every")
    least = every.groupBy("part").agg(F.min("id").alias("component_id"))
    done = every.join(least, "part").select("h1", "h2", "n_links", "component_id")
    out = keyed.select("vec_id", "h1", "h2").join(done, ["h1", "h2"], "left")
    part = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.coalesce(part == F.col("vec_id"), F.lit(True)).alias("kept"))
