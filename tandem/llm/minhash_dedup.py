"""MinHash near-dedup by a multi-index Hamming join.

A document's set is its distinct 4-word shingles (words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer
words are one shingle). Documents with equal sets form a class; classes get a signature of ``COMPONENTS``
min-hashes cut to b = 32 bits. The distance of two signatures is the number of components that differ.
By pigeonhole, signatures at a distance of at most ``chunks * (errors + 1) - 1`` have a chunk with at most
``errors`` differing components, so a class is filed under every chunk with every choice of ``errors``
components left out (8 chunks of 3 with 1 error: 24 keys, all pairs within distance 15 of 24 meet). At
similarity 0.8 a component differs with probability 0.2, and more than 15 of 24 do with probability 1e-6: that
is the chance that a pair at the threshold has no key in common.

Groups of one key aren't compared pair by pair. First every member is held against the leader of its key,
its most central member by the sizes of its own keys, and links are confirmed on full shingle sets. Components of these links
follow. Only keys whose members are then in several components are taken up again: members outside the
key's largest component are compared, in blocks of bounded bytes, with the members of other components.
Pairs not ruled out by size or by bitmaps of their shingles (exact bounds) are confirmed on full sets
inside the task, nearest signatures first, and as soon as two components are linked no other pair of them
is looked at. So a block yields fewer links than it has components, no link between components is lost, and a
group of n copies costs about n comparisons.

Null text, and text without words, has an empty set and is linked with nothing. A row with null doc_id is
linked with nothing, has a null component and is kept. Repeated rows share class and component. Only doc_id and text
are read; ``drop_near_duplicates`` keeps other columns of any name. Very long texts are read whole; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import kernels as K
from tandem.llm.common import Scratch, batch_slices, by_group, cache, components, row_keys, text_buffers
from tandem.llm.spans import SLICE_BYTES, SPACE

CHUNKS, CHUNK, ERRORS = 8, 3, 1
COMPONENTS = CHUNKS * CHUNK
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Most members of a key in one block, and most bytes of their shingle sets (a single set may be larger).
BLOCK = 2048
BLOCK_BYTES = 4 << 20
#: Bits of the bitmap of a shingle set.
BITS = 2048
_rng = np.random.default_rng(1234567)
_FACTORS = _rng.integers(1, 1 << 63, COMPONENTS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and their n + 1 row offsets."""
    starts, ends, rows = K.word_spans(SPACE[data], offsets)
    words = K.span_hashes(data, starts, ends, K.FOLDED)
    lengths = np.diff(rows)
    counts = np.maximum(0, lengths - width + 1)
    who = np.repeat(np.arange(len(lengths)), counts)
    grams = K.gram_hashes(words, width)[K.spread(rows[:-1], counts)] if counts.any() else np.zeros(0, np.uint64)
    for n in range(1, width):  # short rows: the whole sequence
        short = np.flatnonzero(lengths == n)
        if len(short):
            grams = np.concatenate([grams, K.gram_hashes(words, n)[rows[short]]])
            who = np.concatenate([who, short])
    order = np.lexsort((grams, who))
    grams, who = grams[order], who[order]
    fresh = np.r_[True, (grams[1:] != grams[:-1]) | (who[1:] != who[:-1])] if len(who) else np.zeros(0, bool)
    grams, who = grams[fresh], who[fresh]
    return grams, np.searchsorted(who, np.arange(len(lengths) + 1))


def signatures(grams: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A row of ``COMPONENTS`` 32-bit min-hashes for each non-empty set."""
    first = edges[:-1][np.diff(edges) > 0]
    out = np.zeros((len(first), COMPONENTS), np.uint32)
    if len(first):
        with np.errstate(over="ignore"):
            for j in range(COMPONENTS):
                out[:, j] = np.minimum.reduceat(grams * _FACTORS[j] + _SHIFTS[j], first) >> np.uint64(32)
    return out


def _classes(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache("minhash")
        for batch in batch_slices(batches, "text", SLICE_BYTES):
            data, offsets = text_buffers(batch.column("text"))
            grams, edges = shingle_sets(data, offsets, width)
            sizes = np.diff(edges)
            full = np.flatnonzero(sizes)
            signs = signatures(grams, edges)
            ids = np.zeros((batch.num_rows, 2), np.int64)
            raw = memoryview(grams).cast("B") if len(grams) else memoryview(b"")
            for r in full.tolist():
                ids[r] = np.frombuffer(xxhash.xxh3_128_digest(raw[8 * edges[r] : 8 * edges[r + 1]]), np.int64)
            signed: list[bytes | None] = [None] * batch.num_rows
            for r, s in zip(full.tolist(), signs, strict=True):
                signed[r] = s.tobytes()
            none = sizes == 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "doc_id")), pa.array(sizes), pa.array(ids[:, 0], mask=none), pa.array(ids[:, 1], mask=none), pa.array(signed, pa.binary())], ["k1", "k2", "doc_id", "n", "c1", "c2", "sig"])

    return run


def _keyed(signs: np.ndarray) -> np.ndarray:
    """The keys of signatures, one row of CHUNKS * CHUNK for each: a chunk without one of its components."""
    out = np.zeros((len(signs), COMPONENTS), np.int64)
    for c in range(CHUNKS):
        for left in range(CHUNK):
            j = c * CHUNK + left
            a, b = (c * CHUNK + i for i in range(CHUNK) if i != left)
            pair = (signs[:, a].astype(np.uint64) << np.uint64(32)) | signs[:, b]
            with np.errstate(over="ignore"):
                out[:, j] = K.mix(pair ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64)
    return out


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sorted shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, "text", SLICE_BYTES // 2):
            grams, edges = shingle_sets(*text_buffers(batch.column("text")), width)
            raw = memoryview(grams).cast("B") if len(grams) else memoryview(b"")
            sets = [raw[8 * a : 8 * b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "grams"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _keyed(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COMPONENTS))
        node = batch.column("node").to_numpy()
        for at in range(0, len(node), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 2000].ravel()), pa.array(np.repeat(node[at : at + 2000], COMPONENTS))], ["key", "node"])


def _confirm(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between a leader (role 0, first of its block) and the rows that follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, held = None, np.zeros(0, np.uint64)
        for batch in batch_slices(batches, "text", SLICE_BYTES):
            grams, edges = shingle_sets(*text_buffers(batch.column("text")), width)
            out_a, out_b = [], []
            for r, (lead, block, role, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lead", "block", "role", "node")), strict=True)):
                own = grams[edges[r] : edges[r + 1]]
                if role == 0:
                    leader, held = (lead, block), own
                elif leader == (lead, block):
                    if _linked(own, held, percent):
                        out_a.append(lead)
                        out_b.append(node)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _bitmaps(grams: list[np.ndarray]) -> np.ndarray:
    """A bit for each shingle's hash, in ``BITS``, as 64-bit words."""
    out = np.zeros((len(grams), BITS // 64), np.uint64)
    for low in range(0, len(grams), 256):
        part = grams[low : low + 256]
        bit = np.zeros((len(part), BITS), bool)
        bit[np.repeat(np.arange(len(part)), [len(g) for g in part]), (np.concatenate(part) % np.uint64(BITS)).astype(np.int64)] = True
        out[low : low + len(part)] = np.packbits(bit, axis=1).view(np.uint64)
    return out


def _joined(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (a, b) that join the components in a block of a key; each pair is judged under its first common key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, ["key", "pb", "bb"], BLOCK, "grams", BLOCK_BYTES):
            key, pb, bb, probe, node, comp, n, stray = (table.column(c).to_numpy() for c in ("key", "pb", "bb", "probe", "node", "comp", "n", "stray"))
            signs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, COMPONENTS)
            keys = _keyed(signs)
            grams = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
            bits = _bitmaps(grams)
            out_a, out_b = [], []
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pb[1:] != pb[:-1]) | (bb[1:] != bb[:-1]), True])
            for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                rows = np.arange(low, high)
                base = rows[~probe[rows]]
                # components that were linked here have one label
                kinds, own = np.unique(comp[rows], return_inverse=True)
                label, own_base = np.arange(len(kinds)), own[base - low]
                for p in rows[probe[rows]].tolist():
                    mine = own[p - low]
                    # two strays meet as probe and base both ways: one is enough
                    see = np.flatnonzero((label[own_base] != label[mine]) & (~stray[base] | (node[base] > node[p])))
                    b = base[see]
                    see = see[100 * np.minimum(n[p], n[b]) >= percent * np.maximum(n[p], n[b])]
                    b = base[see]
                    # what one bitmap has and the other lacks is in one set alone: a bound on the similarity
                    both = np.minimum(n[p] - np.bitwise_count(bits[p] & ~bits[b]).sum(1), n[b] - np.bitwise_count(bits[b] & ~bits[p]).sum(1))
                    see = see[100 * both >= percent * (n[p] + n[b] - both)]
                    see = see[keys[p, (keys[p] == keys[base[see]]).argmax(1)] == key[low]]
                    see = see[np.argsort((signs[p] != signs[base[see]]).sum(1), kind="stable")]
                    while len(see):
                        other, see = see[0], see[1:]
                        if _linked(grams[p], grams[base[other]], percent):
                            out_a.append(node[p])
                            out_b.append(node[base[other]])
                            label[label == label[mine]] = label[own_base[other]]
                            see = see[label[own_base[see]] != label[mine]]
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _links(scratch: Scratch, name: str, pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) of the pairs (lead, node)."""
    sizes = scratch.save(pairs.groupBy("lead").agg(F.count("*").alias("c")), f"{name}-sizes")
    dealt = scratch.save(pairs.join(sizes, "lead").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / 256))), f"{name}-dealt")
    members = dealt.select("lead", "block", F.lit(1).alias("role"), "node").join(texts, "node").select("lead", "block", "role", "node", "text")
    leaders = dealt.select("lead", "block").distinct().join(texts.withColumnRenamed("node", "lead"), "lead").select("lead", "block", F.lit(0).alias("role"), F.col("lead").alias("node"), "text")
    return members.unionByName(leaders).repartition("lead", "block").sortWithinPartitions("lead", "block", "role", "node").mapInArrow(_confirm(width, percent), "a long, b long")


def _classes_of(scratch: Scratch, signed: DataFrame) -> DataFrame:
    """A row for each set: its node in the graph, its 128-bit hash (c1, c2), least doc_id, a row that holds it, size and signature."""
    classes = scratch.save(signed.groupBy("c1", "c2").agg(F.min("doc_id").alias("id"), F.min(F.struct("k1", "k2")).alias("at"), F.first("n").alias("n"), F.first("sig").alias("sig")), "sets")
    # a node is the first half of the hash; where two sets share that, all but one are renamed by both halves
    clash = scratch.save(classes.groupBy("c1").agg(F.count("*").alias("sets"), F.min("c2").alias("c0")).where("sets > 1"), "clashes")
    if clash.isEmpty():
        return classes.withColumn("node", F.col("c1"))
    named = classes.join(clash.select("c1", "c0"), "c1", "left")
    return scratch.save(named.withColumn("node", F.when(F.col("c2") > F.col("c0"), F.xxhash64("c1", "c2")).otherwise(F.col("c1"))).drop("c0"), "classes")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """k1, k2 (the row's keys), doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = docs.select(*row_keys("doc_id", "text"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.save(rows.mapInArrow(_classes(width), "k1 long, k2 long, doc_id long, n long, c1 long, c2 long, sig binary"), "rows")
    classes = _classes_of(scratch, signed.where("n > 0 and doc_id is not null"))
    keys = scratch.save(classes.select("node", "sig").mapInArrow(_keys, "key long, node long"), "keys")
    # tables of one row a key are written first: a join of two plain shuffles is one whose hot keys Spark can split
    shared = scratch.save(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    keys = scratch.save(keys.join(shared, "key"), "keys-shared")
    scratch.drop("keys")
    # the leader of a key is its most central member: that whose own keys have most members
    central = scratch.save(keys.groupBy("node").agg(F.sum("c").alias("weight")), "central")
    heads = keys.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", F.xxhash64("node"), "node"))["node"].alias("lead"))
    heads = scratch.save(heads, "heads")
    pairs = scratch.save(keys.join(heads, "key").where("node <> lead").select("lead", "node").distinct(), "pairs")
    at = classes.join(central, "node").select("node", F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2"))
    # repeated rows have equal keys; one is enough, and the join has put them together
    texts = scratch.save(rows.select("k1", "k2", "text").join(at, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"), "texts")
    links = scratch.save(_links(scratch, "links", pairs, texts, width, percent), "links")
    parts = components(scratch, links, "cc-1")
    member = keys.join(parts.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    member = scratch.save(member, "members")
    # a key of two has been judged, as one of them led it
    sizes = member.groupBy("key", "comp").agg(F.count("*").alias("c"))
    open_keys = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("m")).where("comps > 1 and c > 2").select("key", F.col("m.comp").alias("main"))
    open_keys = scratch.save(open_keys, "open-keys")
    live = scratch.save(member.join(open_keys, "key").join(classes.select("node", "n", "sig"), "node").withColumn("stray", F.col("comp") != F.col("main")), "open")
    blocks = live.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).alias("nb"))
    live = scratch.save(live.join(scratch.save(blocks, "blocks"), "key").withColumn("own", F.pmod(F.xxhash64("node"), "nb")), "open-blocks")
    needed = scratch.save(live.select("node").distinct(), "open-nodes")
    sets = scratch.save(texts.join(needed, "node").mapInArrow(_sets(width), "node long, grams binary"), "open-sets")
    # stray block pb meets base block bb; base blocks are met by every block of strays of the key
    probe = live.where("stray").select("key", F.col("own").alias("pb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("bb"), F.lit(True).alias("probe"), "node", "comp", "n", "sig", "stray")
    stray_blocks = scratch.save(live.where("stray").select("key", F.col("own").alias("pb")).distinct(), "stray-blocks")
    base = live.join(stray_blocks, "key").select("key", "pb", F.col("own").alias("bb"), F.lit(False).alias("probe"), "node", "comp", "n", "sig", "stray")
    dealt = scratch.save(probe.unionByName(base), "dealt")
    joined = dealt.join(sets, "node").repartition("key", "pb", "bb").sortWithinPartitions("key", "pb", "bb", "probe", "node").mapInArrow(_joined(percent), "a long, b long")
    joined = scratch.save(joined.distinct(), "links-2")
    if not joined.isEmpty():
        parts = components(scratch, parts.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(joined), "cc-2")
    every = classes.select("node", "c1", "c2", "id").join(parts.withColumnRenamed("id", "node"), "node", "left").select("c1", "c2", "id", F.coalesce("component", "node").alias("part"))
    least = every.groupBy("part").agg(F.min("id").alias("component_id"))
    of_class = scratch.save(every.join(least, "part").select("c1", "c2", "component_id"), "classes-done")
    done = signed.select("k1", "k2", "doc_id", "n", "c1", "c2").join(of_class, ["c1", "c2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return done.select("k1", "k2", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each component: that with the smallest doc_id; of its repeated rows, one. Shingles of five words."""
    found = near_duplicates(docs.select("doc_id", "text"), width).where("doc_id is null or doc_id = component_id").select("k1", "k2").distinct()
    keyed = docs.select(*row_keys("doc_id", "text"), F.struct(*docs.columns).alias("row"))
    kept = keyed.join(found, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return kept.select("row.*")
