"""Merkle dataset manifest: a tree of SHA-256 digests over every group of documents, and one over the groups' roots.

Documents become leaves in built-in expressions and are sorted by range, so that a large group spreads over many
partitions. A partition resolves what lies wholly inside it: how many leaves a group has is known, so every run of
``arity`` siblings (the last of a level may be shorter) has a known length, and a run becomes its parent as soon as all
of it is there. What can't be resolved yet is a sparse forest: nodes keyed by tree, level and index. Two forests merge by
uniting their nodes and resolving every run that is now complete, whatever its level. That is associative and has the
empty forest as its neutral element, so ``treeReduce`` merges the forests of all partitions, whichever meet first. A group's
root is a leaf of the tree over all groups, in the same forest.

A partition leaves at most two nodes at either end of a level, so a forest holds some ``4 * levels`` nodes a partition, and there
are at most ``MOST_PARTS`` partitions. That bounds what the driver gets: the root, and the nodes of runs that partitions
share, which it sends back. With them a second pass over the leaves writes each document's path: the siblings before and
after it, level by level up to the root.

Null columns have a mark of their own, so a null is no empty string. Null groups are one group, the first; a null order
comes first in its group; equal ones go by the content of their leaf, and repeated rows are leaves of their own. A
table without rows has no manifest. Very long texts are hashed where they are and go no further. Other columns stay out
of the leaf and may have any name.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import Scratch, by_group

ARITY = 3
#: Leaves of a partition, and most partitions.
PART_ROWS, MOST_PARTS = 16_384, 8192
#: The tree over the groups' roots; groups' trees are numbered from 0.
TOP = -1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

Forest = dict[tuple[int, int, int], str]


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a document: of each column its length in bytes and its value, or a dash for null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]
    return F.sha2(F.concat(*parts), 256)


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def count_at(leaves: int, level: int, arity: int) -> int:
    """Nodes of a level of a tree of so many leaves."""
    for _ in range(level):
        leaves = -(-leaves // arity)
    return leaves


def levels_of(first: int, digests: list[str], leaves: int, arity: int) -> list[tuple[int, list[str]]]:
    """By level the first index and the digests of the nodes that neighbouring leaves (the ``first`` and following) resolve."""
    out = [(first, digests)]
    while digests and leaves > 1:
        end = first + len(digests)
        low, above = -(-first // arity), -(-leaves // arity)
        high = above if end == leaves else end // arity
        digests = [joined(digests[arity * i - first : min(arity * (i + 1), leaves) - first]) for i in range(low, high)]
        first, leaves = low, above
        if digests:
            out.append((first, digests))
    return out


def unresolved(tree: int, found: list[tuple[int, list[str]]], arity: int) -> Forest:
    """The nodes of ``levels_of`` that have no parent there."""
    out: Forest = {}
    for level, (first, digests) in enumerate(found):
        low, many = found[level + 1] if level + 1 < len(found) else (0, [])
        for at, digest in enumerate(digests, first):
            if not low <= at // arity < low + len(many):
                out[tree, level, at] = digest
    return out


class Fragment:
    """A sparse forest: nodes that wait for siblings, and those of the runs that were completed by merging."""

    def __init__(self, waiting: Forest | None = None, known: Forest | None = None) -> None:
        self.waiting, self.known = waiting or {}, known or {}

    def merge(self, other: Fragment, leaves: dict[int, int], arity: int) -> Fragment:
        """The forest of both, with every run resolved that is complete now. ``leaves``: of each tree that partitions share."""
        few, many = sorted((self, other), key=lambda f: len(f.waiting))
        out = Fragment({**many.waiting, **few.waiting}, {**self.known, **other.known})
        out.resolve(list(few.waiting), leaves, arity)
        return out

    def resolve(self, nodes: list[tuple[int, int, int]], leaves: dict[int, int], arity: int) -> None:
        while nodes:
            tree, level, at = nodes.pop()
            if (tree, level, at) not in self.waiting:
                continue  # a sibling has taken it along
            count = count_at(leaves[tree], level, arity)
            if count == 1:
                if tree != TOP:  # a group's root is a leaf of the tree over the groups
                    self.waiting[TOP, 0, tree] = self.waiting.pop((tree, level, at))
                    nodes.append((TOP, 0, tree))
                continue
            run = [(tree, level, i) for i in range(at - at % arity, min(at - at % arity + arity, count))]
            if all(node in self.waiting for node in run):
                own = {node: self.waiting.pop(node) for node in run}
                self.known.update(own)
                above = (tree, level + 1, at // arity)
                self.waiting[above] = joined(list(own.values()))
                nodes.append(above)


class Part:
    """The trees of one partition's leaves: of its groups, and of the groups' roots as far as they are resolved."""

    def __init__(self, table: pa.Table, place: tuple[int, int, int, int], groups: int, arity: int) -> None:
        self.table, self.arity, self.groups = table, arity, groups
        self.first, before, first_leaves, last_leaves = place
        own = table.column("source").combine_chunks().dictionary_encode()
        own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
        code = own.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True]).tolist()
        digests = table.column("leaf").to_pylist()
        self.ranges, self.trees, self.counts = list(zip(edge[:-1], edge[1:], strict=True)), [], []
        for i, (low, high) in enumerate(self.ranges):
            leaves = first_leaves if i == 0 else last_leaves if i == len(self.ranges) - 1 else high - low
            self.counts.append(leaves)
            self.trees.append(levels_of(before if i == 0 else 0, digests[low:high], leaves, arity))
        whole = [len(found) > 0 and count_at(n, len(found) - 1, arity) == 1 for found, n in zip(self.trees, self.counts, strict=True)]
        # the groups that end here are neighbours: only the first and the last can go on elsewhere
        done = [i for i, w in enumerate(whole) if w]
        self.top = levels_of(self.first + done[0], [self.trees[i][-1][1][0] for i in done], groups, arity) if done else []
        self.open = [i for i, w in enumerate(whole) if not w]

    def forest(self) -> Forest:
        out = unresolved(TOP, self.top, self.arity)
        for i in self.open:
            out.update(unresolved(self.first + i, self.trees[i], self.arity))
        return out

    def path(self, tree: int, found: list[tuple[int, list[str]]], leaves: int, known: Forest) -> Callable[[int, int], list[tuple[str, str]]]:
        """Of a node its siblings before and after it, level by level up to its tree's root."""
        held: dict[int, tuple[int, list[tuple[str, str]]]] = {}
        counts = [leaves]
        while counts[-1] > 1:
            counts.append(-(-counts[-1] // self.arity))

        def digest(level: int, at: int) -> str:
            if level < len(found):
                first, digests = found[level]
                if first <= at < first + len(digests):
                    return digests[at - first]
            return known[tree, level, at]

        def path(level: int, at: int) -> list[tuple[str, str]]:
            if counts[level] == 1:
                return []
            if level not in held or held[level][0] != at:
                low = at - at % self.arity
                run = range(low, min(low + self.arity, counts[level]))
                pair = ("".join(digest(level, i) for i in run if i < at), "".join(digest(level, i) for i in run if i > at))
                held[level] = (at, [pair, *path(level + 1, at // self.arity)])
            return held[level][1]

        return path

    def paths(self, known: Forest, root: str) -> pa.RecordBatch:
        n = self.table.num_rows
        sides: tuple[list[str], list[str]] = ([], [])
        offsets, subroots = np.zeros(n + 1, np.int32), []
        over = self.path(TOP, self.top, self.groups, known)
        for i, (low, high) in enumerate(self.ranges):
            tree = self.first + i
            above = over(0, tree)
            subroots += [(known[TOP, 0, tree] if i in self.open else self.trees[i][-1][1][0])] * (high - low)
            inside, first = self.path(tree, self.trees[i], self.counts[i], known), self.trees[i][0][0]
            for at in range(low, high):
                for left, right in [*inside(0, first + at - low), *above]:
                    sides[0].append(left)
                    sides[1].append(right)
                offsets[at + 1] = len(sides[0])
        pairs = pa.StructArray.from_arrays([pa.array(sides[0], pa.string()), pa.array(sides[1], pa.string())], ["left", "right"])
        out = self.table.drop_columns(["part", "salt"]).combine_chunks()
        out = out.append_column("subroot", pa.array(subroots, pa.string())).append_column("root", pa.array([root] * n, pa.string()))
        return out.append_column("path", pa.ListArray.from_arrays(pa.array(offsets), pairs)).combine_chunks().to_batches()[0]


def _parts(batches: Iterator[pa.RecordBatch], shared, arity: int) -> Iterator[Part]:
    places, groups = shared.value
    for table in by_group(batches, ["part"], 1):
        part = table.column("part").to_numpy()
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]).tolist()
        for low, high in zip(edge[:-1], edge[1:], strict=True):
            yield Part(table.slice(low, high - low), places[int(part[low])], groups, arity)


def _forests(shared, arity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, shared, arity):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part.forest())], pa.binary())], ["forest"])

    return run


def _paths(shared, resolved, arity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, root = resolved.value
        for part in _parts(batches, shared, arity):
            yield part.paths(known, root)

    return run


def _places(edges: list) -> tuple[dict[int, tuple[int, int, int, int]], dict[int, int], int]:
    """By part: number of its first group, leaves of that in earlier parts, leaves of its first and its last group in all; leaves by tree."""
    first_of, before, totals, last, key = {}, {}, {}, -1, None
    for part, low, many in sorted((e["part"], e["low"], e) for e in edges):
        last += low["key"] != key
        first_of[part], before[part] = last, totals.get(last, 0) if low["key"] == key else 0
        totals[last] = before[part] + low["n"]
        if many["groups"] > 1:
            last += many["groups"] - 1
            totals[last] = many["high"]["n"]
        key = many["high"]["key"]
    places = {e["part"]: (first_of[e["part"]], before[e["part"]], totals[first_of[e["part"]]], totals[first_of[e["part"]] + e["groups"] - 1]) for e in edges}
    return places, {**totals, TOP: last + 1}, last + 1


def manifest(leaves: DataFrame, arity: int = ARITY, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows of ``leaves`` (doc_id, source, leaf and others) with subroot, root and path, an array of (left, right).

    Folding a leaf along its path, by the digest of left, node and right joined, gives the root. Names that begin with an underscore
    aside, columns called part, salt, subroot, root or path aren't allowed.
    """
    scratch = Scratch(leaves.sparkSession, "merkle")
    kept = scratch.save(leaves.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    parts = max(1, min(MOST_PARTS, -(-kept.count() // part_rows)))
    order = ["source", "doc_id", "leaf", "salt"]
    # the range of a row is written with it, so that later jobs see the same parts
    dealt = scratch.save(kept.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "dealt")
    scratch.drop("leaves")
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    counts = dealt.groupBy("part", key.alias("name")).agg(F.count("*").alias("n")).select("part", "name", F.struct(F.sha2("name", 256).alias("key"), "n").alias("own"))
    edges = counts.groupBy("part").agg(F.min_by("own", "name").alias("low"), F.max_by("own", "name").alias("high"), F.count("*").alias("groups")).collect()
    names = [f for f in leaves.schema.fields]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", subroot string, root string, path array<struct<left: string, right: string>>"
    if not edges:
        return leaves.sparkSession.createDataFrame([], kinds)
    context = leaves.sparkSession.sparkContext
    places, totals, groups = _places(edges)
    shared, counted = context.broadcast((places, groups)), context.broadcast(totals)
    by_part = dealt.repartition(parts, "part").sortWithinPartitions("part", *order)
    forests = by_part.select("part", "source", "leaf", "doc_id", "salt").mapInArrow(_forests(shared, arity), "forest binary")
    whole = forests.rdd.map(lambda row: Fragment(pickle.loads(row.forest))).treeReduce(lambda a, b: a.merge(b, counted.value, arity))
    whole.resolve(list(whole.waiting), totals, arity)
    root = next(iter(whole.waiting.values()))
    resolved = context.broadcast(({**whole.known, **whole.waiting}, root))
    return by_part.mapInArrow(_paths(shared, resolved, arity), kinds)


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf of documents."""
    return docs.select("doc_id", "source", leaf({c: F.col(c) for c in COLUMNS}).alias("leaf"))


def folded(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda digest, pair: F.sha2(F.concat(pair["left"], digest, pair["right"]), 256))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: every document's proof, checked against its leaf after some texts lost their line ends."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    changed = {**{c: F.col(c) for c in COLUMNS}, "text": F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    leaves = docs.select("doc_id", "source", leaf({c: F.col(c) for c in COLUMNS}).alias("leaf"), leaf(changed).alias("seen"))
    out = manifest(leaves).withColumn("folded_root", folded(F.col("seen"), F.col("path")))
    proof = F.sha2(F.array_join(F.transform("path", lambda pair: F.concat(pair["left"], pair["right"])), ""), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
