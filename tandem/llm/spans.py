"""Repeated windows of a corpus: anchored segments, the shared ground of substring and suffix-array dedup.

Every window of ``window`` tokens belongs to one anchor, the least k-gram inside it, which depends on
the window's content alone. Neighbouring windows with one anchor form a segment. So equal windows meet
under one anchor hash, and an anchor that occurs once proves all its windows unique without moving a
byte of text. What is left is made distinct (copies collapse to one segment with a count), fetched, and
judged anchor by anchor by the caller's kernel. An anchor with very many differing segments is first cut
into blocks of windows keyed by the tokens that all windows of the block share, then, if that is not
enough, into single windows, so no group that grows with the input is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm import kernels as K
from tandem.llm.common import Scratch, batch_slices, by_group, cache, row_keys, text_buffers

SLICE_BYTES = 1 << 20
#: Most differing segments of an anchor that are compared in one task.
HOT = 1024
#: Bytes of segments that a kernel is given at once (one anchor's may be more, up to ``HOT`` segments).
GROUP_BYTES = 1 << 19
#: Windows in a block of a hot anchor; then single windows.
WIDTHS = (24, 1)
SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False


@dataclass(frozen=True)
class Units:
    """How a text becomes tokens: its bytes, or its words ``[^\\x20\\x09-\\x0D]+`` as 64-bit hashes."""

    words: bool
    window: int
    gram: int

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.words:
            return data, offsets
        starts, ends, rows = K.word_spans(SPACE[data], offsets)
        return K.span_hashes(data, starts, ends), rows

    def raw(self, data: np.ndarray, tokens: np.ndarray) -> memoryview:
        return memoryview(np.ascontiguousarray(tokens if self.words else data)).cast("B")

    @property
    def size(self) -> int:
        return 8 if self.words else 1


Kernel = Callable[[pa.Table, Units], dict[str, np.ndarray]]

SEGMENT = "k1 long, k2 long, doc long, s int, nwin int, rel int, anchor long, g1 long, g2 long"
CONTENT = "anchor long, g1 long, g2 long, n long, md long, rel int, content binary"
PART = f"p1 long, p2 long, j int, {CONTENT}"
RUNS = "g1 long, g2 long, lo int, hi int, m long"


def _digests(raw: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    joined = b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _segments(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache("spans")
        for batch in batch_slices(batches, "text", SLICE_BYTES):
            data, offsets = text_buffers(batch.column("text"))
            tokens, rows = units.tokens(data, offsets)
            row, s1, s2, at, h = K.anchors(tokens, rows, units.window, units.gram)
            if not len(row):
                continue
            g = _digests(units.raw(data, tokens), s1 * units.size, (s2 + units.window) * units.size)
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("k1", "k2", "doc")), pa.array((s1 - rows[row]).astype(np.int32)), pa.array((s2 - s1 + 1).astype(np.int32)), pa.array((at - s1).astype(np.int32)), pa.array(_signed(h)), pa.array(np.ascontiguousarray(g[:, 0])), pa.array(np.ascontiguousarray(g[:, 1]))], ["k1", "k2", "doc", "s", "nwin", "rel", "anchor", "g1", "g2"])

    return run


def _fetch(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, "text", SLICE_BYTES):
            data, offsets = text_buffers(batch.column("text"))
            tokens, rows = units.tokens(data, offsets)
            raw = units.raw(data, tokens)
            wanted = batch.column("wanted")
            row = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            flat = wanted.flatten()
            low = (rows[row] + flat.field("s").to_numpy()) * units.size
            high = low + (flat.field("nwin").to_numpy() + units.window - 1).astype(np.int64) * units.size
            content = [raw[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            for at in range(0, len(content), 4096):
                part = flat.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([*(part.field(c) for c in ("anchor", "g1", "g2", "n", "md", "rel")), pa.array(content[at : at + 4096], pa.binary())], ["anchor", "g1", "g2", "n", "md", "rel", "content"])

    return run


def _split(units: Units, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of ``width`` windows at like distances from the anchor, keyed by the tokens all of them hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, "content", SLICE_BYTES // 8):
            out: list[tuple] = []
            for anchor, g1, g2, n, md, rel, content in zip(*(batch.column(c).to_pylist() for c in ("anchor", "g1", "g2", "n", "md", "rel", "content")), strict=True):
                count = len(content) // units.size - units.window + 1
                j = 0
                while j < count:
                    block = (rel - j) // width
                    after = min(count, rel - block * width + 1)
                    core = (rel - block * width) * units.size, (rel - block * width - width + 1 + units.window) * units.size
                    piece = content[j * units.size : (after - 1 + units.window) * units.size]
                    key = xxhash.xxh3_128_digest(content[core[0] : core[1]] + f"{anchor},{block}".encode())
                    ids = np.frombuffer(key[:8] + xxhash.xxh3_128_digest(piece + key), np.int64).tolist()
                    out.append((g1, g2, j, *ids, n, md, rel - j, piece))
                    j = after
            names = ["p1", "p2", "j", "anchor", "g1", "g2", "n", "md", "rel", "content"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            for at in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[at : at + 4096], strict=True), kinds, strict=True)], names)

    return run


def _compare(units: Units, kernel: Kernel, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache("spans")
        for group in by_group(batches, ["anchor"], rows, "content", GROUP_BYTES):
            found = kernel(group, units)
            if len(found["g1"]):
                yield pa.RecordBatch.from_arrays([pa.array(found[c]) if c != "m" or "none" not in found else pa.array(found[c], mask=found["none"]) for c in ("g1", "g2", "lo", "hi", "m")], ["g1", "g2", "lo", "hi", "m"])

    return run


def _settle(scratch: Scratch, found: DataFrame, units: Units, kernel: Kernel, rows: int, level: int = 0) -> DataFrame:
    """Repeated runs of windows of each distinct segment (g1, g2) of ``found``."""
    met = scratch.save(found.groupBy("anchor").agg(F.count("*").alias("v"), F.sum("n").alias("c")).where("c > 1"), f"met-{level}")
    crowded = met.where(F.col("v") > HOT).select("anchor")
    cold = found.join(met.where(F.col("v") <= HOT).select("anchor"), "anchor")
    settled = cold.repartition("anchor").sortWithinPartitions("anchor", "g1", "g2").mapInArrow(_compare(units, kernel, rows), RUNS)
    if level < len(WIDTHS) and not crowded.isEmpty():
        # repeated rows (doc_id and text) give a segment more than once
        hot = found.join(crowded, "anchor").groupBy("anchor", "g1", "g2").agg(*(F.first(c).alias(c) for c in ("n", "md", "rel", "content")))
        parts = scratch.save(hot.mapInArrow(_split(units, WIDTHS[level]), PART), f"parts-{level}")
        same = parts.groupBy("anchor", "g1", "g2").agg(F.sum("n").alias("n"), F.min("md").alias("md"), F.first("rel").alias("rel"), F.first("content").alias("content"))
        same = scratch.save(same, f"same-{level}")
        inner = _settle(scratch, same, units, kernel, rows, level + 1)
        back = parts.select("p1", "p2", "j", "g1", "g2").join(inner, ["g1", "g2"])
        settled = settled.unionByName(back.select(F.col("p1").alias("g1"), F.col("p2").alias("g2"), (F.col("lo") + F.col("j")).cast("int").alias("lo"), (F.col("hi") + F.col("j")).cast("int").alias("hi"), "m"))
    return settled


def repeats(docs: DataFrame, units: Units, kernel: Kernel, name: str, rows: int, later: bool) -> DataFrame:
    """Of ``docs`` (doc_id, text, any others): the keys of rows and ``cut``, the token ranges [a, b) to remove.

    ``later``: remove only windows that start in a document with a smaller doc_id too; otherwise all
    windows that start at two places or more.
    """
    scratch = Scratch(docs.sparkSession, name)
    keyed = docs.select(*row_keys("doc_id", "text"), F.col("doc_id").cast("long").alias("doc"), "text")
    found = scratch.save((keyed.where("doc is not null") if later else keyed).mapInArrow(_segments(units), SEGMENT), "segments")
    twice = found.groupBy("anchor").agg(F.count("*").alias("c"), F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 < d1" if later else "c > 1").select("anchor")
    # written first: a join of two plain shuffles is one whose hot keys Spark can split
    twice = scratch.save(twice, "twice")
    cand = scratch.save(found.join(twice, "anchor"), "candidates")
    for done in ("segments", "twice"):
        scratch.drop(done)
    distinct = cand.groupBy("anchor", "g1", "g2").agg(F.count("*").alias("n"), F.min("doc").alias("md"), F.min(F.struct("k1", "k2", "s", "nwin", "rel")).alias("at"))
    distinct = scratch.save(distinct, "distinct")
    wanted = distinct.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(F.collect_list(F.struct("anchor", "g1", "g2", "n", "md", F.col("at.s").alias("s"), F.col("at.nwin").alias("nwin"), F.col("at.rel").alias("rel"))).alias("wanted"))
    content = scratch.save(keyed.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).mapInArrow(_fetch(units), CONTENT), "content")
    scratch.drop("distinct")
    runs = scratch.save(_settle(scratch, content, units, kernel, rows), "runs")
    scratch.drop("content")
    marked = cand.select("k1", "k2", "doc", "s", "g1", "g2").join(runs, ["g1", "g2"])
    if later:
        marked = marked.where("m < doc")
    return marked.groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("s") + F.col("lo")).alias("a"), (F.col("s") + F.col("hi") + units.window).alias("b"))).alias("cut"))


def with_cuts(docs: DataFrame, **cuts: DataFrame) -> DataFrame:
    """``docs`` as text, ``row`` (the other columns) and a column of the ranges of each of ``cuts``, null for none."""
    out = docs.select(*row_keys("doc_id", "text"), "text", F.struct(*(c for c in docs.columns if c != "text")).alias("row"))
    for name, cut in cuts.items():
        out = out.join(cut.withColumnRenamed("cut", name), ["k1", "k2"], "left")
    return out.select("text", "row", *cuts)


def repeated(docs: DataFrame, units: Units, kernel: Kernel, name: str, rows: int, later: bool) -> DataFrame:
    """``docs`` as text, row and ``cut``, the token ranges to remove, as ``repeats`` finds them."""
    return with_cuts(docs, cut=repeats(docs, units, kernel, name, rows, later))


def cut_ranges(batch: pa.RecordBatch, base: np.ndarray, column: str = "cut") -> tuple[np.ndarray, np.ndarray]:
    """Token ranges of the batch's ``cut`` lists, as places in the concatenated tokens."""
    cut = batch.column(column)
    counts = cut.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), counts)
    flat = cut.flatten()
    return base[row] + flat.field("a").to_numpy(), base[row] + flat.field("b").to_numpy()


def rewritten(docs: DataFrame, cut: DataFrame, texts: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The rows and columns of ``docs`` with the texts that ``texts`` makes of ``cut``'s batches."""
    out = cut.mapInArrow(texts, T.StructType([T.StructField("text", T.StringType()), cut.schema["row"]]))
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
