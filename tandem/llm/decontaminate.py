"""Benchmark decontamination by winnowing.

Both sides are cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Of
every ``window - k + 1`` neighbouring k-grams the one with the least hash is kept as a fingerprint, so a
shared span of ``window`` words always shares a fingerprint. Fingerprints of documents are joined with
those of the benchmark; each hit is extended to the windows that may hold it, which are compared word by
word. An item shorter than a window is a window of its own and its one fingerprint is its whole gram.

The benchmark's fingerprints go to all executors in parts of at most ``PART_WORDS`` words: items are filled into
parts one after the other by their counts of words, a long item in pieces that overlap by a window less one word. A
benchmark of several parts takes one pass over the documents for each, one part at a time, and hits are merged by
document. Null, empty and wordless texts have no words; an item without words is ignored, as is a null
item_id in the list of items (its windows count). Words are held as 64-bit hashes. Repeated rows are judged alike, each
as a row of its own. Other columns of any name are kept. Without documents there is no row; without items nothing is contaminated.
Very long texts are judged whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm import kernels as K
from tandem.llm.common import Scratch, batch_slices, row_keys, text_buffers

SLICE_BYTES = 1 << 21
#: Words of benchmark text in one broadcast part.
PART_WORDS = 1_000_000
_table = np.zeros(256, bool)
_table[0x30:0x3A] = _table[0x41:0x5B] = _table[0x61:0x7B] = _table[0x80:] = True
WORD = _table


def folded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = K.word_spans(WORD[data], offsets)
    return K.span_hashes(data, starts, ends, K.FOLDED), rows


def winnow(words: np.ndarray, rows: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of rows of at least ``window`` words."""
    _, _, _, at, h = K.anchors(words, rows, window, k)
    at, first = np.unique(at, return_index=True)
    return at, h[first]


@dataclass
class Windows:
    """One part of the benchmark: its windows by length, and the fingerprints of the full ones."""

    window: int
    k: int
    words: np.ndarray
    items: list[str | None]
    #: By window length: sorted distinct hashes, a sample place of each, and the items of each (CSR).
    sets: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    prints: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    @classmethod
    def of(cls, items: list[str | None], texts: list[str | None], window: int, k: int) -> Windows:
        data, offsets = text_buffers(pa.array(texts, pa.string()))
        words, rows = folded_words(data, offsets)
        self = cls(window, k, words, items)
        lengths = np.diff(rows)
        for n in sorted({*np.minimum(lengths, window).tolist()} - {0}):
            own = np.flatnonzero(lengths >= window if n == window else lengths == n)
            counts = lengths[own] - n + 1
            places, who = K.spread(rows[own], counts), np.repeat(own, counts)
            hashes = K.gram_hashes(words, n)[places]
            order = np.lexsort((who, hashes))
            hashes, places, who = hashes[order], places[order], who[order]
            fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (who[1:] != who[:-1])]
            hashes, places, who = hashes[fresh], places[fresh], who[fresh]
            first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            self.sets[n] = hashes[first], places[first], np.r_[first, len(hashes)], who
        self.prints = np.unique(winnow(words, rows, window, k)[1])
        return self

    def hits(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths of the windows that occur in the rows, and the window's number in its set."""
        starts, sizes, which = [], [], []
        for n, (known, sample, _, _) in self.sets.items():
            if n == self.window:
                at, h = winnow(words, rows, self.window, self.k)
                at = at[K.member(h, self.prints) >= 0]
                # a fingerprint lies in windows that start up to window - k words before it
                near = K.covered(len(words), np.maximum(0, at - (self.window - self.k)), at + 1)
                near = np.flatnonzero(near)
                near = near[near + n <= len(words)]
            else:
                near = np.arange(max(0, len(words) - n + 1))
            if not len(near):
                continue
            row = np.searchsorted(rows, near, "right") - 1
            near = near[near + n <= rows[row + 1]]
            if not len(near):
                continue
            found = K.member(K.gram_hashes(words, n)[near], known)
            near, found = near[found >= 0], found[found >= 0]
            same = np.ones(len(near), bool)
            for j in range(n):  # extend: word by word, beyond the hash of the window
                same &= words[near + j] == self.words[sample[found] + j]
            starts.append(near[same])
            sizes.append(np.full(int(same.sum()), n))
            which.append(found[same])
        if not starts:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(which)

    def items_of(self, sizes: np.ndarray, which: np.ndarray) -> set[str]:
        out: set[int] = set()
        for n in np.unique(sizes).tolist():
            _, _, edge, who = self.sets[n]
            for w in np.unique(which[sizes == n]).tolist():
                out.update(who[edge[w] : edge[w + 1]].tolist())
        return {self.items[i] for i in out} - {None}


def _deal(window: int, part_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items, in pieces if long, with the part each belongs to; a part has at most ``part_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(2 * window, part_words // 4)
        part, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batch_slices(batches, "text", SLICE_BYTES):
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text"), strict=True):
                data, offsets = text_buffers(pa.array([text.as_py()], pa.string()))
                starts, ends, _ = K.word_spans(WORD[data], offsets)
                raw, pieces = data.tobytes(), []
                for low in range(0, max(1, len(starts) - window + 1), most - window + 1) if len(starts) else ():
                    high = min(len(starts), low + most)
                    if filled + high - low > part_words and filled:
                        part, filled = part + 1, 0
                    filled += high - low
                    pieces.append({"item_id": item, "text": raw[starts[low] : ends[high - 1]].decode(), "part": part})
                if pieces:
                    yield pa.RecordBatch.from_pylist(pieces, pa.schema([("item_id", pa.string()), ("text", pa.string()), ("part", pa.int64())]))

    return run


def _marks(shared, merge: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each row n_words, and its hits: their number and items, or the ranges themselves where parts are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: Windows = shared.value
        for batch in batch_slices(batches, "text", SLICE_BYTES):
            data, offsets = text_buffers(batch.column("text"))
            words, rows = folded_words(data, offsets)
            starts, sizes, which = part.hits(words, rows)
            order = np.argsort(starts, kind="stable")
            starts, sizes, which = starts[order], sizes[order], which[order]
            row = np.searchsorted(rows, starts, "right") - 1
            gone = np.r_[0, np.cumsum(K.covered(len(words), starts, starts + sizes))]
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            items: list[list[str]] = [[]] * batch.num_rows
            ranges: list[list[dict]] = [[]] * batch.num_rows
            for r in np.unique(row).tolist():
                own = slice(int(edge[r]), int(edge[r + 1]))
                items[r] = sorted(part.items_of(sizes[own], which[own]))
                if merge:
                    ranges[r] = [{"a": a, "b": a + n} for a, n in zip((starts[own] - rows[r]).tolist(), sizes[own].tolist(), strict=True)]
            out = [batch.column("row"), pa.array(np.diff(rows)), pa.array(gone[rows[1:]] - gone[rows[:-1]]), pa.array(items, pa.list_(pa.string()))]
            names = ["row", "n_words", "n_hit", "items"]
            if merge:
                out, names = [*out, pa.array(ranges, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], [*names, "ranges"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, items = [], []
        for n, ranges, lists in zip(batch.column("n_words").to_pylist(), batch.column("ranges").to_pylist(), batch.column("items").to_pylist(), strict=True):
            flat = [x for part in ranges for x in part]
            hit.append(int(K.covered(n, np.array([x["a"] for x in flat], np.int64), np.array([x["b"] for x in flat], np.int64)).sum()) if flat else 0)
            items.append(sorted({x for part in lists for x in part}))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "n_hit", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, part_words: int = PART_WORDS) -> DataFrame:
    """``row`` (all columns of ``docs``), n_words, n_hit and the sorted ``items`` that occur, for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    sized = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    letters = sized.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    spread = max(1, -(-int(letters) // (2 * part_words)))  # a word has two letters or more with what parts it
    dealt = scratch.save((sized.coalesce(1) if spread == 1 else sized.repartition(spread, "item_id", "text")).mapInArrow(_deal(window, part_words), "item_id string, text string, part long"), "items")
    numbers = sorted(r.part for r in dealt.select("part").distinct().collect()) or [0]

    def part(number: int) -> Broadcast:
        rows = sorted(dealt.where(F.col("part") == number).collect(), key=lambda r: (r.item_id or "", r.text))
        return spark.sparkContext.broadcast(Windows.of([r.item_id for r in rows], [r.text for r in rows], window, k))

    given = docs.select("text", F.struct(*docs.columns).alias("row"))
    if len(numbers) == 1:
        schema = T.StructType([T.StructField("row", given.schema["row"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])
        return given.mapInArrow(_marks(part(numbers[0]), False), schema)
    rowless = docs.select(*row_keys("doc_id", "text"), "text").dropDuplicates(["k1", "k2"])
    kinds = "row struct<k1: long, k2: long>, n_words long, n_hit long, items array<string>, ranges array<struct<a: long, b: long>>"
    found = rowless.select("text", F.struct("k1", "k2").alias("row"))
    passes = []
    for number in numbers:
        shared = part(number)
        passes.append(scratch.save(found.mapInArrow(_marks(shared, True), kinds), f"part-{number}"))
        shared.destroy()
    every = passes[0]
    for other in passes[1:]:
        every = every.unionByName(other)
    merged = every.groupBy("row").agg(F.first("n_words").alias("n_words"), F.collect_list("ranges").alias("ranges"), F.collect_list("items").alias("items"))
    merged = merged.mapInArrow(_merge, "row struct<k1: long, k2: long>, n_words long, n_hit long, items array<string>")
    wide = docs.select(*row_keys("doc_id", "text"), F.struct(*docs.columns).alias("row"))
    return wide.join(merged.select("row.*", "n_words", "n_hit", "items"), ["k1", "k2"]).drop("k1", "k2")


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns."""
    kept = contamination(docs, benchmark).where(f"not ({CONTAMINATED})")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"))


__all__ = ["Windows", "contamination", "contamination_digest", "decontaminate"]
