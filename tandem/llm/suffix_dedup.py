"""Suffix-array dedup: windows of 400 bytes that start at more than one place lose all their bytes.

Suffixes are put in order through their first 400 bytes only, by most-significant-digit passes of eight
bytes; after the last pass the groups of equal suffixes are exactly the repeated windows, so no longest
common prefixes and no full suffix array are needed. The first digit, which deals the suffixes out over
the cluster, is the anchor of the window (see ``spans``), as it splits suffixes evenly where a fixed
prefix of natural text would not; suffixes whose anchor occurs once are sorted by it alone. All others go
through the passes. Of copies of a segment two stand for all; their windows are known to repeat, and are
compared only with those of which that isn't known yet.

Texts may lose repeated passages of words as well: a window of fifty words is fifty 64-bit hashes, so the
same passes take a word at a time. Both kinds of windows are judged on the input.

Texts are UTF-8 bytes; null and empty texts have no window, repeated rows are documents of their own,
matches never cross documents, and other columns of any name are kept. A table without rows gives none.
A very long text is cut into segments that overlap, so its windows are dealt out like all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import kernels as K
from tandem.llm.common import batch_slices, text_buffers
from tandem.llm.spans import SLICE_BYTES, SPACE, Units, cut_ranges, repeated, repeats, rewritten, with_cuts

DIGIT = 8
#: Bytes, and words, of an anchor.
GRAM, WORD_GRAM = 32, 8


def radix_repeats(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes of ``data`` share their first ``depth`` bytes with another one of their group.

    A suffix that is given twice repeats itself. It stays only as long as another might equal it.
    """
    out = np.zeros(len(starts), bool)
    if not len(starts):
        return out
    order = np.lexsort((starts, group))
    at, label = starts[order], group[order]
    again = np.r_[False, (at[1:] == at[:-1]) & (label[1:] == label[:-1])]
    place = np.cumsum(~again) - 1
    known = np.zeros(place[-1] + 1, bool)
    known[place[again]] = True
    out[order] = known[place]
    at, owner, label = at[~again], order[~again], label[~again]
    label = np.cumsum(np.r_[True, label[1:] != label[:-1]])
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)])
    digits = np.ndarray(len(data) + 1, dtype=">u8", buffer=padded, strides=(1,))

    def undecided(label: np.ndarray, known: np.ndarray) -> np.ndarray:
        edge = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        size = np.diff(np.r_[edge, len(label)])
        return np.repeat((size > 1) & (np.add.reduceat(known, edge, dtype=np.int64) < size), size)

    split = True
    for done in range(0, depth, DIGIT):
        if split:
            go = undecided(label, known)
            at, owner, label, known = at[go], owner[go], label[go], known[go]
        if not len(at):
            return out
        digit = digits[at + done].astype(np.uint64)
        if depth - done < DIGIT:
            digit >>= np.uint64(8 * (DIGIT - depth + done))
        edge = np.r_[True, label[1:] != label[:-1]]
        differs = ~edge[1:] & (digit[1:] != digit[:-1])
        split = bool(differs.any())
        if not split:
            continue
        # only groups whose digits differ are put in order
        place = np.cumsum(edge) - 1
        torn = np.zeros(place[-1] + 1, bool)
        torn[place[1:][differs]] = True
        move = np.flatnonzero(torn[place])
        order = move[np.lexsort((digit[move], place[move]))]
        at[move], owner[move], digit[move], known[move] = at[order], owner[order], digit[order], known[order]
        label = np.cumsum(np.r_[True, (place[1:] != place[:-1]) | (digit[1:] != digit[:-1])])
    out[owner[undecided(label, known)]] = True
    return out


def byte_kernel(table: pa.Table, units: Units) -> dict[str, np.ndarray]:
    """Runs of repeated windows of the segments of whole anchors."""
    anchor, g1, g2, n, rel = (table.column(c).to_numpy() for c in ("anchor", "g1", "g2", "n", "rel"))
    column = table.column("content").combine_chunks()
    data, offsets = text_buffers(column if isinstance(column, pa.Array) else column.chunk(0))
    keep = np.r_[True, (anchor[1:] != anchor[:-1]) | (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])]
    offsets = offsets // units.size
    counts = np.where(keep, np.diff(offsets) - units.window + 1, 0)
    seg = np.repeat(np.arange(len(counts)), counts)
    starts = K.spread(offsets[:-1], counts)
    place = starts - offsets[seg]
    starts *= units.size
    _, who = np.unique(anchor, return_inverse=True)
    group = who[seg].astype(np.int64) * (units.window + 1) + rel[seg] - place
    twin = np.flatnonzero(n[seg] > 1)  # a segment with copies stands there twice
    flag = radix_repeats(data, np.r_[starts, starts[twin]], np.r_[group, group[twin]], units.window * units.size)[: len(starts)]
    edge = np.flatnonzero(flag & np.r_[True, ~flag[:-1] | (seg[1:] != seg[:-1])]) if len(flag) else np.zeros(0, np.int64)
    stop = np.flatnonzero(flag & np.r_[~flag[1:] | (seg[1:] != seg[:-1]), True]) if len(flag) else np.zeros(0, np.int64)
    own = seg[edge]
    return {"g1": g1[own], "g2": g2[own], "lo": place[edge].astype(np.int32), "hi": place[stop].astype(np.int32), "m": np.zeros(len(own), np.int64), "none": np.ones(len(own), bool)}


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Batches, their bytes and offsets, and which bytes are in repeated windows of bytes, and of words where they were sought."""
    for batch in batch_slices(batches, "text", SLICE_BYTES):
        data, offsets = text_buffers(batch.column("text"))
        phrases = None
        if "phrases" in batch.schema.names:
            starts, ends, rows = K.word_spans(SPACE[data], offsets)
            first, after = cut_ranges(batch, rows[:-1], "phrases")
            phrases = K.covered(len(data), starts[first], ends[after - 1])
        yield batch, data, offsets, K.covered(len(data), *cut_ranges(batch, offsets[:-1])), phrases


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets, gone, phrases in _covered(batches):
        total = np.r_[0, np.cumsum(gone)]
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        heads = offsets[:-1][offsets[:-1] < len(gone)]
        first[heads] = gone[heads]
        runs = np.r_[0, np.cumsum(first)]
        sha = [hashlib.sha256(data[a:b][~gone[a:b]]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        columns = {"doc_id": batch.column("row").field("doc_id"), "n_bytes": np.diff(offsets), "n_removed": np.diff(total[offsets]), "n_spans": np.diff(runs[offsets]), "kept_sha256": sha}
        if phrases is not None:
            columns["n_passage_bytes"] = np.diff(np.r_[0, np.cumsum(phrases)][offsets])
        yield pa.RecordBatch.from_pydict(columns)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets, gone, phrases in _covered(batches):
        if phrases is not None:
            gone |= phrases
        kept = [data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") if x else None for a, b, x in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("text").is_valid().to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), batch.column("row")], ["text", "row"])


def removed_spans(docs: DataFrame, threshold: int = 400, gram: int = GRAM, words: int = 0) -> DataFrame:
    """``docs`` as text, row and the byte ranges ``cut`` (overlapping, in any order, null for none) to remove.

    With ``words``, ``phrases`` has the ranges of words of windows of so many words that start at two places or more.
    """
    if not words:
        return repeated(docs, Units(False, threshold, gram), byte_kernel, "suffix", 2000, later=False)
    cut = repeats(docs, Units(False, threshold, gram), byte_kernel, "suffix", 2000, later=False)
    phrases = repeats(docs, Units(True, words, min(WORD_GRAM, words)), byte_kernel, "suffix-words", 2000, later=False)
    return with_cuts(docs, cut=cut, phrases=phrases)


def dedup_texts(docs: DataFrame, threshold: int = 400, words: int = 0) -> DataFrame:
    """``docs`` without the repeated bytes; a character cut in half goes too. Columns and rows stay.

    ``words``: passages of at least so many words that start at two places or more go as well, however few their
    bytes, from the first byte of their first word to the last of their last; 0 for none. Words are
    ``[^\\x20\\x09-\\x0D]+``.
    """
    return rewritten(docs, removed_spans(docs, threshold, words=words), _texts)


def suffix_digest(docs: DataFrame, threshold: int = 400, words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, by the windows of bytes alone.

    With ``words`` also n_passage_bytes: the bytes of passages of at least so many words that start at two places or
    more, as ``dedup_texts`` finds them.
    """
    cut = removed_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), threshold, words=words)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return cut.mapInArrow(_digest, f"{schema}, n_passage_bytes long" if words else schema)
