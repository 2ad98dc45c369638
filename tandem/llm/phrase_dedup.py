"""Substring dedup with repeated-phrase automata: 50-word windows first seen in a smaller doc_id go.

Windows that recur are confirmed among the distinct segments of each anchor (see ``spans``), joined to passages
where neighbours always recur together, and compiled
into Aho-Corasick automata, each a shard of bounded size over a word alphabet of its own. Documents are
cut into segments that are dealt to the shards by their anchor, as a phrase can only occur under its own
anchor; all segments of a shard's anchors are streamed through it to locate every occurrence. The matches alone
tell where windows recur and which is the smallest doc_id of each. Segments of identical content are
streamed once, with their count and smallest doc_id; one whose anchor occurs in a single document has no
recurring phrase and isn't streamed.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a word is held as a 64-bit hash and a window as fifty of them
in order. Null text has no words; a row with null doc_id removes nothing and loses nothing; rows that
share a doc_id don't remove from each other. Other columns of any name are kept. Empty text has no words; a very
long text is streamed in segments, whole; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import kernels as K
from tandem.llm.common import batch_slices, text_buffers
from tandem.llm.spans import SLICE_BYTES, SPACE, Units, cut_ranges, repeated, rewritten

#: Passages in one automaton, some fifty to a hundred nodes each.
SHARD = 6_000


def _letters(tokens: np.ndarray) -> str:
    """The tokens as characters of an alphabet of the batch's own."""
    _, code = np.unique(tokens, return_inverse=True)
    code = code.astype(np.uint32) + 1
    code[code >= 0xD800] += 0x800
    return code.astype("<u4").tobytes().decode("utf-32-le")


def recurring(hashes: np.ndarray, seg: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed passages: the first window and the number of windows of each.

    Windows recur if they are met twice, or in a segment with copies. Neighbours that are always met together, each
    occurrence of one right after one of the other, are one passage, so that a phrase is as long as it can be.
    """
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(hashes, kind="stable")
    edge = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
    met = np.diff(np.r_[edge, len(order)])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.repeat(np.arange(len(edge)), met)
    copied = np.zeros(len(edge), bool)
    copied[kind[n[seg] > 1]] = True
    # sums of hashed places name the set of a kind's occurrences, and the set one window earlier
    place = np.arange(1, len(order) + 1, dtype=np.uint64)
    joint = np.r_[False, seg[1:] == seg[:-1]]
    with np.errstate(over="ignore"):
        here = np.add.reduceat(K.mix(place)[order], edge)
        before = np.add.reduceat(np.where(joint, K.mix(place - np.uint64(1)), K.mix(~place))[order], edge)
    follows = np.r_[joint[1:] & (here[kind[:-1]] == before[kind[1:]]), False]
    heads = np.flatnonzero(((met > 1) | copied)[kind] & ~np.r_[False, follows[:-1]])
    _, fresh = np.unique(kind[heads], return_index=True)
    heads = np.sort(heads[fresh])
    last = np.flatnonzero(~follows)
    return heads, last[np.searchsorted(last, heads)] - heads + 1


def phrase_kernel(table: pa.Table, units: Units) -> dict[str, np.ndarray]:
    """Runs of windows with the smallest doc_id that holds them, for the segments of whole anchors."""
    anchor, g1, g2, md, n = (table.column(c).to_numpy() for c in ("anchor", "g1", "g2", "md", "n"))
    column = table.column("content").combine_chunks()
    data, offsets = text_buffers(column if isinstance(column, pa.Array) else column.chunk(0))
    tokens, offsets = np.frombuffer(data.tobytes(), np.uint64), offsets // 8
    keep = np.r_[True, (anchor[1:] != anchor[:-1]) | (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])]
    counts = np.where(keep, np.diff(offsets) - units.window + 1, 0)
    seg = np.repeat(np.arange(len(counts)), counts)
    starts = K.spread(offsets[:-1], counts)
    hashes = K.gram_hashes(tokens, units.window)[starts]
    passages, lengths = recurring(hashes, seg, n)
    none = np.iinfo(np.int64).min
    best = np.full(len(starts), none, np.int64)
    letters = _letters(tokens) if len(passages) else ""
    first = np.r_[0, np.cumsum(counts)] + 1
    streamed = np.flatnonzero(counts).tolist()
    for low in range(0, len(passages), SHARD):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        sizes = lengths[low : low + SHARD] + units.window - 1
        for phrase, (at, size) in enumerate(zip(starts[passages[low : low + SHARD]].tolist(), sizes.tolist(), strict=True)):
            automaton.add_word(letters[at : at + size], phrase)
        automaton.make_automaton()
        ends, which = [], []
        for s in streamed:
            for end, phrase in automaton.iter(letters[offsets[s] : offsets[s + 1]]):
                ends.append(first[s] + end)
                which.append(phrase)
        phrases = np.array(which, np.int64)
        at = np.array(ends, np.int64) - sizes[phrases]  # the first window of each match
        least = np.full(len(sizes), np.iinfo(np.int64).max)
        np.minimum.at(least, phrases, md[seg[at]])
        width = lengths[low : low + SHARD][phrases]
        best[K.spread(at, width)] = np.repeat(least[phrases], width)
    flag = best != none
    cut = np.r_[True, (seg[1:] != seg[:-1]) | (best[1:] != best[:-1])] if len(best) else np.zeros(0, bool)
    head = np.flatnonzero(cut)
    tail = np.r_[head[1:], len(best)] - 1
    use = flag[head] if len(head) else np.zeros(0, bool)
    head, tail = head[use], tail[use]
    own, place = seg[head], starts - offsets[seg]
    return {"g1": g1[own], "g2": g2[own], "lo": place[head].astype(np.int32), "hi": place[tail].astype(np.int32), "m": best[head]}


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[bytes]]]:
    for batch in batch_slices(batches, "text", SLICE_BYTES):
        data, offsets = text_buffers(batch.column("text"))
        starts, ends, rows = K.word_spans(SPACE[data], offsets)
        gone = K.covered(len(starts), *cut_ranges(batch, rows[:-1]))
        raw, texts = data.tobytes(), []
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            left = ~gone[a:b]
            texts.append(b" ".join([raw[x:y] for x, y in zip(starts[a:b][left].tolist(), ends[a:b][left].tolist(), strict=True)]))
        yield batch, rows, gone, texts


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, rows, gone, texts in _kept(batches):
        total = np.r_[0, np.cumsum(gone)]
        yield pa.RecordBatch.from_arrays([batch.column("row").field("doc_id"), pa.array(np.diff(rows)), pa.array(total[rows[1:]] - total[rows[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in texts])], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, _, texts in _kept(batches):
        valid = batch.column("text").is_valid().to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() if v else None for t, v in zip(texts, valid, strict=True)], pa.string()), batch.column("row")], ["text", "row"])


def removed_phrases(docs: DataFrame, window: int = 50, gram: int = 8) -> DataFrame:
    """``docs`` as text, row and the word ranges ``cut`` to remove."""
    return repeated(docs, Units(True, window, gram), phrase_kernel, "phrases", 1000, later=True)


def dedup_phrases(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with its kept words joined by single spaces. Columns and rows stay."""
    return rewritten(docs, removed_phrases(docs, window), _texts)


def phrase_digest(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    cut = removed_phrases(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window)
    return cut.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
