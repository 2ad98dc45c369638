"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Texts become token ids, then the end id 2. A document is cut at every 4096 tokens; full pieces are
sequences of their own and the rest is packed. Pieces are dealt to groups by a hash of the row and
packed in each group by itself, largest first, each into the first sequence with room: the tree holds the
largest room below each node, so that sequence is found in logarithmic time. A group has about
``group_tokens`` tokens and ``group_rows`` pieces however large the table is, so only its last sequences
are padded: a quarter of a percent of the ids on sf0.1. A sequence whose ids are a power of two in number needs no padding.

Null and empty texts have the end id alone. Repeated rows and repeated or null doc_ids are documents of
their own. Other columns are not read. A table without rows gives no piece;
a very long text is encoded whole, in one task, and its pieces are packed like all others.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import Scratch, by_group, cache

LENGTH = 4096
END = 2
CACHE = 300_000

_RANGE = [chr(c) for c in range(0x21, 0x180) if c != 0x130]
_LETTER = "".join(c for c in _RANGE if unicodedata.category(c)[0] == "L")
_NUMBER = "".join(c for c in _RANGE if unicodedata.category(c)[0] == "N")
#: Characters for which the pieces below are those of the tokenizer: no marks, no rare spaces, no İ.
PLAIN = re.compile(r"[\t\n\x0b\x0c\r -~¡-įı-ſ]*")
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


class Words(dict):
    """Ids, as 16-bit bytes, of words met so far; at most ``CACHE`` of them are kept."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        letters = word if word.isascii() else self.bytes.pre_tokenize_str(word)[0][0]
        self[word] = out = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], "<u2").tobytes()
        return out

    def ids(self, text: str) -> np.ndarray:
        """Exactly the ids of the tokenizer's own encode(); words of plain text are looked up instead."""
        if PLAIN.fullmatch(text) and not ("<|" in text and SPECIAL.search(text)):
            return np.frombuffer(b"".join(map(self.__getitem__, PIECE.findall(text.lower()))), "<u2")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def words(path: str) -> Words:
    held = cache("packing")
    if path not in held:
        held[path] = Words(path)
    return held[path]


def _pieces(path: str | None, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path is None:
            import public_tokenizers

            known = words(public_tokenizers.path("word_bpe_49k.json"))
        else:
            known = words(path)
        row = 0
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(known.ids(text.as_py() or ""), END).astype("<u4")
                row += 1
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    for x, v in zip(out, (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), row), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    return run


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: largest items first, each into the first bin with room."""
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    tree = [room] * (2 * width)  # tree[i]: the largest room in the bins below i; the leaves are the bins
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[item], offsets[item] = node - width, room - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def _pack(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, ["grp"], 20_000):
            group = table.column("grp").to_numpy()
            edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
            sizes = table.column("length").to_numpy()
            for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                bins, offset[low:high] = first_fit_decreasing(sizes[low:high], length)
                sequence[low:high] = (group[low] << 32) + bins
            done = table.drop_columns(["grp", "row"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from done.to_batches()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, group_tokens: int = 1_000_000, group_rows: int = 50_000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long")
    # the written row number makes repeated rows distinct and stays the same when a task is run again
    pieces = scratch.save(pieces.withColumn("at", F.spark_partition_id()), "pieces")
    tokens, rows = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, round(tokens / group_tokens), -(-rows // group_rows))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("at", "row", "start"), F.lit(groups))).drop("at")
    dealt = dealt.repartition("grp").sortWithinPartitions("grp", F.desc("length"), "doc_id", "row", "start")
    return dealt.mapInArrow(_pack(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
