"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both token lists of a text are lists of byte ranges. The ranges of B are a static interval index: sorted starts and
ends. Two bisections for each token of A give the tokens of B that it overlaps, and one for each gap between tokens
of A tells whether a token of B spans it. Gaps that none spans bound the groups: the least stretches that hold whole tokens of both.

A long text is read in pieces of some ``PIECE`` characters that begin at a space between a character that isn't white space and another character.
No token of either tokenizer reaches over such a place (A's word pattern has a space at its start only; no piece of B
has its mark for a space after another character), so the tokens are those of the whole text, and memory doesn't follow its length.

Tokens of A and B that end at the same byte are linked: the shorter is the other's ending. So there are no more
kinds of linked pairs than tokens that are endings of others (``most_pairs``, 346,000 here), however large the corpus
is, and their counts fit each worker. Counting them is one aggregation over distinct pairs of a document.

Null and empty texts, and those whose tokens don't give back their bytes, have no tokens. Repeated rows and repeated or
null doc_ids are documents of their own. Other columns aren't read; a table without rows gives none.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import Scratch, cache

#: Where a text can be cut for both tokenizers (a space alone would be nothing to B), and characters of a piece.
SAFE = re.compile(r"(?<=\S)(?= (?s:.))")
PIECE = 500_000
SPACE = "▁"
SHIFT = 32


def pieces(text: str) -> Iterator[str]:
    """A space and the text, cut at safe places."""
    text, low = f" {text}", 0
    while low < len(text):
        cut = SAFE.search(text, low + PIECE) if len(text) > low + PIECE else None
        high = cut.start() if cut else len(text)
        yield text[low:high]
        low = high


@dataclass(frozen=True)
class Alignment:
    """Ids and byte ends of both lists, and the token counts at which groups end."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each token of A the first and the last of B that share a byte with it, by bisection of B's ends and starts."""
        return np.searchsorted(self.b_ends, np.r_[0, self.a_ends[:-1]], "right"), np.searchsorted(np.r_[0, self.b_ends[:-1]], self.a_ends) - 1

    def pairs(self) -> np.ndarray:
        """The linked pairs, A's id above B's."""
        return self.a_ids[self.a_cuts - 1] << SHIFT | self.b_ids[self.b_cuts - 1]


def aligned(a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> Alignment:
    """The groups between the gaps of A that no token of B spans: each gap stabs B's ranges, by bisection of their ends."""
    across = np.searchsorted(b_ends, a_ends)  # the token of B that ends at the gap, or else spans it
    cut = b_ends[across] == a_ends
    return Alignment(a_ids, b_ids, a_ends, b_ends, np.flatnonzero(cut) + 1, across[cut] + 1)


class Aligner:
    """Two tokenizers, A byte-level and B of pieces."""

    def __init__(self, a_path: str, b_path: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, lines)}
        # without special tokens: their strings in a text are ordinary text
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # ids in decimal, with what follows them: of A a comma or, at a group's end, a bar; of B a comma or a semicolon
        words = [f"{i}{mark}" for n, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for mark in marks for i in range(n)]
        self.words = np.array(words, object)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def align(self, text: str) -> Alignment | None:
        """Of a text that begins with a space, without which B gets it; none if the tokens' bytes aren't the text's."""
        data = text.encode()
        a, b = self.a.encode_ordinary(text), self.b.encode(text[1:], num_threads=1)
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        # a byte-level tokenizer gives back all bytes; so their number tells
        if a_ends[-1] != len(data) or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return aligned(a_ids, b_ids, a_ends, b_ends)

    def groups(self, found: Alignment) -> str:
        """Groups as ``a1,a2|b1;a3|b2,b3;``, built from both lists in the order of the groups."""
        a, b = len(self.a_bytes), len(self.b_bytes)
        a_word, b_word = found.a_ids.copy(), found.b_ids + 2 * a
        a_word[found.a_cuts - 1] += a
        b_word[found.b_cuts - 1] += b
        own = (np.repeat(x, np.diff(np.r_[0, y])) for x, y in ((np.r_[0, found.b_cuts[:-1]], found.a_cuts), (found.a_cuts, found.b_cuts)))
        order = np.empty(len(a_word) + len(b_word), np.int64)
        for word, before in zip((a_word, b_word), own, strict=True):
            order[np.arange(len(word)) + before] = word
        return "".join(self.words[order].tolist())

    def digest(self, text: str | None) -> tuple[int, int, int, str, np.ndarray]:
        """Numbers of tokens and groups, digest of the groups, and the linked pairs of a whole text."""
        none = (0, 0, 0, "", np.zeros(0, np.int64))
        if not text:
            return none
        sizes, sha, links, held = np.zeros(3, np.int64), hashlib.sha256(), [], ""
        for piece in pieces(text):
            found = self.align(piece)
            if found is None:
                return none
            sizes += (len(found.a_ids), len(found.b_ids), len(found.a_cuts))
            links.append(found.pairs())
            sha.update(held.encode())
            held = self.groups(found)
        sha.update(held[:-1].encode())  # without the last semicolon
        n_a, n_b, n_groups = sizes.tolist()
        return n_a, n_b, n_groups, sha.hexdigest(), np.concatenate(links)

    def whole(self, text: str | None) -> Alignment | None:
        """The alignment of a whole text; none if it has no tokens."""
        found = [self.align(piece) for piece in pieces(text)] if text else [None]
        if any(x is None for x in found):
            return None
        shift, parts = {"a": 0, "b": 0, "end": 0}, []
        for x in found:
            parts.append(Alignment(x.a_ids, x.b_ids, x.a_ends + shift["end"], x.b_ends + shift["end"], x.a_cuts + shift["a"], x.b_cuts + shift["b"]))
            shift = {"a": shift["a"] + len(x.a_ids), "b": shift["b"] + len(x.b_ids), "end": int(parts[-1].a_ends[-1])}
        return Alignment(*(np.concatenate([getattr(x, name) for x in parts]) for name in _LISTS[:6]))

    def most_pairs(self) -> int:
        """Bound of the kinds of linked pairs: a token of one and an ending of it that is a token of the other."""
        a, b = self.a_bytes, self.b_bytes
        count = 0
        for long, short in ((a, b), (b, a)):
            many: dict[bytes, int] = {}
            for x in short:
                many[x] = many.get(x, 0) + 1
            count += sum(many.get(x[i:], 0) for x in long for i in range(len(x)))
        return count


def aligner(a: str | None = None, b: str | None = None) -> Aligner:
    """The worker's own, loaded once."""
    held = cache("token_align")
    if (a, b) not in held:
        import public_tokenizers

        # the ranks of the byte-level tokenizer: the same ids as those of its JSON file, several times as fast
        held[a, b] = Aligner(a or public_tokenizers.path("byte_bpe_50k.tiktoken"), b or public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return held[a, b]


_LISTS = ("a_ids", "b_ids", "a_ends", "b_ends", "a_cuts", "b_cuts", "first", "last")


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """By document: ids and byte ends of both token lists (in a space and the text), the token counts at which groups end, and of each token of A the first and last of B it overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(a, b)
        for batch in batches:
            found = [tools.whole(text) for text in batch.column("text").to_pylist()]
            values = [(*(getattr(x, name) for name in _LISTS[:6]), *x.overlaps()) if x else [[]] * len(_LISTS) for x in found]
            lists = [pa.array([x[i] for x in values], pa.list_(pa.int64())) for i in range(len(_LISTS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", *_LISTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    Scratch(docs.sparkSession, "alignment")  # for the session's settings
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{name} array<bigint>" for name in _LISTS))


def _digests(a: str | None, b: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(a, b)
        for batch in batches:
            found = [tools.digest(text.as_py()) for text in batch.column("text")]
            kinds, times = [], []
            for *_, pairs in found:
                kind, many = np.unique(pairs, return_counts=True)
                kinds.append(kind)
                times.append(many.astype(np.int32))
            offsets = pa.array(np.cumsum([0, *map(len, kinds)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.zeros(0, t)]).astype(t))) for x, t in ((kinds, np.int64), (times, np.int32))]
            columns = [pa.array([x[i] for x in found], pa.string() if i == 3 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *lists], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    return run


def _counted(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up, for each document, its links, those of their B token's commonest kind, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(pairs, lists.flatten().to_numpy())
            ends = np.cumsum(np.r_[0, lists.value_lengths().to_numpy()])
            sums = [np.diff(np.r_[0, np.cumsum(x)][ends]) for x in (times, times * best[at], times * counts[at])]
            columns = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in sums), batch.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def alignment_digest(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """The contract's columns: sizes of the alignment, its links judged by the counts of all documents, and a digest of its groups."""
    scratch = Scratch(docs.sparkSession, "alignment")
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<bigint>, times array<int>"
    found = scratch.save(docs.select("doc_id", "text").mapInArrow(_digests(a, b), own), "found")
    each = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")).toArrow().combine_chunks().sort_by("pair")
    pairs, n = (counts.column(c).to_numpy() for c in ("pair", "n"))
    # one kind at most for every token and ending of it, whatever the corpus
    if len(pairs) > (most := aligner(a, b).most_pairs()):
        raise RuntimeError(f"{len(pairs)} kinds of pairs, more than the {most} that the vocabularies allow")
    b_id = pairs & ((1 << SHIFT) - 1)
    top = np.zeros(int(b_id.max(initial=0)) + 1, np.int64)
    np.maximum.at(top, b_id, n)
    shared = docs.sparkSession.sparkContext.broadcast((pairs, n, (n == top[b_id]).astype(np.int64)))
    kinds = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return found.mapInArrow(_counted(shared), kinds)


