"""Language ID by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A document is parsed from left to right
into phrases, each the longest match in the language's text (a letter that starts no match is a phrase),
and the language whose count of phrases, weighted by the logarithm of its text's size, is least wins: the
cross-parsing estimate of the entropy of the document under that language.

Text is lower-cased; whatever stands between letters is one space. The parse starts
anew every ``BLOCK`` letters, so that very long documents are parsed side by side; every block of the whole
text counts. A step is one lookup in the automaton's table, made for thousands of blocks at once.

The training text is bounded by parameters: about ``sample_docs`` documents of each language, those with the least
hashes of doc_id and text among the rows under a hash bound, until ``sample_chars`` letters are reached, or
``total_chars`` divided by the number of languages if that is less. All non-null values of ``lang`` among rows
that may be learned from are languages. The commonest ``DENSE`` letters have a column each in the automata's
tables; transitions by all other letters stand in a sorted list, so that any alphabet is told apart exactly.

The score is the softmax of minus four times the entropies (in bits a letter) over the languages. A null text or one without a letter
is ``und`` with score 0; with nothing to learn from, all are. Ties go to the language first in the alphabet.
Repeated rows are predicted alike; a null doc_id isn't held out. Other columns are kept. Very long texts are parsed whole; a
table without rows gives none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.common import batch_slices, cache, prepare, row_keys

BLOCK = 1024
SLICE = 1 << 20
#: Letters with a column of their own in the tables; one more column stands for all others.
DENSE = 63
_SPACES = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    return _SPACES.sub(" ", text.lower()).strip()


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        now = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = now
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return nexts


class Automaton:
    """One language's transitions. A place is the offset of a state's row in ``table``; an entry of it is twice the next
    place, plus 1 if the letter begins a phrase. ``keys`` and ``targets`` hold the letters from ``DENSE`` on."""

    def __init__(self, codes: np.ndarray, letters: int) -> None:
        nexts = suffix_automaton(codes.tolist())
        self.width, self.letters = min(letters, DENSE) + 1, letters
        table = np.full((len(nexts), self.width), -1, np.int64)
        rare = []
        for state, steps in enumerate(nexts):
            for c, to in steps.items():
                if c < DENSE:
                    table[state, c] = to
                else:
                    rare.append((state * letters + c, to))
        broken = table < 0
        step = np.where(broken, np.where(table[:1] < 0, 0, table[:1]), table)
        broken[0] = True  # whatever is read at the start begins a phrase
        self.table = (step * self.width * 2 + broken).astype(np.int32).ravel()
        self.keys, self.targets = np.array(sorted(rare), np.int64).reshape(-1, 2).T.copy()

    def read(self, places: np.ndarray, column: np.ndarray, other: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Entries for the next letters; those at ``other`` are the rare ones ``letter``, or unknown (beyond all)."""
        out = self.table[places + column]
        if len(other):
            out[other] = 1
            if len(self.keys):
                state = places[other] // self.width
                for at, begins in ((0 * state, 1), (state, 0)):  # from the start; then on with the phrase, where it goes on
                    key = at * self.letters + letter
                    i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    hit = (self.keys[i] == key) & (letter < self.letters)
                    out[other[hit]] = self.targets[i[hit]] * self.width * 2 + (begins | (at[hit] == 0))
        return out


class Model:
    """Automata of all languages over the letters of their texts, the commonest first."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(texts)
        every = np.frombuffer("".join(texts.values()).encode("utf-32-le"), np.uint32)
        letters, counts = np.unique(every, return_counts=True)
        letters = letters[np.argsort(-counts, kind="stable")]
        self.codes = np.full(0x110000, len(letters), np.int32)  # letters in no text
        self.codes[letters] = np.arange(len(letters))
        self.automata, self.weights = [], []
        for lang in self.langs:
            seq = self.codes[np.frombuffer(texts[lang].encode("utf-32-le"), np.uint32)]
            self.automata.append(Automaton(seq, len(letters)))
            self.weights.append(np.log2(max(2, len(seq))))

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits a letter of each text under each language; texts are normalised and not empty."""
        sizes = np.array([len(t) for t in texts])
        codes = self.codes[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        dense = self.automata[0].width - 1
        mixed = bool((codes >= dense).any())
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        blocks = -(-sizes // BLOCK)
        who = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(who)) - np.repeat(np.r_[0, np.cumsum(blocks)[:-1]], blocks)
        start = first[who] + nth * BLOCK
        length = np.minimum(BLOCK, sizes[who] - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        start, length, who = start[order], length[order], who[order]
        live = np.searchsorted(-length, -np.arange(int(length[0])), "left")
        phrases = np.zeros((len(self.langs), len(start)), np.int32)
        places = np.zeros((len(self.langs), len(start)), np.int32)
        none = np.zeros(0, np.int64)
        for t, n in enumerate(live.tolist()):
            letter = column = codes[start[:n] + t]
            other = rare = none
            if mixed:
                other = np.flatnonzero(letter >= dense)
                rare, column = letter[other].astype(np.int64), np.minimum(letter, dense)
            for i, automaton in enumerate(self.automata):
                now = automaton.read(places[i, :n], column, other, rare)
                phrases[i, :n] += now & 1
                places[i, :n] = now >> 1
        out = np.zeros((len(self.langs), len(texts)))
        for i in range(len(self.langs)):
            out[i] = np.bincount(who, phrases[i], len(texts)) * self.weights[i]
        return (out / sizes).T


def model_of(texts: dict[str, str]) -> Model:
    held = cache("language")
    key = hash(tuple(sorted(texts.items())))
    if key not in held:
        held.clear()
        held[key] = Model(texts)
    return held[key]


def _predict(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = shared.value
        model = model_of(texts) if texts else None
        for batch in batch_slices(batches, "text", SLICE):
            clean = [normalise(t or "") for t in batch.column("text").to_pylist()]
            full = [i for i, t in enumerate(clean) if any(map(str.isalpha, t))] if model else []
            lang, score = ["und"] * len(clean), np.zeros(len(clean))
            if full:
                bits = model.entropies([clean[i] for i in full])
                best = bits.argmin(1)
                odds = np.exp2(-(bits - bits.min(1, keepdims=True)) * 4)
                score[full] = 1 / odds.sum(1)
                for i, b in zip(full, best.tolist(), strict=True):
                    lang[i] = model.langs[b]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return run


def training_texts(docs: DataFrame, may_learn: Column, sample_docs: int, sample_chars: int, total_chars: int) -> dict[str, str]:
    """Normalised text per language; the rows and the text that are collected are bounded by the parameters."""
    usable = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return {}
    most = max(200, min(sample_chars, total_chars // len(counts)))
    # rows under a hash bound, some eight times as many as are used; repeated rows fall together before they are ranked
    bounds = docs.sparkSession.createDataFrame([(lang, int(min(1.0, 8 * sample_docs / n) * (1 << 30))) for lang, n in counts.items()], "lang string, bound long")
    some = usable.join(F.broadcast(bounds), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("bound"))
    kinds = some.groupBy("lang", *row_keys("doc_id", "text")).agg(F.first(F.substring("text", 1, 4 * most)).alias("text"))
    ranked = kinds.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("k1", "k2"))).where(F.col("i") <= sample_docs)
    out: dict[str, str] = {}
    for row in sorted(ranked.collect(), key=lambda r: (r.lang, r.i)):
        held = out.setdefault(row.lang, "")
        clean = normalise(row.text)
        if len(held) < most and clean:
            out[row.lang] = (held + " " + clean).strip()[:most]
    return {k: v for k, v in out.items() if v}


HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"


def identify(docs: DataFrame, train: DataFrame | None = None, sample_docs: int = 40, sample_chars: int = 30_000, total_chars: int = 240_000) -> DataFrame:
    """``row`` (all columns of ``docs``), lang_pred and score of every row; learns from ``train``, else ``docs``."""
    prepare(docs.sparkSession)
    texts = training_texts(docs if train is None else train, ~F.expr(HELD_OUT), sample_docs, sample_chars, total_chars)
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    given = docs.select("text", F.struct(*docs.columns).alias("row"))
    return given.mapInArrow(_predict(shared), T.StructType([T.StructField("row", given.schema["row"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_digest(docs: DataFrame) -> DataFrame:
    # lang is read for training alone: predictions see doc_id and text
    found = identify(docs.select("doc_id", "text"), docs)
    return found.select(F.col("row.doc_id").alias("doc_id"), F.expr(HELD_OUT.replace("doc_id", "row.doc_id")).alias("held_out"), "lang_pred", "score")


def reject_unknown(docs: DataFrame) -> DataFrame:
    """The documents in a learned language; those without text or letters go. Columns stay."""
    kept = identify(docs).where("lang_pred <> 'und'")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))

