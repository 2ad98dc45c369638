"""Toxicity by classifier chains.

Categories are predicted one after the other: each has a linear (logistic) model over word features and
the probabilities of the categories before it. The models are trained with out-of-fold predictions: what
a later model sees of an earlier category during training comes from models that hadn't seen the document,
as will be so for new documents. The models of the folds are learned in tasks of their own. The categories are conditions on the columns of ``labels``, in the order
of the chain; ``toxic`` stands last, sees the others, and gives the decision, at the probability with the best
out-of-fold F1.

Features are the presence of words (A-Z lower-cased, letters and bytes beyond ASCII) and of their first 3 to
6 bytes, so that inflected forms count; the ``most`` with the strongest association with any category are
used, and no more than there are documents to learn from. Training takes about ``sample`` labelled documents of each value of ``toxic``, chosen by a hash of
doc_id, of each at most ``sample_chars`` characters; that bound is all that is collected. Labels that are null, or
for absent documents, aren't used. Of several labels of a doc_id a category holds if it does in any; of several texts
of a doc_id that with the least hash is learned from.

Every whole text is scored; null, empty and wordless texts have the score of a text without features.
Repeated rows score alike. With no labels, or one class only, every score is 0. Other columns are kept. Very long texts are
scored whole; a table of documents without rows gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm import kernels as K
from tandem.llm.common import batch_slices, prepare, text_buffers

SLICE_BYTES = 1 << 21
#: name and condition of each category, in the order of the chain.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic_fluent", "toxic = 1 AND quality = 1"), ("toxic", "toxic = 1"))
TARGET = "toxic"
PREFIXES = (3, 4, 5, 6)
FOLDS = 4
DECAY = 2e-4
_letters = np.zeros(256, bool)
_letters[0x41:0x5B] = _letters[0x61:0x7B] = _letters[0x80:] = True


def features(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, sorted by row: hashes, or places in ``known`` for those in it."""
    starts, ends, rows = K.word_spans(_letters[data], offsets)
    who = np.searchsorted(rows, np.arange(len(starts)), "right") - 1
    all_rows, all_hashes = [], []
    for n in (0, *PREFIXES):
        own = np.arange(len(starts)) if not n else np.flatnonzero(ends - starts > n)
        hashes = K.span_hashes(data, starts[own], starts[own] + n if n else ends[own], K.FOLDED)
        if n:
            hashes = hashes ^ np.uint64(0xABCDEF0123456789 * n & (1 << 64) - 1)
        row = who[own]
        if known is not None:
            at = K.member(hashes, known)
            row, hashes = row[at >= 0], at[at >= 0].astype(np.uint64)
        all_rows.append(row)
        all_hashes.append(hashes)
    row, value = np.concatenate(all_rows), np.concatenate(all_hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])] if len(row) else np.zeros(0, bool)
    return row[fresh], value[fresh]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _margin(n: int, rows: np.ndarray, cols: np.ndarray, before: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    out = np.bincount(rows, weights[cols], n) if len(rows) else np.zeros(n)
    return out + before @ weights[width:-1] + weights[-1]


def fit(n: int, rows: np.ndarray, cols: np.ndarray, width: int, before: np.ndarray, y: np.ndarray, steps: int = 120, decay: float = DECAY) -> np.ndarray:
    """Logistic regression by Adam over all rows: feature weights, then those of ``before``, then the bias."""
    w = np.zeros(width + before.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        e = (_sigmoid(_margin(n, rows, cols, before, w, width)) - y) / n
        g = np.r_[np.bincount(cols, e[rows], width), before.T @ e, e.sum()] + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return w


@dataclass
class Chain:
    known: np.ndarray
    weights: list[np.ndarray]
    threshold: float

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        rows, cols = features(data, offsets, self.known)
        out = np.zeros((n, 0))
        for w in self.weights:
            p = _sigmoid(_margin(n, rows, cols.astype(np.int64), out, w, len(self.known)))
            out = np.c_[out, p]
        return out


@dataclass
class Examples:
    """What all models of a chain learn from: (row, feature) pairs, labels, and the fold of each document."""

    rows: np.ndarray
    cols: np.ndarray
    width: int
    labels: np.ndarray
    fold: np.ndarray

    def fold_model(self, before: np.ndarray, target: int, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights learned outside fold f, or from all documents if there is no such fold, and the probabilities they give."""
        y, test = self.labels[:, target], self.fold != f
        own, index = test[self.rows], np.cumsum(test) - 1
        w = fit(int(test.sum()), index[self.rows[own]], self.cols[own], self.width, before[test], y[test])
        return w, _sigmoid(_margin(len(y), self.rows, self.cols, before, w, self.width))


Runner = Callable[[Examples, np.ndarray, int, int], list[tuple[np.ndarray, np.ndarray]]]


def here(examples: Examples, before: np.ndarray, target: int, models: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The models of all folds, and that of all documents, one after the other."""
    return [examples.fold_model(before, target, f) for f in range(models)]


def on_executors(spark: SparkSession) -> Runner:
    """The same, each model in a task of its own; the examples are sent once."""
    sent: dict[int, Broadcast] = {}

    def run(examples: Examples, before: np.ndarray, target: int, models: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if id(examples) not in sent:
            sent[id(examples)] = spark.sparkContext.broadcast(examples)
        shared = sent[id(examples)]

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for f in batch.column("id").to_pylist():
                    w, p = shared.value.fold_model(before, target, f)
                    yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([w.tobytes()], pa.binary()), pa.array([p.tobytes()], pa.binary())], ["id", "w", "p"])

        found = sorted(spark.range(0, models, 1, models).mapInArrow(learn, "id long, w binary, p binary").collect())
        return [(np.frombuffer(r.w), np.frombuffer(r.p)) for r in found]

    return run


def train(texts: pa.Array, labels: np.ndarray, target: int, most: int, folds: int = FOLDS, run: Runner = here) -> Chain | None:
    n = len(texts)
    if not n or labels[:, target].min() == labels[:, target].max():
        return None
    data, offsets = text_buffers(texts)
    # in slices of documents: memory follows the distinct features, not all their places
    slices = [(low, min(n, low + 500)) for low in range(0, n, 500)]
    cut = lambda low, high: (data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
    kinds, counts = np.zeros(0, np.uint64), np.zeros((0, 1 + labels.shape[1]))
    for low, high in slices:
        row, hashes = features(*cut(low, high))
        own, place = np.unique(hashes, return_inverse=True)
        met = np.stack([np.bincount(place, w, len(own)) for w in (None, *labels[low:high][row].T)], 1)
        kinds, place = np.unique(np.concatenate([kinds, own]), return_inverse=True)
        both = np.zeros((len(kinds), counts.shape[1]))
        both[place[: len(counts)]] += counts
        both[place[len(counts) :]] += met
        counts = both
    score = np.zeros(len(kinds))
    for y, hit in zip(labels.T, counts[:, 1:].T, strict=True):
        rate = y.mean()
        if 0 < rate < 1:
            score = np.maximum(score, np.abs(hit - counts[:, 0] * rate) / np.sqrt(counts[:, 0] * rate * (1 - rate)) * (counts[:, 0] >= 4))
    known = kinds[np.sort(np.argsort(-score, kind="stable")[: min(most, n)])]
    found = [(row + low, cols) for low, high in slices for row, cols in [features(*cut(low, high), known)]]
    rows, cols = (np.concatenate(x).astype(np.int32) for x in zip(*found, strict=True))
    fold = np.random.default_rng(11).permutation(n) % folds
    examples = Examples(rows, cols, len(known), labels, fold)
    outside = np.zeros((n, 0))
    weights = []
    for category in range(labels.shape[1]):
        models = run(examples, outside, category, folds + 1)
        weights.append(models[folds][0])
        outside = np.c_[outside, np.stack([p for _, p in models[:folds]])[fold, np.arange(n)]]
    p, y = outside[:, target], labels[:, target]
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, n + 1) + y.sum())
    top = int(f1.argmax())
    after = p[order[top + 1]] if top + 1 < n else 0.0
    return Chain(known, weights, float((p[order[top]] + after) / 2))


def _score(shared, names: list[str], target: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain | None = shared.value
        for batch in batch_slices(batches, "text", SLICE_BYTES):
            p = chain.predict(*text_buffers(batch.column("text"))) if chain else np.zeros((batch.num_rows, len(names)))
            toxic = p[:, target] >= chain.threshold if chain else np.zeros(batch.num_rows, bool)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(toxic), *(pa.array(np.ascontiguousarray(x)) for x in p.T)], ["row", "is_toxic", *names])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str], ...], sample: int, sample_chars: int) -> pa.Table:
    """About ``sample`` labelled documents for each value of the target, by the least hashes of doc_id."""
    named = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *(F.expr(c).cast("int").alias(n) for n, c in categories)).dropna()
    named = named.groupBy("doc_id").agg(*(F.max(n).alias(n) for n, _ in categories))
    sizes = {r[TARGET]: r["count"] for r in named.groupBy(TARGET).count().collect()}
    # a hash below a bound: no sort, and the rows of a class never meet in one task
    chosen = F.lit(False)
    for value, count in sizes.items():
        chosen = chosen | ((F.col(TARGET) == value) & (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / count) * (1 << 30))))
    few = named.where(chosen)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring("text", 1, sample_chars).alias("text"), F.xxhash64("text").alias("h"))
    found = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", *(n for n, _ in categories)).agg(F.min(F.struct("h", "text"))["text"].alias("text"))
    return found.toArrow().sort_by("doc_id")


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str], ...] = CATEGORIES, sample: int = 4000, most: int = 2000, sample_chars: int = 50_000) -> DataFrame:
    """``row`` (all columns of ``docs``), is_toxic, and the probability of each category, of every row."""
    prepare(docs.sparkSession)
    names = [n for n, _ in categories]
    table = training_sample(docs, labels, categories, sample, sample_chars).combine_chunks()
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    y = np.stack([table.column(n).to_numpy().astype(float) for n in names], 1) if table.num_rows else np.zeros((0, len(names)))
    chain = train(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, y, names.index(TARGET), most, run=on_executors(docs.sparkSession))
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    given = docs.select("text", F.struct(*docs.columns).alias("row"))
    schema = T.StructType([T.StructField("row", given.schema["row"].dataType), T.StructField("is_toxic", T.BooleanType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    return given.mapInArrow(_score(shared, names, names.index(TARGET)), schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic (the decision), score and the probabilities of all categories."""
    found = score_toxicity(docs.select("doc_id", "text"), labels)
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("is_toxic").alias("toxic"), F.col(TARGET).alias("score"), *(F.col(n).alias(f"p_{n}") for n, _ in CATEGORIES))
